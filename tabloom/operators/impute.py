"""Simple imputers and nearest-neighbour imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.names import col
from tabloom.operators.cleaning import complete_rows, replaced
from tabloom.operators.neighbors import BLOCK_ROWS, nearest
from tabloom.operators.profile import value_counts
from tabloom.operators.quantiles import median

MIN_COMPLETE = 10


def fill(df: DataFrame, values: Mapping[str, float | str | None]) -> DataFrame:
    return replaced(df, {c: F.coalesce(col(c), F.lit(v)) for c, v in values.items() if v is not None})


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact interpolated medians; a column without values stays as it is."""
    return fill(df, median(df, {c: col(c) for c in columns}))


def mean_of(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def mode_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties."""
    counts = value_counts(df, columns)
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    found = {r["column"]: r["value"] for r in best.collect()}
    kinds = dict(df.dtypes)
    return replaced(df, {c: F.coalesce(col(c), F.lit(v).cast(kinds[c])) for c, v in found.items()})


def missing_as_category(df: DataFrame, columns: Sequence[str], label: str = "Missing", suffix: str = "_missing") -> DataFrame:
    """Keep missingness as information: an indicator per column, text filled with ``label``, numbers left open."""
    kinds = dict(df.dtypes)
    new = {c + suffix: col(c).isNull().cast("int") for c in columns}
    new |= {c: F.coalesce(col(c), F.lit(label)) for c in columns if kinds[c] == "string"}
    return replaced(df, new)


def knn_values(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, column number, value): mean over the k nearest donors for every missing cell that has a comparable donor."""
    columns = list(columns)
    wants = [col(c).isNull() for c in columns]
    gives = [col(c).isNotNull() for c in columns]
    near = nearest(df, df, key, key, columns, k, wants, gives, [col(c) for c in columns], block_rows)
    return near.groupBy("rid", "target").agg(F.avg("value").alias("value"))


def knn_impute(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every missing cell from its k nearest donors that hold the column; the column mean where no donor is comparable."""
    columns = list(columns)
    means = mean_of(df, columns)
    found = knn_values(df, key, columns, k, block_rows)
    wide = found.groupBy(F.col("rid").alias("__rid")).agg(*[
        F.max(F.when(F.col("target") == i, F.col("value"))).alias(f"__k{i}") for i in range(len(columns))])
    joined = df.join(wide, col(key).cast("bigint") == F.col("__rid"), "left")
    filled = replaced(joined, {c: F.coalesce(col(c).cast("double"), F.col(f"__k{i}"), F.lit(means[c]))
                               for i, c in enumerate(columns)})
    return filled.select(*[col(c) for c in df.columns])


def enough_complete_rows(df: DataFrame, columns: Sequence[str] | None = None, least: int = MIN_COMPLETE) -> bool:
    """Whether a generator can be fitted on complete rows; below the limit the median is the fallback."""
    return len(complete_rows(df, columns).limit(least).select(F.lit(1)).collect()) >= least
