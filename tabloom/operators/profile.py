"""Per-column statistics: one wide aggregate for the moments, one grouped pass for distinct values, exact medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tabloom.functions.cells import SPECIAL_TOKENS, finite
from tabloom.functions.names import col, doubles
from tabloom.operators.quantiles import median

MOMENTS = ("n", "min", "max", "mean", "std", "variance", "skewness", "kurtosis", "zeros")


def numeric_profile(df: DataFrame, columns: Sequence[str], with_median: bool = True) -> DataFrame:
    """Count, range, moments (biased skewness, excess kurtosis), coefficient of variation, zero share, median."""
    columns = list(columns)
    data = df.select(*[finite(col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    aggs = []
    for i in range(len(columns)):
        c = F.col(f"c{i}")
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"),
                 F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"), F.var_samp(c).alias(f"variance{i}"),
                 F.skewness(c).alias(f"skewness{i}"), F.kurtosis(c).alias(f"kurtosis{i}"),
                 F.avg((c == 0).cast("double")).alias(f"zeros{i}")]
    cells = [p for i in range(len(columns)) for p in (F.lit(i), *[F.col(f"{m}{i}") for m in MOMENTS])]
    table = data.agg(*aggs).select(F.stack(F.lit(len(columns)), *cells).alias("ci", *MOMENTS))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("ci") + 1)
    cv = F.when(F.col("mean") != 0, F.abs(F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)))).when(
        F.col("mean") == 0, float("inf"))
    out = [name.alias("column"), "n", "min", "max", (F.col("max") - F.col("min")).alias("range"), "mean", "std",
           "variance", "skewness", "kurtosis", cv.alias("cv"), F.col("zeros").alias("zero_share")]
    if with_median:
        middles = median(data, {c: F.col(f"c{i}") for i, c in enumerate(columns)})
        out.append(F.element_at(doubles(middles[c] for c in columns), F.col("ci") + 1).alias("median"))
    return table.select(*out)


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns)."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None, zero_token: str = "NP",
                    special: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """(column, n_missing, pct_missing, n_filled, n_rows) in one scan, and whether the tokens occur in the column."""
    columns = df.columns if columns is None else list(columns)
    text = {n for n, t in df.dtypes if t == "string"}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count(col(c)).alias(f"f{i}"))
        for mark, tokens in (("z", [zero_token]), ("s", special)):
            spelled = F.trim(col(c)).isin(*tokens) if c in text else F.lit(False)
            aggs.append(F.coalesce(F.bool_or(spelled), F.lit(False)).alias(f"{mark}{i}"))
    cells = [p for i, c in enumerate(columns) for p in (F.lit(c), *[F.col(f"{m}{i}") for m in "fzs"])]
    missing = F.col("n_rows") - F.col("n_filled")
    return (
        df.agg(*aggs).select(F.col("rows").alias("n_rows"), F.stack(F.lit(len(columns)), *cells).alias(
            "column", "n_filled", "has_zero_token", "has_special"))
        .select("column", missing.alias("n_missing"),
                (missing * 100.0 / F.nullif(F.col("n_rows"), F.lit(0)).cast("double")).alias("pct_missing"),
                "n_filled", "n_rows", "has_zero_token", "has_special")
    )


def total_missing(df: DataFrame) -> DataFrame:
    return missing_summary(df).agg(F.sum("n_missing").alias("total_missing"))


def columns_with_missing(summary: DataFrame, above: float = 0.0, below: float | None = None) -> DataFrame:
    """Columns whose missing percentage lies strictly between the bounds."""
    out = summary.where(F.col("pct_missing") > above)
    return out if below is None else out.where(F.col("pct_missing") < below)


def value_counts(df: DataFrame, columns: Sequence[str], as_text: bool = True) -> DataFrame:
    """(column, value, n) of all non-missing cells; copies are merged before the shuffle."""
    cells = [p for c in columns for p in (F.lit(c), col(c).cast("string") if as_text else col(c))]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("column", "value")).where("value IS NOT NULL")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: float | None = None) -> DataFrame:
    """(column, n_distinct, n_filled); ``approximate`` is the wanted relative deviation of a sketch."""
    if approximate is not None:
        wide = df.agg(*[e.alias(f"{t}{i}") for i, c in enumerate(columns) for t, e in (
            ("d", F.approx_count_distinct(col(c), approximate)), ("f", F.count(col(c))))])
        cells = [p for i, c in enumerate(columns) for p in (F.lit(c), F.col(f"d{i}"), F.col(f"f{i}"))]
        return wide.select(F.stack(F.lit(len(columns)), *cells).alias("column", "n_distinct", "n_filled"))
    found = value_counts(df, columns).groupBy("column").agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("n_filled"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"),
        F.coalesce("n_filled", F.lit(0)).cast("bigint").alias("n_filled"))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.05,
                     approximate: float | None = None) -> DataFrame:
    """(column, n_distinct, n_filled, status): constant, near_constant or varied; an all-missing column is varied."""
    counts = distinct_counts(df, df.columns if columns is None else list(columns), approximate)
    status = F.when(F.col("n_distinct") == 1, "constant").when(
        (F.col("n_filled") > 0) & (F.col("n_distinct") < F.col("n_filled") * share), "near_constant").otherwise("varied")
    return counts.withColumn("status", status)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column).alias("value")).where("value IS NOT NULL").distinct().orderBy("value")


def scale_ratio(profile: DataFrame) -> DataFrame:
    """Largest range over smallest positive range."""
    smallest = F.coalesce(F.min(F.when(F.col("range") > 0, F.col("range"))), F.lit(1.0))
    return profile.agg((F.max("range") / smallest).alias("scale_ratio"))


def numeric_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
