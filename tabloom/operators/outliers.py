"""Outliers by interquartile range and by median absolute deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.names import col, doubles
from tabloom.operators.quantiles import exact_quantiles, median

# Fence width, modified z-score scale and cutoff, fewest values for a verdict.
FENCE, Z_SCALE, Z_CUTOFF, MIN_VALUES = 1.5, 0.6745, 3.5, 5


def fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float, float]]:
    """{column: (q1, q3, lower, upper)} for columns that hold a value."""
    quartiles = exact_quantiles(df, {c: col(c) for c in columns}, [0.25, 0.75])
    out = {}
    for c in columns:
        q1, q3 = quartiles[c][0.25], quartiles[c][0.75]
        if q1 is not None:
            out[c] = (q1, q3, q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
    return out


def _nothing(df: DataFrame, schema: str) -> DataFrame:
    """The empty result for a table none of whose columns can be judged."""
    return df.sparkSession.createDataFrame([], schema)


def iqr_outliers(df: DataFrame, columns: Sequence[str], min_values: int = MIN_VALUES) -> DataFrame:
    """(column, n, q1, q3, lower, upper, max, n_outliers, pct_outliers); columns with too few values are left out."""
    bounds = fences(df, columns)
    kept = [c for c in columns if c in bounds]
    if not kept:
        return _nothing(df, "column string, n long, q1 double, q3 double, lower double, upper double, max double, n_outliers long, pct_outliers double")
    wide = df.agg(*[e.alias(f"{t}{i}") for i, c in enumerate(kept) for t, e in (
        ("n", F.count(col(c))), ("m", F.max(col(c).cast("double"))),
        ("o", F.count_if((col(c) < bounds[c][2]) | (col(c) > bounds[c][3]))))])
    cells = [p for i, c in enumerate(kept) for p in (
        F.lit(c), F.col(f"n{i}"), *[F.lit(v) for v in bounds[c]], F.col(f"m{i}"), F.col(f"o{i}"))]
    return (
        wide.select(F.stack(F.lit(len(kept)), *cells).alias("column", "n", "q1", "q3", "lower", "upper", "max", "n_outliers"))
        .where(F.col("n") >= min_values)
        .withColumn("pct_outliers", F.col("n_outliers") * 100.0 / F.col("n"))
    )


def outlier_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, value) of every cell outside its fences, as rows."""
    bounds = fences(df, columns)
    kept = [c for c in columns if c in bounds]
    if not kept:
        return df.select(col(key), F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("value")).limit(0)
    cells = [p for c in kept for p in (
        F.lit(c), F.when((col(c) < bounds[c][2]) | (col(c) > bounds[c][3]), col(c).cast("double")))]
    return df.select(col(key), F.stack(F.lit(len(kept)), *cells).alias("column", "value")).where("value IS NOT NULL")


def mad_outliers(df: DataFrame, columns: Sequence[str], min_values: int = MIN_VALUES) -> DataFrame:
    """(column, n, median, mad, n_outliers, pct_outliers) by the modified z-score; none where the deviation is 0."""
    middles = median(df, {c: col(c) for c in columns})
    kept = [c for c in columns if middles[c] is not None]
    spreads = median(df, {c: F.abs(col(c) - F.lit(middles[c])) for c in kept}) if kept else {}
    kept = [c for c in kept if spreads[c] > 0]
    if not kept:
        return _nothing(df, "column string, n long, median double, mad double, n_outliers long, pct_outliers double")
    wide = df.agg(*[e.alias(f"{t}{i}") for i, c in enumerate(kept) for t, e in (
        ("n", F.count(col(c))),
        ("o", F.count_if(F.abs((col(c) - F.lit(middles[c])) * Z_SCALE / F.lit(spreads[c])) > Z_CUTOFF)))])
    cells = [p for i, c in enumerate(kept) for p in (F.lit(i), F.lit(c), F.col(f"n{i}"), F.col(f"o{i}"))]
    return (
        wide.select(F.stack(F.lit(len(kept)), *cells).alias("ci", "column", "n", "n_outliers"))
        .where(F.col("n") >= min_values)
        .select("column", "n", F.element_at(doubles(middles[c] for c in kept), F.col("ci") + 1).alias("median"),
                F.element_at(doubles(spreads[c] for c in kept), F.col("ci") + 1).alias("mad"), "n_outliers",
                (F.col("n_outliers") * 100.0 / F.col("n")).alias("pct_outliers"))
    )
