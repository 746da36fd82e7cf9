"""What an imputer wrote: cells, uniqueness, repeated values and the rows that hold them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.names import col
from tabloom.operators.duplicates import salted_join
from tabloom.operators.profile import distinct_counts, missing_summary
from tabloom.session import cut_lineage

# Up to so many repeated values are broadcast (counted first); beyond, a value's rows are dealt over as many parts as its count asks for.
BROADCAST_VALUES, ROWS_PER_SALT = 100_000, 100_000


def imputed_cells(original: DataFrame, imputed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, value) of the cells that were missing in the original; rows are aligned by key."""
    gaps = original.select(col(key), *[col(c).isNull().alias(f"__m{i}") for i, c in enumerate(columns)]).where(
        reduce(lambda a, b: a | b, [F.col(f"__m{i}") for i in range(len(columns))]))
    both = gaps.join(imputed.select(col(key), *[col(c) for c in columns]), key)
    cells = [p for i, c in enumerate(columns) for p in (F.lit(c), F.col(f"__m{i}"), col(c).cast("double"))]
    return both.select(col(key), F.stack(F.lit(len(columns)), *cells).alias("column", "was_missing", "value")).where(
        "was_missing").drop("was_missing")


def uniqueness(original: DataFrame, methods: Mapping[str, DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """(method, column, n_imputed, n_unique, pct_unique, n_repeated, status) in one grouped pass over all methods."""
    parts = [imputed_cells(original, df, key, columns).select(F.lit(m).alias("method"), "column", "value")
             for m, df in methods.items()]
    counts = reduce(DataFrame.unionByName, parts).groupBy("method", "column", "value").agg(F.count("*").alias("n"))
    summary = counts.groupBy("method", "column").agg(
        F.sum("n").alias("n_imputed"), F.count("value").alias("n_unique"),
        F.count_if(F.col("value").isNotNull() & (F.col("n") > 1)).alias("n_repeated"))
    pct = F.when(F.col("n_imputed") > 0, F.col("n_unique") * 100.0 / F.col("n_imputed")).otherwise(100.0)
    status = F.when(F.col("n_repeated") == 0, "all unique").otherwise(F.concat(F.col("n_repeated").cast("string"), F.lit(" repeated")))
    return summary.withColumn("pct_unique", pct).withColumn("status", status)


def repeated_imputed(original: DataFrame, imputed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, key): one row per row that holds an imputed value seen more than once.

    Rows rather than lists of keys: a median fills any number of cells with the same value.
    """
    cells = imputed_cells(original, imputed, key, columns).where("value IS NOT NULL")
    repeated = cells.groupBy("column", "value").agg(F.count("*").alias("n")).where("n > 1")
    repeated = cut_lineage(repeated)
    values, most = repeated.agg(F.count("*"), F.max("n")).first()
    if values <= BROADCAST_VALUES:
        return cells.join(F.broadcast(repeated), ["column", "value"])
    return salted_join(cells, repeated, ["column", "value"], key, max(16, -(-most // ROWS_PER_SALT)))


def imputation_counts(original: DataFrame, imputed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_filled, n_missing, total_distinct, still_missing): before and after."""
    before = missing_summary(original, columns).select("column", "n_filled", "n_missing")
    after = missing_summary(imputed, columns).select("column", F.col("n_missing").alias("still_missing"))
    distinct = distinct_counts(imputed, columns).select("column", F.col("n_distinct").alias("total_distinct"))
    return before.join(F.broadcast(after), "column").join(F.broadcast(distinct), "column")
