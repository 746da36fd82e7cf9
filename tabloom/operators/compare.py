"""Score candidate tables against an original: distances, winners, wins and ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tabloom.functions.names import col
from tabloom.operators.cdf import Axis, build_axis, named_pairs, numbered_two_sample, stacked
from tabloom.operators.histogram import numbered_jensen_shannon
from tabloom.operators.schema import parse_counts

METRICS = ("wasserstein", "ks", "js")


def common_numeric(tables: Sequence[DataFrame], strict: bool = False) -> list[str]:
    """Sorted names that are numeric in every table, by type; ``strict`` reads text columns too and takes those in which
    every filled cell is a number."""
    sets = []
    for t in tables:
        names = {f.name for f in t.schema.fields if isinstance(f.dataType, NumericType)}
        if strict:
            counts = parse_counts(t).where("filled > 0 AND filled = parsable")
            names |= {r["column"] for r in counts.collect()}
        sets.append(names)
    return sorted(set.intersection(*sets))


def source_axis(original: DataFrame, candidates: Mapping[str, DataFrame], columns: Sequence[str] | None = None,
                name: str = "original", **options) -> Axis:
    """The shared axis of an original and its candidates, read once."""
    tables = {name: original, **candidates}
    columns = common_numeric(list(tables.values())) if columns is None else list(columns)
    return build_axis(stacked(tables, columns), columns, "source", list(tables), **options)


def distances(axis: Axis, original: str = "original") -> DataFrame:
    """(column, candidate, n_a, n_b, wasserstein, ks, js): both parts grow from the same collapsed counts.

    They are joined by number, not by name, so that no condition on the names sinks into one of them.
    """
    both = numbered_two_sample(axis, original).join(numbered_jensen_shannon(axis, original), ["ci", "ia", "ib"], "left")
    return named_pairs(both, axis).select("column", F.col("label_b").alias("candidate"), "n_a", "n_b", "wasserstein", "ks", "js")


def long_metrics(table: DataFrame) -> DataFrame:
    cells = [p for m in METRICS for p in (F.lit(m), F.col(m))]
    return table.select("column", "candidate", F.stack(F.lit(len(METRICS)), *cells).alias("metric", "value"))


def winners(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """Best candidate per column and metric; ties go to the candidate named first."""
    place = reduce(lambda acc, c: acc.when(F.col("candidate") == c[1], c[0]), enumerate(order),
                   F.when(F.lit(False), F.lit(-1)))
    return (
        long_metrics(table).where("value IS NOT NULL").groupBy("column", "metric")
        .agg(F.min_by("candidate", F.struct(F.col("value"), place.alias("place"))).alias("winner"),
             F.min("value").alias("best"))
    )


def wins(table: DataFrame) -> DataFrame:
    """Columns each candidate wins per metric; a tie counts for everyone who shares it."""
    best = F.min("value").over(W.partitionBy("column", "metric"))
    return (
        long_metrics(table).withColumn("best", best)
        .groupBy("metric", "candidate")
        .agg(F.count_if(F.col("value") <= F.col("best")).alias("wins"), F.count("value").alias("columns"))
    )


def ranking(table: DataFrame) -> DataFrame:
    """Strict pairwise wins over all metrics and columns, then a proper rank."""
    values = long_metrics(table)
    # Candidates below a value = its losses; with ties that is rank() - 1, so wins = columns - rank of the reverse order.
    beaten = F.rank().over(W.partitionBy("column", "metric").orderBy(F.col("value").desc()))
    scored = values.where("value IS NOT NULL").withColumn("beaten", beaten - 1)
    total = scored.groupBy("candidate").agg(F.sum("beaten").cast("bigint").alias("pairwise_wins"))
    return total.withColumn("place", F.rank().over(W.orderBy(F.col("pairwise_wins").desc())).cast("int"))


def moments_by_source(tables: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per column and table: (column, source, n, mean, std)."""
    union = stacked(dict(tables), columns)
    wide = union.groupBy("source").agg(*[
        f(col(c)).alias(f"{t}{i}") for i, c in enumerate(columns)
        for t, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))])
    cells = [p for i, c in enumerate(columns) for p in (F.lit(c), F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"s{i}"))]
    return wide.select("source", F.stack(F.lit(len(columns)), *cells).alias("column", "n", "mean", "std"))


def moments_side_by_side(tables: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """One row per column: real and synthetic mean and deviation next to each other."""
    long = moments_by_source(tables, columns)
    return long.groupBy("column").pivot("source", list(tables)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))


def top_categories(tables: Mapping[str, DataFrame], columns: Sequence[str], top: int = 8) -> DataFrame:
    """The most frequent categories of each table with their share; equal counts by name."""
    parts = []
    for name, df in tables.items():
        totals = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        for i, c in enumerate(columns):
            counts = df.where(col(c).isNotNull()).groupBy(col(c).cast("string").alias("category")).count()
            parts.append(
                counts.orderBy(F.desc("count"), "category").limit(top).select(
                    F.lit(name).alias("source"), F.lit(c).alias("column"), "category", F.col("count").alias("n"),
                    (F.col("count") / F.lit(float(totals[i]))).alias("share")))
    return reduce(DataFrame.unionByName, parts)


def category_coverage(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every category of either table and where it occurs."""
    parts = []
    for c in columns:
        name = col(c).cast("string").alias("category")
        a = real.select(name).where("category IS NOT NULL").distinct().withColumn("in_real", F.lit(True))
        b = synthetic.select(name).where("category IS NOT NULL").distinct().withColumn("in_synthetic", F.lit(True))
        parts.append(
            a.join(b, "category", "full_outer").select(
                F.lit(c).alias("column"), "category", F.coalesce("in_real", F.lit(False)).alias("in_real"),
                F.coalesce("in_synthetic", F.lit(False)).alias("in_synthetic")))
    return reduce(DataFrame.unionByName, parts)
