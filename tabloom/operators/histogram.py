"""Histograms, box statistics and Jensen-Shannon distance on top of the shared value axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.names import doubles, strings
from tabloom.operators.cdf import Axis, label_pairs, named_pairs, rank_quantiles

# 50 shared edges give 49 bins for the distance; 20 bins for the density tables.
DISTANCE_BINS = 49
DENSITY_BINS = 20


def with_bin(df: DataFrame, low: Column, high: Column, bins: int) -> DataFrame:
    """Add ``lo``, ``step`` and the 0-based ``bin`` of ``x``, found by comparing with the evenly spaced edges themselves.

    The last bin holds its right edge; an empty range has no bins.
    """
    df = df.withColumns({"lo": low, "step": (high - low) / F.lit(float(bins))})
    df = df.withColumn("guess", F.when(F.col("step") > 0, F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("step"), F.lit(0.0)))))
    x, lo, step, guess = (F.col(c) for c in ("x", "lo", "step", "guess"))
    moved = guess - F.when(x < lo + guess * step, 1).otherwise(0) + F.when(x >= lo + (guess + 1) * step, 1).otherwise(0)
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), moved)).cast("int")
    return df.withColumn("bin", F.when(guess.isNotNull(), at)).drop("guess")


def shared_histogram(axis: Axis, bins: int = DISTANCE_BINS) -> DataFrame:
    """Counts per label in bins over the joint range of all labels: (ci, bin, n0, n1, ...); no bin in a constant column.

    Nothing is filtered here: a condition on the bin would sink below the shared shuffle and split it in two.
    """
    binned = with_bin(axis.counts, axis.low(), axis.high(), bins)
    return binned.groupBy("ci", "bin").agg(*[F.sum(f"n{g}").alias(f"n{g}") for g in range(len(axis.labels))])


def shared_bins(axis: Axis, bins: int = DISTANCE_BINS) -> DataFrame:
    """:func:`shared_histogram` with its empty bins as zeros; a constant column has no range to be divided."""
    counts = shared_histogram(axis, bins)
    every = counts.where("bin IS NOT NULL").select("ci").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, ["ci", "bin"], "left").fillna(0, [f"n{g}" for g in range(len(axis.labels))])


def numbered_jensen_shannon(axis: Axis, against: str | None = None, bins: int = DISTANCE_BINS) -> DataFrame:
    """(ci, ia, ib, js)."""
    shares = shared_histogram(axis, bins)

    def pull(p: Column, mid: Column) -> Column:
        return F.when(p > 0, p * F.ln(p / mid)).otherwise(0.0)

    cells = []
    pairs = label_pairs(axis, against)
    for a, b in pairs:
        p = F.col(f"n{a}") / F.nullif(axis.size(a).cast("double"), F.lit(0.0))
        q = F.col(f"n{b}") / F.nullif(axis.size(b).cast("double"), F.lit(0.0))
        mid = (p + q) / 2
        cells += [F.lit(a), F.lit(b), F.when(F.col("bin").isNotNull(), pull(p, mid) + pull(q, mid))]
    parts = shares.select("ci", F.stack(F.lit(len(pairs)), *cells).alias("ia", "ib", "part"))
    return parts.groupBy("ci", "ia", "ib").agg(F.sqrt(F.greatest(F.sum("part") / 2, F.when(F.count("part") > 0, F.lit(0.0)))).alias("js"))


def jensen_shannon(axis: Axis, against: str | None = None, bins: int = DISTANCE_BINS) -> DataFrame:
    """Square-root Jensen-Shannon distance (natural log) of the binned samples; none for a constant column."""
    return named_pairs(numbered_jensen_shannon(axis, against, bins), axis)


def density_histogram(axis: Axis, bins: int = DENSITY_BINS) -> DataFrame:
    """Density in equal bins over each label's own range: (column, label, bin, lo, hi, n, density), empty bins as zeros.

    A constant sample gets a range of width 1 around its value.
    """
    groups = range(len(axis.labels))
    ranges = (
        axis.counts.select("ci", "x", F.stack(F.lit(len(axis.labels)), *[
            p for g in groups for p in (F.lit(g), F.col(f"n{g}"))]).alias("gi", "n")).where("n > 0")
    )
    own = ranges.groupBy("ci", "gi").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("size"))
    around = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    own = own.select("ci", "gi", (F.col("lo") - around).alias("lo"), (F.col("hi") + around).alias("hi"), "size")
    facts = own.collect()  # one row per column and label
    k = len(axis.labels)
    table = {(r["ci"], r["gi"]): r for r in facts}
    slots = [table.get((ci, g)) for ci in range(len(axis.columns)) for g in groups]
    at = F.col("ci") * k + F.col("gi") + 1
    low = F.element_at(doubles(s["lo"] if s else None for s in slots), at)
    high = F.element_at(doubles(s["hi"] if s else None for s in slots), at)
    counts = with_bin(ranges, low, high, bins).groupBy("ci", "gi", "bin").agg(F.sum("n").alias("n"))
    every = ranges.sparkSession.createDataFrame([tuple(r) for r in facts], "ci int, gi int, lo double, hi double, size bigint")
    every = every.withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(bins))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (
        every.drop("hi").join(counts, ["ci", "gi", "bin"], "left").fillna(0, ["n"])
        .select(axis.column_name().alias("column"), F.element_at(strings(axis.labels), F.col("gi") + 1).alias("label"),
                "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("lo"),
                (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("hi"), "n",
                (F.col("n") / (F.col("size") * F.col("step"))).alias("density"))
    )


def box_statistics(axis: Axis) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR), mean and fliers per column and label."""
    k = len(axis.labels)
    quartiles = {(r["ci"], r["gi"], r["j"]): r["value"] for r in rank_quantiles(axis, 5).collect()}
    slots = [(ci, g) for ci in range(len(axis.columns)) for g in range(k)]
    at = F.col("ci") * k + F.col("gi") + 1

    def quartile(j: int) -> Column:
        return F.element_at(doubles(quartiles.get((ci, g, j)) for ci, g in slots), at)

    q1, q2, q3 = quartile(1), quartile(2), quartile(3)
    reach = (q3 - q1) * F.lit(1.5)
    long = axis.counts.select("ci", "x", F.stack(F.lit(k), *[
        p for g in range(k) for p in (F.lit(g), F.col(f"n{g}"))]).alias("gi", "n")).where("n > 0")
    within = F.col("x").between(q1 - reach, q3 + reach)
    return (
        long.groupBy("ci", "gi").agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
            F.min(F.when(within, F.col("x"))).alias("whisker_low"),
            F.max(F.when(within, F.col("x"))).alias("whisker_high"),
            F.sum(F.when(~within, F.col("n")).otherwise(0)).alias("fliers"))
        .select(axis.column_name().alias("column"), F.element_at(strings(axis.labels), F.col("gi") + 1).alias("label"),
                "n", "mean", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "whisker_low", "whisker_high", "fliers")
    )


def qq_table(axis: Axis, reference: str, most: int = 100) -> DataFrame:
    """Quantiles of every label at min(rows of the reference, ``most``) even probabilities."""
    size = axis.size(axis.labels.index(reference))
    return rank_quantiles(axis, F.least(size, F.lit(most).cast("bigint"))).select("column", "label", "j", "p", "value")
