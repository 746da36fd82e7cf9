"""Empirical distribution functions of labelled samples on a shared value axis.

One axis serves every two-sample statistic. Values are first collapsed to counts per label, so hot values shrink before any
shuffle. Each column is cut into ordered buckets sized by its row count; the running counts of a bucket start from the
totals of the buckets before it, so no task ever sorts a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.functions.cells import finite
from tabloom.functions.names import col, doubles, longs, strings
from tabloom.operators.buckets import bucket_count, cut_points, locate

ROWS_PER_BUCKET = 100_000
#: Pairs compared by expressions of one row; labels found by a search per row; numbers of a task's table.
PAIRS_IN_ROW, SEARCHED_LABELS, TASK_CELLS = 48, 64, 2_000_000
MAX_LABELS = 4_096
BROADCAST_CELLS = 1_000_000


@dataclass
class Axis:
    """Labelled values ``x`` of column number ``ci`` in bucket ``b``, and their counts ``n0..`` per label."""

    columns: list[str]
    labels: list[str]
    sizes: list[list[int]]
    lows: list[float | None]
    highs: list[float | None]
    values: DataFrame
    bucketed: bool

    @cached_property
    def counts(self) -> DataFrame:
        """One row per value, one column per label."""
        return self.values.groupBy("ci", "b", "x").agg(
            *[F.count_if(F.col("gi") == g + 1).alias(f"n{g}") for g in range(len(self.labels))])

    @cached_property
    def cells(self) -> DataFrame:
        """One row per value and label (``gi`` from 1): the plan does not grow with the labels."""
        return self.values.groupBy("ci", "b", "x", "gi").agg(F.count("*").alias("n"))

    def size(self, label: int) -> Column:
        """Number of values of a label in the row's column."""
        return F.element_at(longs(row[label] for row in self.sizes), F.col("ci") + 1)

    def column_name(self) -> Column:
        return F.element_at(strings(self.columns), F.col("ci") + 1)

    def low(self) -> Column:
        return F.element_at(doubles(self.lows), F.col("ci") + 1)

    def high(self) -> Column:
        return F.element_at(doubles(self.highs), F.col("ci") + 1)


def stacked(sources: dict[str, DataFrame], columns: Sequence[str], label: str = "source") -> DataFrame:
    """Several tables under a label; only the wanted columns are read."""
    parts = [df.select(F.lit(name).alias(label), *[col(c) for c in columns]) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def build_axis(df: DataFrame, columns: Sequence[str], label: str, labels: Sequence[str] | None = None,
               rows_per_bucket: int = ROWS_PER_BUCKET, max_labels: int = MAX_LABELS) -> Axis:
    """Collapse ``columns`` of a labelled table; ``labels`` are found in the data when not given (NULL is left out).

    Named labels may be any part of the data's. Finding more than ``max_labels`` is an error, as labels and their counts
    come to the driver: a column with a label per row would bring all of it.
    """
    columns = list(columns)
    data = df.select(col(label).cast("string").alias("g"),
                     *[finite(col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    keys = [f"c{i}" for i in range(len(columns))]
    known = F.col("g").isNotNull() if labels is None else F.col("g").isin(*[str(v) for v in labels])
    facts = data.where(known).groupBy("g").agg(
        *[f(k).alias(f"{t}_{k}") for k in keys for t, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    facts = (facts.limit(max_labels + 1) if labels is None else facts).collect()
    if labels is None and len(facts) > max_labels:
        raise ValueError(f"more than {max_labels} groups in {label}: name the labels or raise max_labels")
    by_label = {r["g"]: r for r in facts}
    labels = sorted(by_label) if labels is None else [str(v) for v in labels]

    def pick(what, k, fold, empty):
        found = [by_label[g][f"{what}_{k}"] for g in labels if g in by_label]
        return fold([v for v in found if v is not None], default=empty)

    sizes = [[by_label[g][f"n_{k}"] if g in by_label else 0 for g in labels] for k in keys]
    lows = [pick("lo", k, min, None) for k in keys]
    highs = [pick("hi", k, max, None) for k in keys]
    chosen = data.where(F.col("g").isin(*labels))

    buckets = {k: bucket_count(sum(sizes[i]), rows_per_bucket) for i, k in enumerate(keys)}
    cuts = cut_points(chosen, buckets, {k: sum(sizes[i]) for i, k in enumerate(keys)})
    if len(labels) > SEARCHED_LABELS:  # the labels are on the driver already, so the size of their table is known
        codes = df.sparkSession.createDataFrame([(g, i + 1) for i, g in enumerate(labels)], "g string, gi bigint")
        coded = chosen.join(F.broadcast(codes), "g")
    else:
        coded = chosen.withColumn("gi", F.array_position(strings(labels), F.col("g")))
    placed = locate(coded, {f"b{i}": (k, cuts[k]) for i, k in enumerate(keys)})
    cells = [piece for i, k in enumerate(keys) for piece in (F.lit(i), F.col(k), F.col(f"b{i}"))]
    # All three conditions are spelled out, so that no consumer infers one of its own and all of them share one shuffle.
    long = placed.select("gi", F.stack(F.lit(len(keys)), *cells).alias("ci", "x", "b")).where(
        "x IS NOT NULL AND ci IS NOT NULL AND b IS NOT NULL")
    return Axis(columns, labels, sizes, lows, highs, long, any(cuts.values()))


def cumulative(axis: Axis) -> DataFrame:
    """Add ``f0..`` (values <= x per label) and ``next_x`` (the next value of the axis, NULL at the end)."""
    groups = range(len(axis.labels))
    inside = W.partitionBy("ci", "b").orderBy("x")
    local = axis.counts.select(
        "*", F.lead("x").over(inside).alias("next_x"),
        *[F.sum(f"n{g}").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias(f"f{g}") for g in groups])
    if not axis.bucketed:
        return local
    totals = axis.counts.groupBy("ci", "b").agg(
        F.min("x").alias("first_x"), *[F.sum(f"n{g}").alias(f"t{g}") for g in groups])
    ordered = W.partitionBy("ci").orderBy("b")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "ci", "b", F.lead("first_x").over(ordered).alias("after"),
        *[F.coalesce(F.sum(f"t{g}").over(before), F.lit(0)).alias(f"o{g}") for g in groups])
    # One row per bucket: the size is known from the cut points, so the broadcast is bounded.
    if len(axis.columns) * 16_384 * (len(axis.labels) + 2) <= BROADCAST_CELLS * 8:
        offsets = F.broadcast(offsets)
    return local.join(offsets, ["ci", "b"]).select(
        "ci", "b", "x", F.coalesce("next_x", "after").alias("next_x"),
        *[f"n{g}" for g in groups], *[(F.col(f"f{g}") + F.col(f"o{g}")).alias(f"f{g}") for g in groups])


def label_pairs(axis: Axis, against: str | None = None) -> list[tuple[int, int]]:
    """Every unordered pair of labels, or the pairs of one label with all others."""
    if against is None:
        return list(combinations(range(len(axis.labels)), 2))
    first = axis.labels.index(against)
    return [(first, g) for g in range(len(axis.labels)) if g != first]


def named_pairs(table: DataFrame, axis: Axis) -> DataFrame:
    """Names in place of the numbers ``ci``, ``ia``, ``ib``."""
    names = strings(axis.labels)
    rest = [c for c in table.columns if c not in ("ci", "ia", "ib")]
    return table.select(axis.column_name().alias("column"), F.element_at(names, F.col("ia") + 1).alias("label_a"),
                        F.element_at(names, F.col("ib") + 1).alias("label_b"), *rest)


def numbered_two_sample(axis: Axis, against: str | None = None, min_size: int = 1, pairs_in_row: int = PAIRS_IN_ROW) -> DataFrame:
    """(ci, ia, ib, n_a, n_b, ks, wasserstein); up to ``pairs_in_row`` pairs are compared by expressions, more by arrays."""
    k = len(axis.labels)
    if k < 2:
        raise ValueError("two labels are needed")
    if (k - 1 if against is not None else k * (k - 1) // 2) > pairs_in_row:
        return many_two_sample(axis, against, min_size)
    pairs = label_pairs(axis, against)
    running = cumulative(axis)
    step = F.coalesce(F.col("next_x") - F.col("x"), F.lit(0.0))
    shares = running.select("ci", step.alias("step"), *[
        (F.col(f"f{g}") / F.nullif(axis.size(g).cast("double"), F.lit(0.0))).alias(f"s{g}") for g in range(k)])
    gaps = [F.abs(F.col(f"s{a}") - F.col(f"s{b}")) for a, b in pairs]
    wide = shares.groupBy("ci").agg(*[
        e.alias(f"{t}{i}") for i, gap in enumerate(gaps)
        for t, e in (("k", F.max(gap)), ("w", F.sum(gap * F.col("step"))))])
    cells = [piece for i, (a, b) in enumerate(pairs)
             for piece in (F.lit(a), F.lit(b), axis.size(a), axis.size(b), F.col(f"k{i}"), F.col(f"w{i}"))]
    out = wide.select("ci", F.stack(F.lit(len(pairs)), *cells).alias("ia", "ib", "n_a", "n_b", "ks", "wasserstein"))
    return out.where((F.col("n_a") >= min_size) & (F.col("n_b") >= min_size))


def many_two_sample(axis: Axis, against: str | None = None, min_size: int = 1) -> DataFrame:
    """As ``numbered_two_sample`` with a plan of one size for any number of labels.

    For all pairs a bucket's counts are laid out as values x labels in one task, a few values at a time, starting from the
    totals of the buckets before it; one label against the others needs each pair's own values only. A bucket hands on its
    largest gap and its area for every pair.
    """
    k, sizes = len(axis.labels), np.array(axis.sizes, float)
    reference = None if against is None else axis.labels.index(against)

    def compare(key: tuple, cells: pa.Table, before: pa.Table) -> pa.Table:
        ci = key[0].as_py()
        first, second = np.triu_indices(k, 1)
        size = sizes[ci]
        use = (size[first] >= max(min_size, 1)) & (size[second] >= max(min_size, 1))
        first, second = first[use], second[use]
        order = np.argsort(cells["x"].to_numpy(), kind="stable")
        x, gi, n = (cells[c].to_numpy()[order] for c in ("x", "gi", "n"))
        base = np.zeros(k)
        at, over = before["gi"].to_numpy(), before["n"].to_numpy()
        base[at[at > 0] - 1] = over[at > 0]
        after = before["after"][0].as_py() if before.num_rows else None
        heads = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        points = x[heads]
        step = np.diff(np.append(points, points[-1] if after is None else after))
        row = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(x))))
        largest, area = np.zeros(len(first)), np.zeros(len(first))
        block = max(1, TASK_CELLS // max(k, len(first), 1))
        for a in range(0, len(points), block):
            b = min(a + block, len(points))
            lo, hi = np.searchsorted(row, [a, b])
            running = np.zeros((b - a, k))
            running[row[lo:hi] - a, gi[lo:hi] - 1] = n[lo:hi]
            running[0] += base
            running = np.cumsum(running, axis=0)
            base = running[-1]
            share = running / np.maximum(size, 1)
            gap = np.abs(share[:, first] - share[:, second])
            np.maximum(largest, gap.max(axis=0), out=largest)
            area += step[a:b] @ gap
        return pa.table({
            "ci": pa.array(np.full(len(first), ci), pa.int32()), "ia": pa.array(first, pa.int32()), "ib": pa.array(second, pa.int32()),
            "n_a": pa.array(size[first].astype(np.int64)), "n_b": pa.array(size[second].astype(np.int64)), "k": largest, "w": area})

    def compare_one(key: tuple, cells: pa.Table, before: pa.Table) -> pa.Table:
        """One label against the others: a pair is looked at where one of its two labels has a value, not at every value of the bucket."""
        ci = key[0].as_py()
        size = sizes[ci]
        second = np.flatnonzero((size >= max(min_size, 1)) & (np.arange(k) != reference) & (size[reference] >= max(min_size, 1)))
        x, gi, n = (cells[c].to_numpy() for c in ("x", "gi", "n"))
        order = np.lexsort((x, gi))
        x, label, n = x[order], gi[order] - 1, n[order]
        base = np.zeros(k)
        at, over = before["gi"].to_numpy(), before["n"].to_numpy()
        base[at[at > 0] - 1] = over[at > 0]
        after = before["after"][0].as_py() if before.num_rows else None
        end = after if after is not None else x.max() if len(x) else 0.0
        head = x.min() if len(x) else end
        lo, hi = np.searchsorted(label, [reference, reference + 1])
        ref_x, ref_n = x[lo:hi], n[lo:hi]
        largest, area = np.zeros(len(second)), np.zeros(len(second))
        block = max(1, TASK_CELLS // max(1, len(ref_x) + 1 + len(x) // k))
        for a in range(0, len(second), block):
            some = second[a: a + block]
            place = np.searchsorted(some, label)
            mine = np.flatnonzero((place < len(some)) & (some[np.minimum(place, len(some) - 1)] == label))
            m = len(some)
            # every pair starts at the bucket's first value, then come its own values and those of the one label
            points = np.concatenate((np.full(m, head), x[mine], np.tile(ref_x, m)))
            pair = np.concatenate((np.arange(m), place[mine], np.repeat(np.arange(m), len(ref_x))))
            own = np.concatenate((base[some], n[mine], np.zeros(m * len(ref_x))))
            ref = np.concatenate((np.full(m, base[reference]), np.zeros(len(mine)), np.tile(ref_n, m)))
            by = np.lexsort((points, pair))  # stable: a pair's start comes first
            points, pair = points[by], pair[by]
            begin = np.searchsorted(pair, np.arange(m))
            own, ref = (c - np.repeat(np.concatenate(([0], c[begin[1:] - 1])), np.diff(np.append(begin, len(pair))))
                        for c in (np.cumsum(own[by]), np.cumsum(ref[by])))
            gap = np.abs(ref / size[reference] - own / size[some][pair])
            step = np.append(points[1:], end)
            step[begin[1:] - 1] = end
            ends = np.append((points[1:] != points[:-1]) | (pair[1:] != pair[:-1]), True)
            largest[a: a + block] = np.maximum.reduceat(np.where(ends, gap, 0.0), begin)
            area[a: a + block] = np.add.reduceat(gap * (step - points), begin)
        return pa.table({
            "ci": pa.array(np.full(len(second), ci), pa.int32()), "ia": pa.array(np.full(len(second), reference), pa.int32()),
            "ib": pa.array(second, pa.int32()), "n_a": pa.array(np.full(len(second), int(size[reference])), pa.int64()),
            "n_b": pa.array(size[second].astype(np.int64)), "k": largest, "w": area})

    starts = bucket_starts(axis).select(F.col("ci").alias("to_ci"), F.col("b").alias("to_b"), "gi", "n", "after")
    parts = axis.cells.groupBy("ci", "b").cogroup(starts.groupBy("to_ci", "to_b")).applyInArrow(
        compare if reference is None else compare_one, "ci int, ia int, ib int, n_a bigint, n_b bigint, k double, w double")
    return parts.groupBy("ci", "ia", "ib", "n_a", "n_b").agg(F.max("k").alias("ks"), F.sum("w").alias("wasserstein"))


def bucket_starts(axis: Axis) -> DataFrame:
    """(ci, b, gi, n, after): values of each label in the buckets before, and the next bucket's first value.

    Every bucket has a row per label with values before it, and one row with ``gi`` 0 that is always there.
    """
    if not axis.bucketed:
        return axis.cells.select("ci", "b").distinct().select(
            "*", F.lit(0).cast("bigint").alias("gi"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("after"))
    totals = axis.cells.groupBy("ci", "b", "gi").agg(F.sum("n").alias("n"), F.min("x").alias("x"))
    heads = totals.groupBy("ci", "b").agg(F.min("x").alias("x")).select(
        "ci", "b", F.lead("x").over(W.partitionBy("ci").orderBy("b")).alias("after"))
    every = heads.select("ci", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(axis.labels)).cast("bigint"))).alias("gi"), "after")
    sums = every.join(totals.drop("x"), ["ci", "b", "gi"], "left")
    before = W.partitionBy("ci", "gi").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("ci", "b", "gi", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), "after").where("gi = 0 OR n > 0")


def two_sample(axis: Axis, against: str | None = None, min_size: int = 1) -> DataFrame:
    """Kolmogorov-Smirnov statistic and Wasserstein distance for every column and pair of labels."""
    return named_pairs(numbered_two_sample(axis, against, min_size), axis)


def rank_quantiles(axis: Axis, points: Column | int) -> DataFrame:
    """Quantiles at ``points`` evenly spaced probabilities from 0 to 1, per column and label.

    With m probabilities over s values, probability j/(m-1) lies between ranks floor(h) and floor(h) + 1 of
    h = j*(s-1)/(m-1). A row of the running counts covers ranks first..last, so it answers for a whole range of j that
    integer arithmetic gives directly; rows that answer for none are dropped before the small final grouping.
    """
    running = cumulative(axis)
    m = (F.lit(points) if isinstance(points, int) else points).cast("bigint")
    grid = F.greatest(m - 1, F.lit(1).cast("bigint"))
    answers = []
    for g in range(len(axis.labels)):
        span = axis.size(g) - 1
        last = F.col(f"f{g}") - 1
        first = F.col(f"f{g}") - F.col(f"n{g}")

        def from_rank(rank: Column, span: Column = span) -> Column:
            return F.call_function("div", rank * grid + span - 1, F.greatest(span, F.lit(1).cast("bigint")))

        every = F.sequence(F.lit(0).cast("bigint"), m - 1)
        low = F.when(span == 0, every).otherwise(longs_between(from_rank(first), F.least(from_rank(last + 1), m)))
        high = F.when(span > 0, longs_between(from_rank(F.greatest(first - 1, F.lit(0).cast("bigint"))),
                                              F.least(from_rank(last), m))).otherwise(no_longs())
        found = F.concat(F.transform(low, rank_hit(g, "a")), F.transform(high, rank_hit(g, "b")))
        answers.append(F.when(F.col(f"n{g}") > 0, found).otherwise(F.filter(found, lambda _: F.lit(False))))
    hits = (
        running.select("ci", F.explode(F.concat(*answers)).alias("hit")).select("ci", "hit.*")
        .groupBy("ci", "gi", "j").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    sizes = [n for row in axis.sizes for n in row]
    size = F.element_at(longs(sizes), F.col("ci") * len(axis.labels) + F.col("gi") + 1)
    h = F.col("j") * (size - 1) / grid
    frac = h - F.floor(h)
    value = F.when((frac > 0) & F.col("b").isNotNull(),
                   F.col("a") + (F.col("b") - F.col("a")) * frac).otherwise(F.col("a"))
    return hits.select(
        "ci", "gi", axis.column_name().alias("column"),
        F.element_at(strings(axis.labels), F.col("gi") + 1).alias("label"),
        F.col("j").cast("int").alias("j"), (F.col("j") / grid).alias("p"), value.alias("value"))


def rank_hit(g: int, side: str):
    """Struct builder for one answered j: ``a`` holds the lower rank's value, ``b`` the upper one's."""
    nothing, x = F.lit(None).cast("double"), F.col("x")
    a, b = (x, nothing) if side == "a" else (nothing, x)
    return lambda j: F.struct(F.lit(g).alias("gi"), j.alias("j"), a.alias("a"), b.alias("b"))


def no_longs() -> Column:
    return F.array().cast("array<bigint>")


def longs_between(start: Column, stop: Column) -> Column:
    """The longs from ``start`` up to but not including ``stop``."""
    return F.when(stop > start, F.sequence(start, stop - 1)).otherwise(no_longs())
