"""Exact, linearly interpolated quantiles without sorting the table.

Every target rank starts with the interval [min, max]. While an interval holds more than ``limit`` rows, a sketch over a
sample of just that interval proposes a narrower one, and a counting scan over all rows proves that the rank lies inside it;
a proposal that fails the proof is widened. Sampling decides only how fast the interval shrinks, never the answer. A round
shrinks it some hundred times and moves only sketches and counts, so the table itself is never shuffled. The last step groups
the few remaining values and reads the ranks off.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIMIT = 100_000
ACCURACY = 10_000
SAMPLE_ROWS = 250_000


@dataclass
class Target:
    """One wanted rank (0-based) of a column, known to lie in [low, high], which starts after ``base`` smaller values."""

    c: str
    rank: int
    low: float
    high: float
    base: int
    inside: int
    slack: float
    value: float | None = None

    def open(self, limit: int) -> bool:
        return self.value is None and self.inside > limit and self.low < self.high


def exact_quantiles(df: DataFrame, exprs: Mapping[str, Column], probs: Sequence[float],
                    limit: int = LIMIT, accuracy: int = ACCURACY, sample_rows: int = SAMPLE_ROWS) -> dict[str, dict[float, float | None]]:
    """Quantiles of every expression; NULLs are skipped, a column of NULLs gives None."""
    names = list(exprs)
    keys = {f"c{i}": name for i, name in enumerate(names)}
    data = df.select(*[exprs[name].cast("double").alias(k) for k, name in keys.items()])
    out: dict[str, dict[float, float | None]] = {name: {p: None for p in probs} for name in names}
    if not names:
        return out

    facts = data.agg(*[f(k).alias(f"{t}_{k}") for k in keys
                       for t, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    slack = 2.0 / accuracy + 2.0 / math.sqrt(sample_rows)
    targets: dict[tuple[str, int], Target] = {}
    places = []
    for k, name in keys.items():
        n = facts[f"n_{k}"]
        for p in probs if n else ():
            h = p * (n - 1)
            rank = min(math.floor(h), n - 1)
            upper = rank + (1 if h > rank else 0)
            places.append((name, p, k, rank, upper, h - rank))
            for r in (rank, upper):
                targets.setdefault((k, r), Target(k, r, facts[f"lo_{k}"], facts[f"hi_{k}"], 0, n, slack))

    attempt = 0
    while wide := [t for t in targets.values() if t.open(limit)]:
        narrow(data, wide, accuracy, sample_rows, attempt)
        attempt += 1
    read_off(data, targets.values())
    for name, p, k, rank, upper, frac in places:
        a, b = targets[(k, rank)].value, targets[(k, upper)].value
        out[name][p] = a + (b - a) * frac
    return out


def by_span(targets) -> dict[tuple, list[Target]]:
    spans: dict[tuple, list[Target]] = {}
    for t in targets:
        spans.setdefault((t.c, t.low, t.high), []).append(t)
    return spans


def narrow(data: DataFrame, targets: Sequence[Target], accuracy: int, sample_rows: int, attempt: int) -> None:
    """One round: sketch a sample of each interval, then prove the proposals by counting all rows.

    The copies of both ends are counted too: a rank among them is answered, any other lies strictly between, so heavy
    values never keep an interval from shrinking.
    """
    spans = by_span(targets)
    sketches = []
    for i, ((c, low, high), group) in enumerate(spans.items()):
        inside = F.when(F.col(c).between(low, high), F.col(c))
        shares = []
        for t in group:
            shares.append(max(0.0, (t.rank - t.base) / t.inside - t.slack))
            shares.append(min(1.0, (t.rank + 1 - t.base) / t.inside + t.slack))
        sketches.append(F.percentile_approx(inside, shares, accuracy).alias(f"s{i}"))
    fraction = min(1.0, sample_rows / min(t.inside for t in targets))
    rows = data if fraction >= 1.0 else data.sample(fraction, seed=17 + attempt)
    found = rows.agg(*sketches).first()
    counts: dict[tuple, list] = {}
    proposals = []
    for i, ((c, low, high), group) in enumerate(spans.items()):
        for k, t in enumerate(group):
            lo, hi = found[f"s{i}"][2 * k:2 * k + 2] if found[f"s{i}"] else (low, high)
            # An outermost share reaches to the end of the interval itself: a sample may miss its last values.
            lo = low if (t.rank - t.base) / t.inside <= t.slack else lo
            hi = high if (t.rank + 1 - t.base) / t.inside + t.slack >= 1.0 else hi
            proposals.append((t, lo, hi))
            x = F.col(c)
            counts.setdefault((c, lo, hi), [F.count_if(x < lo), F.count_if(x.between(lo, hi)), F.count_if(x == lo), F.count_if(x == hi)])
    proof = data.agg(*[e.alias(f"{'bklh'[j]}{i}") for i, es in enumerate(counts.values()) for j, e in enumerate(es)]).first()
    numbers = {key: [proof[f"{m}{i}"] for m in "bklh"] for i, key in enumerate(counts)}
    for t, lo, hi in proposals:
        base, inside, at_lo, at_hi = numbers[(t.c, lo, hi)]
        if not base <= t.rank < base + inside:
            t.slack = min(1.0, t.slack * 4)
        elif t.rank < base + at_lo:
            t.value = lo
        elif t.rank >= base + inside - at_hi:
            t.value = hi
        else:
            t.low, t.high = math.nextafter(lo, math.inf), math.nextafter(hi, -math.inf)
            t.base, t.inside = base + at_lo, inside - at_lo - at_hi


def read_off(data: DataFrame, targets) -> None:
    """Group the values left in the intervals (at most ``limit`` rows each) and pick the wanted ranks."""
    for t in targets:
        if t.value is None and t.low == t.high:
            t.value = t.low
    spans = by_span([t for t in targets if t.value is None])
    if not spans:
        return
    cells, wanted, any_inside = [], F.lit(False), F.lit(False)
    before, upto = F.col("upto") - F.col("cnt"), F.col("upto")
    for i, ((c, lo, hi), group) in enumerate(spans.items()):
        inside = F.col(c).between(lo, hi)
        any_inside = any_inside | inside
        cells += [F.lit(i), F.when(inside, F.col(c))]
        for t in group:
            wanted = wanted | ((F.col("span") == i) & (before <= t.rank - t.base) & (upto > t.rank - t.base))
    by_value = (
        data.where(any_inside).select(F.stack(F.lit(len(spans)), *cells).alias("span", "x"))
        .where("x IS NOT NULL")
        .groupBy("span", "x").agg(F.count("*").alias("cnt"))
    )
    running = F.sum("cnt").over(W.partitionBy("span").orderBy("x"))
    hits = by_value.withColumn("upto", running).where(wanted).collect()
    groups = list(spans.values())
    for hit in hits:
        for t in groups[hit["span"]]:
            if hit["upto"] - hit["cnt"] <= t.rank - t.base < hit["upto"]:
                t.value = hit["x"]


def median(df: DataFrame, exprs: Mapping[str, Column], **options) -> dict[str, float | None]:
    return {name: q[0.5] for name, q in exact_quantiles(df, exprs, [0.5], **options).items()}
