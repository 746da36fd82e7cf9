"""Ordered buckets of a value axis: cut points from a sampled sketch, position by binary search inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BUCKETS = 16_384
SAMPLE_PER_BUCKET = 1_000


def bucket_count(rows: int, rows_per_bucket: int) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket)))


def cut_points(df: DataFrame, buckets: Mapping[str, int], rows: Mapping[str, int]) -> dict[str, list[float]]:
    """Inner cut points that split each column into about equal shares, from a sketch over a sample of ``rows``.

    As with range partitioning, the cuts decide how even the work is, never the result.
    """
    wanted = {c: b for c, b in buckets.items() if b > 1}
    if not wanted:
        return {c: [] for c in buckets}
    fraction = max(SAMPLE_PER_BUCKET * b / rows[c] for c, b in wanted.items())
    source = df if fraction >= 1.0 else df.sample(fraction, seed=17)
    row = source.agg(*[
        F.percentile_approx(c, [i / b for i in range(1, b)], max(1_000, 4 * b)).alias(f"q{i}")
        for i, (c, b) in enumerate(wanted.items())
    ]).first()
    found = {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(wanted)}
    return {c: found.get(c, []) for c in buckets}


def locate(df: DataFrame, positions: Mapping[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """Add ``out`` = number of cut points <= ``column`` for ``{out: (column, cuts)}``; NULL goes past the last bucket.

    Names must be plain identifiers.
    """
    searched = {o: (c, cuts) for o, (c, cuts) in positions.items() if len(cuts)}
    for o, (c, cuts) in positions.items():
        if o not in searched:
            df = df.withColumn(o, F.lit(0))
    if not searched:
        return df
    infinity = float("inf")
    split = Bucketizer(
        splitsArray=[[-infinity, *[float(v) for v in cuts], infinity] for _, cuts in searched.values()],
        inputCols=[c for c, _ in searched.values()],
        outputCols=list(searched),
        handleInvalid="keep",
    )
    df = split.transform(df)
    return df.withColumns({o: F.col(o).cast("int") for o in searched})
