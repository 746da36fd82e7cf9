"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters a shingle's hash over a ring, a second one gives the values on that ring; the k-th signature
coordinate is the least value after turning the ring by k places. A shingle therefore contributes one contiguous run of
the second permutation, and a signature is the least of those runs coordinate by coordinate.

Documents are first folded into classes of equal shingle sets. In a bucket every class is compared with one centre, not
with every other class; only classes that are still apart after that are paired, and only within their bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import byte_codes, lower_ascii, mix, only, packed, span_hashes, stored, text_bytes, word_spans
from tabloom.llm.graph import components

RING_BITS = 20
#: At least so many bands, of at most so many rows; a pair at the threshold meets in no bucket with at most this probability.
BANDS, ROWS, LOSS = 36, 7, 1e-6
BLOCK = 256
#: A block of a bucket holds about so many shingles and classes; blocks are compared two at a time in one task.
BLOCK_SHINGLES, BLOCK_CLASSES, COLUMNS = 1 << 20, 2048, 4096
_RING: dict[int, np.ndarray] = {}


def ring(coordinates: int) -> np.ndarray:
    """All runs of ``coordinates`` neighbouring values of the second permutation, one run for each place on the ring."""
    if coordinates not in _RING:
        values = np.random.default_rng(23).permutation(1 << RING_BITS).astype(np.uint32)
        closed = np.concatenate((values, values[: coordinates - 1]))
        _RING[coordinates] = np.lib.stride_tricks.sliding_window_view(closed, coordinates)
    return _RING[coordinates]


def shingles(data: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; the whole sequence where there are fewer words."""
    low = lower_ascii(data)
    starts, ends = word_spans(low)
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes = span_hashes(byte_codes()[low], starts, ends)
    n = min(size, len(codes))
    at = np.arange(len(codes) - n + 1)
    return np.unique(span_hashes(codes, at, at + n))


def signature(members: np.ndarray, coordinates: int) -> np.ndarray:
    runs = ring(coordinates)
    places = np.unique(mix(members ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - RING_BITS)).astype(np.int64)  # the first permutation
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), BLOCK):
        np.minimum(out, runs[places[i: i + BLOCK]].min(axis=0), out=out)
    return out


def band_hashes(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    rows_of = sign[: bands * rows].reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        h = mix(h + rows_of[:, j] * np.uint64(0x9E3779B97F4A7C15))
    return h.astype(np.int64)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for a similarity: the most rows whose bands stay within the loss."""
    s = min(max(percent, 1), 99) / 100
    rows = next((r for r in range(ROWS, 0, -1) if (1 - s ** r) ** BANDS <= LOSS), 1)
    return max(BANDS, math.ceil(math.log(LOSS) / math.log(1 - s ** rows))), rows


def signatures(docs: DataFrame, size: int, bands: int, rows: int, text: str, key: str) -> DataFrame:
    """(key, text hash, class, number of shingles, band hashes) of every row; equal sets have equal classes, empty ones a null class."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["__text"])
            classes, counts, codes = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                members = shingles(data[a:b], size)
                counts.append(len(members))
                if len(members):
                    total = int(mix(members).sum(dtype=np.uint64)) ^ (len(members) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                    classes.append(total - (1 << 64) if total >> 63 else total)
                    codes.append(band_hashes(signature(members, bands * rows), bands, rows))
                else:
                    classes.append(None)
                    codes.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch["__key"], batch["__th"], pa.array(classes, pa.int64()), pa.array(counts, pa.int64()), pa.array(codes, pa.list_(pa.int64()))],
                names=["__key", "__th", "__class", "__n", "__bands"])

    slim = only(docs, *dict.fromkeys((key, text))).select(F.col(f"`{key}`").alias("__key"), F.xxhash64(F.col(f"`{text}`")).alias("__th"), F.col(f"`{text}`").alias("__text"))
    return slim.mapInArrow(run, f"__key {kind}, __th long, __class long, __n long, __bands array<long>")


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity; ``texts`` has a text for every class in them."""
    left = texts.select(F.col("__class").alias("a"), F.col("__text").alias("__ta"))
    right = texts.select(F.col("__class").alias("b"), F.col("__text").alias("__tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "__ta", "__tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]  # rows come ordered by a: its set is kept for the next row
        for batch in batches:
            (ta, oa), (tb, ob) = text_bytes(batch["__ta"]), text_bytes(batch["__tb"])
            keep = []
            for i, a in enumerate(batch["a"].to_pylist()):
                if last[0] != a:
                    last = [a, shingles(ta[oa[i]: oa[i + 1]], size)]
                one, other = last[1], shingles(tb[ob[i]: ob[i + 1]], size)
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(other) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def similar(one: list[np.ndarray], two: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of two blocks reach the similarity, counted on the members that at least two sets have."""
    sizes = np.array([len(x) for x in one + two])
    _, column, n = np.unique(np.concatenate(one + two), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    use = n[column] > 1
    row, column = row[use], (np.cumsum(n > 1) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(one), len(two)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        table = np.zeros((len(sizes), COLUMNS), np.float32)
        table[row[a:b], column[a:b] - first] = 1
        common += table[: len(one)] @ table[len(one):].T
    return 100 * common >= percent * (sizes[: len(one), None] + sizes[None, len(one):] - common)


def cross_links(apart: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between classes of one bucket (__h) with different labels (__l): pairs of blocks are compared inside a task."""
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["__text"])
            found = [shingles(data[a:b], size).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch["__class"], pa.array(found, pa.binary())], names=["__class", "__set"])

    def compare(table: pa.Table) -> pa.Table:
        i, j = table["__i"][0].as_py(), table["__j"][0].as_py()
        block, label, name = (table[c].to_numpy() for c in ("__block", "__l", "__class"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["__set"]]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(left) and len(right) and len(np.unique(label)) > 1:
            found = similar([sets[k] for k in left], [sets[k] for k in right], percent) & (label[left][:, None] != label[right][None, :])
            x, y = np.nonzero(found)
        else:
            x = y = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(name[left[x]], pa.int64()), "b": pa.array(name[right[y]], pa.int64())})

    blocks = apart.groupBy("__h").agg(F.greatest(F.ceil(F.sum("__n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("__of"))
    dealt = apart.select("__h", "__class", "__l").join(blocks, "__h").withColumn("__block", F.pmod(F.xxhash64("__class"), F.col("__of")).cast("int"))
    dealt = dealt.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__of") - 1)))
    dealt = dealt.withColumns({"__i": F.least("__block", "__with"), "__j": F.greatest("__block", "__with")}).drop("__with", "__of")
    dealt = dealt.join(texts.mapInArrow(sets_of, "__class long, __set binary"), "__class")
    return dealt.groupBy("__h", "__i", "__j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None, text: str = "text",
                    key: str = "doc_id") -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key linked directly or over others), kept (key = component_id), plus __th.

    A null or blank text has an empty set and is linked with nothing, not even with its like. Repeated rows are one
    class. A null key takes no part in the smallest key; a component of null keys alone has a null id, and null-keyed
    rows are kept only there. ``__th`` (xxhash64 of the text) tells rows with equal keys apart.
    """
    return _labelled(docs, size, percent, bands, rows, text, key).drop("__l")


def _labelled(docs: DataFrame, size: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of :func:`near_duplicates` with ``__l``, the class that names the component: keys may be null or stand in several. Null for empty sets."""
    slim = stored(signatures(docs, size, bands or banding(percent)[0], rows or banding(percent)[1], text, key))
    sets = slim.where("__class IS NOT NULL").groupBy("__class").agg(
        F.min("__key").alias("__least"), F.min("__th").alias("__th"), F.min("__n").alias("__n"), F.min("__bands").alias("__bands"))
    sets = stored(sets)
    buckets = sets.select("__class", "__n", F.explode("__bands").alias("__h"))
    # a class's weight is the number of its bucket mates: the most central class of a bucket is compared with the rest
    shared = buckets.groupBy("__h").agg(F.count("*").alias("__size")).where("__size > 1")
    members = stored(buckets.join(shared, "__h"))
    weight = members.groupBy("__class").agg(F.sum("__size").alias("__w"))
    members = stored(members.join(weight, "__class"))
    centre = members.groupBy("__h").agg(F.max(F.struct("__w", F.col("__class").alias("c"), F.col("__n").alias("m"))).alias("__top"))
    like = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  the sizes alone can rule a pair out
    star = members.join(centre, "__h").where((F.col("__class") != F.col("__top.c")) & like(F.col("__n"), F.col("__top.m")))
    star = stored(star.select(F.least("__class", "__top.c").alias("b"), F.greatest("__class", "__top.c").alias("a"),
                              F.col("__top.c").alias("c")).distinct().select(
        F.col("c").alias("a"), F.when(F.col("c") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b")))
    edges = stored(linked(star, _texts(docs, sets, star, text), size, percent))
    labels = components(edges)
    apart = members.join(labels.select(F.col("v").alias("__class"), F.col("label").alias("__l")), "__class", "left").select(
        "__h", "__class", "__n", F.coalesce("__l", "__class").alias("__l"))
    mixed = apart.groupBy("__h").agg(F.min("__l").alias("x"), F.max("__l").alias("y")).where("x <> y").select("__h")
    apart = stored(apart.join(mixed, "__h"))
    more = stored(cross_links(apart, _texts(docs, sets, apart.select(F.col("__class").alias("a"), F.col("__class").alias("b")), text), size, percent))
    if more.head(1):
        labels = components(edges.unionByName(more))
    groups = sets.join(labels, F.col("__class") == F.col("v"), "left").select("__class", "__least", F.coalesce("label", "__class").alias("__l"))
    least = groups.groupBy("__l").agg(F.min("__least").alias("component_id"))
    groups = groups.join(least, "__l").select(F.col("__class").alias("__c"), "component_id", "__l")
    out = slim.join(groups, F.col("__class") == F.col("__c"), "left")
    own = F.when(F.col("__class").isNull(), F.col("__key")).otherwise(F.col("component_id"))
    return out.select(F.col("__key").alias(key), F.col("__n").alias("n_shingles"), own.alias("component_id"),
                      F.col("__key").eqNullSafe(own).alias("kept"), "__th", "__l")


def _texts(docs: DataFrame, sets: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """One text for every class in the pairs."""
    ids = pairs.select(F.col("a").alias("__class")).unionByName(pairs.select(F.col("b").alias("__class"))).distinct()
    wanted = sets.select("__class", "__th").join(ids, "__class", "left_semi")
    body = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("__th"), F.col(f"`{text}`").alias("__text"))
    found = body.join(wanted, "__th").groupBy("__class").agg(F.first("__text").alias("__text"))
    return stored(found)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest key (of several texts the smallest hash), and one of its repetitions.

    Null and blank texts are near to nothing and all stay; keys may be null or repeated; all columns are kept, whatever their names.
    """
    rows = _labelled(docs, key=key, text=text, **how).where("kept").select(F.col(f"`{key}`").alias("k"), F.col("__th").alias("m"), F.col("__l").alias("l"))
    # all kept rows of a group have one key, but a key may be null or stand in several groups
    one = rows.where("l IS NOT NULL").groupBy("l").agg(F.min("k").alias("k"), F.min("m").alias("m")).drop("l")
    kept = one.unionByName(rows.where("l IS NULL").drop("l").distinct()).select(F.col("k").alias("kept_k"), F.col("m").alias("kept_m"))
    marked = packed(docs, k=key, t=text).withColumn("h", F.xxhash64("t"))
    found = marked.join(kept, F.col("k").eqNullSafe(F.col("kept_k")) & (F.col("h") == F.col("kept_m")), "left_semi")
    blank = F.btrim(F.coalesce(F.col("t"), F.lit("")), F.lit(" \t\n\u000b\f\r")) == ""
    full = found.where(~blank).dropDuplicates(["k", "h"])
    return full.unionByName(found.where(blank)).select("row.*")
