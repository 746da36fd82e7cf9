"""Benchmark decontamination by greedy string tiling: shared seeds, longest unmarked matches first, coverage of the test item.

Documents are scanned once for each block of the benchmark (blocks hold at most ``block_bytes`` of text, so what a task
receives has a bound); nothing is shuffled. Reordered passages are caught since tiles may lie in any order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import byte_codes, only, packed, span_hashes, text_bytes

SEED_WORDS = 5
COVERAGE = 0.5
BLOCK_BYTES = 8 << 20
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[c for c in range(128) if not chr(c).isalnum()]] = 32


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes and start bytes of the tokens: lower-cased runs of ASCII letters, digits and all other bytes above 127."""
    plain = _TABLE[data]
    inside = np.zeros(len(plain) + 2, np.int8)
    inside[1:-1] = plain != 32
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return span_hashes(byte_codes()[plain], starts, ends), starts


def folded(text: Column) -> Column:
    """Upper-cased by Unicode (so that ß and SS, ς and Σ agree) with spaces for all but letters, marks and digits."""
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{M}\p{N}]+", " ")


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(max(0, len(codes) - n + 1))
    return span_hashes(codes, at, at + n)


def tiles(doc: np.ndarray, item: np.ndarray, pairs: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seed pairs (place in doc, place in item): (doc place, item place, length) of the marked matches.

    Longest first; equals by place in the item, then in the document. A match that meets a mark goes on with its longest
    unmarked parts. Seeds are confirmed token by token.
    """
    heap: list[tuple[int, int, int]] = []
    runs: dict[int, list[int]] = {}
    for d, i in pairs:
        runs.setdefault(d - i, []).append(i)
    for shift, places in runs.items():
        places.sort()
        begin = last = None
        for i in [*places, None]:
            if begin is not None and (i is None or i != last + 1):
                same = doc[begin + shift: last + least + shift] == item[begin: last + least]
                if same.all():
                    heap.append((-(last + least - begin), begin, begin + shift))
                begin = None
            if begin is None:
                begin = i
            last = i
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    found = []
    while heap:
        size, i, d = heapq.heappop(heap)
        size = -size
        taken = in_doc[d: d + size] | in_item[i: i + size]
        if not taken.any():
            in_doc[d: d + size] = in_item[i: i + size] = True
            found.append((d, i, size))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([1], taken, [1]))))
        for a, b in edges.reshape(-1, 2):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), i + int(a), d + int(a)))
    return found


class Index:
    """Seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], seed: int):
        self.items = []
        by_size: dict[int, list] = {}
        for key, text in items:
            codes, _ = tokens(np.frombuffer((text or "").encode(), np.uint8))
            if len(codes):
                least = min(seed, len(codes))
                hashes = gram_hashes(codes, least)
                by_size.setdefault(least, []).append((hashes, np.full(len(hashes), len(self.items)), np.arange(len(hashes))))
                self.items.append((key, codes, least))
        self.sizes = {}
        for least, parts in by_size.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[h >> np.uint64(44)] = True
            self.sizes[least] = (h[order], item[order], place[order], sieve)

    def hits(self, codes: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(document, item) -> seed pairs, for token codes of documents that end at ``ends``."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        starts = np.concatenate(([0], ends[:-1]))
        for least, (h, item, place, sieve) in self.sizes.items():
            grams = gram_hashes(codes, least)
            at = np.flatnonzero(sieve[grams >> np.uint64(44)])
            lo, hi = np.searchsorted(h, grams[at]), np.searchsorted(h, grams[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(ends, at, "right")
            inside = at + least <= ends[doc] if len(at) else np.zeros(0, bool)
            for p, a, b, k in zip(at[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), doc[inside].tolist()):
                for j in range(a, b):
                    out.setdefault((k, int(item[j])), []).append((p - int(starts[k]), int(place[j])))
        return out


def blocks(benchmark: DataFrame, text: str, key: str, block_bytes: int, fold: bool) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of at most ``block_bytes`` of text; one item larger than that is a block of its own."""
    body = folded(F.col("t")) if fold else F.col("t")
    rows = only(benchmark, *dict.fromkeys((key, text))).select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    while True:
        part = F.pmod(F.xxhash64("k", "t"), F.lit(n))
        sizes = rows.distinct().groupBy(part.alias("p")).agg(F.sum(F.octet_length("t")).alias("b"), F.count("*").alias("c"))
        if not sizes.where((F.col("b") > block_bytes) & (F.col("c") > 1)).head(1):
            break
        n *= 2
    for p in range(n):
        yield [tuple(r) for r in rows.distinct().where(part == p).select("k", body).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text",
          seed: int = SEED_WORDS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, fold: bool = False) -> DataFrame:
    """One row per document and benchmark item whose tiles cover at least ``coverage`` of the item's tokens.

    Columns: the two keys, item_tokens, covered_tokens, n_tiles, longest_tile, coverage. Items shorter than ``seed``
    tokens must occur whole; items and documents without tokens (null, empty) match nothing. Repeated documents give
    repeated rows, repeated items one row each distinct (key, text). Other columns are ignored. With ``fold`` case and
    punctuation are those of Unicode; without it only ASCII letters change case and every byte above 127 is a letter.
    """
    spark = docs.sparkSession
    body = folded(F.col(f"`{text}`")) if fold else F.col(f"`{text}`")
    source = only(docs, *dict.fromkeys((key, text))).select(F.col(f"`{key}`").alias("__key"), body.alias("__text"))
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    first, second = key, item_key if item_key != key else f"item_{item_key}"
    schema = f"`{first}` {kinds[0]}, `{second}` {kinds[1]}, item_tokens long, covered_tokens long, n_tiles long, longest_tile long, coverage double"
    item_type = {f.name: f.dataType for f in benchmark.schema.fields}[item_key]

    def scan(block: list[tuple[object, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            index = Index(shared.value, seed)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    data, offsets = text_bytes(batch["__text"])
                    gaps = np.zeros(len(data) + batch.num_rows, np.uint8) + 32  # a space after each document: no token spans two
                    gaps[np.arange(len(data)) + np.repeat(np.arange(batch.num_rows), np.diff(offsets))] = data
                    codes, starts = tokens(gaps)
                    ends = np.searchsorted(starts, offsets[1:] + np.arange(batch.num_rows))
                    begins = np.concatenate(([0], ends[:-1]))
                    rows = []
                    for (k, j), pairs in index.hits(codes, ends).items():
                        item, tokens_of, least = index.items[j]
                        found = tiles(codes[begins[k]: ends[k]], tokens_of, pairs, least)
                        covered = sum(size for _, _, size in found)
                        if covered >= coverage * len(tokens_of):
                            rows.append((k, item, len(tokens_of), covered, len(found), max(f[2] for f in found)))
                    if rows:
                        take, items, n, c, t, longest = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [batch["__key"].take(pa.array(take)), pa.array(items, to_arrow_type(item_type)), *[pa.array(x, pa.int64()) for x in (n, c, t, longest)],
                             pa.array(np.array(c) / np.array(n), pa.float64())],
                            names=[first, second, "item_tokens", "covered_tokens", "n_tiles", "longest_tile", "coverage"])

        return source.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [scan(block) for block in blocks(benchmark, item_text, item_key, block_bytes, fold)])


def drop_leaked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that :func:`leaks` names; rows with equal keys are told apart by their text.

    Null keys and texts are values like others; repeated rows go or stay together; all columns are kept, whatever their names.
    """
    rows = packed(docs, k=key, t=text).withColumn("m", F.struct("k", F.xxhash64("t").alias("h")))
    bad = leaks(rows.select("m", "t"), benchmark, text="t", key="m", **how).select(F.col("m.k").alias("bad_k"), F.col("m.h").alias("bad_h")).distinct()
    on = F.col("m.k").eqNullSafe(F.col("bad_k")) & F.col("m.h").eqNullSafe(F.col("bad_h"))
    return rows.join(bad, on, "left_anti").select("row.*")
