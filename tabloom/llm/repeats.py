"""What the two substring operators share: text blocks, content-defined anchors, and the exchange of their contexts.

A window is ``length`` consecutive symbols of one document. Among the ``gram``-symbol grams of a window the one with the
least hash is its anchor, so equal windows have equal anchors at equal places, and neighbouring windows mostly share one.
All windows of one anchor occurrence form its context. Per block of texts every (anchor, context) pair is sent once, as
packed numbers, to the task that owns the anchor's hash range; it answers for each pair:

    0  nothing of this context recurs
    1  the whole context occurs elsewhere (before this document, where order counts): every window is repeated
    2  other contexts have this anchor: the kernel must compare them
    3  as 1, and the context is also needed by the kernel as the other side

Only contexts marked 2 and 3 travel as symbols. Blocks are a table bucketed by block number, so texts are never shuffled.
Hashes have 64 bits and more; a context is told apart by 40 bits of anchor within a hash range and 48 bits of content.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tabloom.llm.common import byte_codes, mix, only, span_hashes, stored, text_bytes, word_spans
from tabloom.session import shared_folder

BLOCK_BYTES = 2 << 20
BLOCK_DOCS = 1 << 15
#: Expected anchors in one hash range: what one answering task holds.
RANGE_ANCHORS = 1 << 20
#: Windows one anchor may stand for: bits of a signed 64-bit mask without its sign.
MASK_BITS = 63
#: Symbols of contexts that one kernel task takes, and the most that one anchor (or prefix) may bring to it.
BIN_BYTES, HOT_BYTES = 4 << 20, 32 << 20
STEP_BITS = 21
LAST = (1 << 63) - 1


@dataclass
class Symbols:
    """A block as symbols: codes, ends of the documents in symbols, and for words their place in the bytes."""

    codes: np.ndarray
    ends: np.ndarray
    starts_at: np.ndarray | None = None
    ends_at: np.ndarray | None = None


def as_bytes(data: np.ndarray, ends: np.ndarray) -> Symbols:
    return Symbols(byte_codes()[data], ends)


def as_words(data: np.ndarray, ends: np.ndarray) -> Symbols:
    n = len(ends)
    lengths = np.diff(np.concatenate(([0], ends)))
    spaced = np.full(len(data) + n, 32, np.uint8)  # a space after each document: no word spans two
    spaced[np.arange(len(data)) + np.repeat(np.arange(n), lengths)] = data
    a, b = word_spans(spaced)
    codes = span_hashes(byte_codes()[spaced], a, b)
    shift = np.searchsorted(ends + np.arange(n), a, "right")
    return Symbols(codes, np.searchsorted(a, ends + np.arange(n), "right"), a - shift, b - shift)


@dataclass
class Anchors:
    """Anchor occurrences of a block: place, first and last window start, anchor hash, context hash, document."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    doc: np.ndarray


def anchors(codes: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Anchors:
    n, width = len(codes), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    at = np.arange(n - gram + 1)
    hashes = span_hashes(codes, at, at + gram)
    low_bits = np.uint64((1 << STEP_BITS) - 1)
    step = (1 << STEP_BITS) - width
    found = []
    for first in range(0, n - length + 1, step):
        count = min(step, n - length + 1 - first)
        key = (hashes[first: first + count + width - 1] & ~low_bits) | np.arange(count + width - 1, dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[:count], key[width - span: width - span + count])
        found.append((key & low_bits).astype(np.int64) + first)
    anchor = np.concatenate(found)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    start = np.flatnonzero(ends[doc[: n - length + 1]] - at[: n - length + 1] >= length)
    if not len(start):
        return anchors(codes[:0], ends, length, gram)
    anchor = anchor[start]
    turn = np.flatnonzero(np.diff(anchor)) + 1
    low, high = start[np.concatenate(([0], turn))], start[np.concatenate((turn - 1, [len(start) - 1]))]
    anchor = anchor[np.concatenate(([0], turn))]
    context = mix(span_hashes(codes, low, high + length) ^ mix(anchor - low + 1))
    # anchors are minima, so their hashes crowd at the low end: mixed once more they fill the ranges evenly
    return Anchors(anchor, low, high, mix(hashes[anchor]), context >> np.uint64(16), doc[anchor])


@dataclass
class Entries:
    """The distinct (anchor, context) pairs of a block in hash order; ``of`` leads from an occurrence to its pair."""

    of: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    order: np.ndarray
    many: np.ndarray


def entries(found: Anchors, order: np.ndarray) -> Entries:
    mine = order[found.doc]
    by = np.lexsort((mine, found.context, found.gram))
    g, c = found.gram[by], found.context[by]
    new = np.ones(len(by), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    return Entries(of, g[head], c[head], mine[by][head], np.diff(np.concatenate((head, [len(by)]))) > 1)


def hash_range(gram: np.ndarray, ranges: int) -> np.ndarray:
    return ((gram >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def make_blocks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(block, keys, order, ends, data): documents in blocks of about BLOCK_BYTES, as a table bucketed by block."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    slim = only(docs, *dict.fromkeys((key, text))).select(
        F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("__order"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, size
            keys = pa.concat_arrays([h[0] for h in held])
            order = np.concatenate([h[1] for h in held])
            ends = np.cumsum(np.concatenate([h[2] for h in held]))
            out = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                 pa.array([order], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
                 pa.array([pack.compress(b"".join(h[3] for h in held))], pa.binary())], names=["block", "keys", "order", "ends", "data"])
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            data, offsets = text_bytes(batch["__text"])
            order = batch["__order"].to_numpy()
            at = 0
            while at < batch.num_rows:  # as many documents as fill the block
                to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES - size)) if size < BLOCK_BYTES else at
                to = min(max(to, at + (size == 0)), batch.num_rows, at + BLOCK_DOCS)
                if to > at:
                    held.append((batch["__key"].slice(at, to - at), order[at:to], np.diff(offsets[at: to + 1]), data[offsets[at]: offsets[to]].tobytes()))
                    size += int(offsets[to] - offsets[at])
                if size >= BLOCK_BYTES or to < batch.num_rows or sum(len(h[0]) for h in held) >= BLOCK_DOCS:
                    yield block()
                at = to
        if held:
            yield block()

    made = slim.mapInArrow(run, f"block long, keys array<{kind.simpleString()}>, order array<long>, ends array<long>, data binary")
    name = f"tabloom_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "block").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


class Block:
    """One row of the block table, unpacked."""

    def __init__(self, batch: pa.RecordBatch, i: int, read: Callable[[np.ndarray, np.ndarray], Symbols]):
        self.number = batch["block"][i].as_py()
        self.keys = batch["keys"][i].values
        self.order = batch["order"][i].values.to_numpy()
        self.ends = batch["ends"][i].values.to_numpy()
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch["data"][i].as_py()), np.uint8)
        self.symbols = read(self.data, self.ends)


def _pack(e: Entries, a: int, b: int) -> bytes:
    g, c = e.gram[a:b], e.context[a:b]
    parts = [g.astype(np.uint32), (g >> np.uint64(32)).astype(np.uint8), c.astype(np.uint32), (c >> np.uint64(32)).astype(np.uint16),
             np.packbits(e.many[a:b])]
    base = int(e.order[a:b].min())
    wide = int(e.order[a:b].max()) - base >= 1 << 32
    parts.append((e.order[a:b] - base).astype(np.int64 if wide else np.uint32))
    return np.array([b - a, base, wide], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, base, wide = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    g = take(np.uint32, n).astype(np.uint64) | take(np.uint8, n).astype(np.uint64) << np.uint64(32)
    c = take(np.uint32, n).astype(np.uint64) | take(np.uint16, n).astype(np.uint64) << np.uint64(32)
    many = np.unpackbits(take(np.uint8, -(-n // 8)), count=n).astype(bool)
    return g, c, many, take(np.int64 if wide else np.uint32, n).astype(np.int64) + base


def answer(table: pa.Table, ordered: bool) -> pa.Table:
    """Codes for the entries of one hash range; see the head of this module."""
    parts = [_unpack(x.as_py()) for x in table["data"]]
    sizes = [len(p[0]) for p in parts]
    g, c, many, order = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((order, c, g))
    g, c = g[by], c[by]
    new_g = np.ones(len(by), bool)
    new_g[1:] = g[1:] != g[:-1]
    new_c = new_g.copy()
    new_c[1:] |= c[1:] != c[:-1]
    gid, cid = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
    crowded = (np.bincount(gid[new_c]) > 1)[gid]  # several contexts share the anchor
    if ordered:
        later = order[by] > order[by][new_c][cid]
        codes = np.where(later, 1, np.where(crowded, 2, 0))
    else:
        often = (np.bincount(cid, 1 + many[by]) > 1)[cid]
        codes = np.where(often, np.where(crowded & new_c, 3, 1), np.where(crowded, 2, 0))
    out = np.empty(len(by), np.uint8)
    out[by] = codes
    edges = np.cumsum([0, *sizes])
    return pa.table({"block": table["block"], "range": table["range"],
                     "codes": pa.array([out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})


class Repeats:
    """The exchange over one table of documents; ``read`` turns a block into symbols."""

    def __init__(self, docs: DataFrame, text: str, key: str, read: Callable, length: int, gram: int, ordered: bool):
        # a mask of 64 bits holds the windows of one anchor, so the anchors of longer windows grow with them
        gram = max(gram, length - MASK_BITS + 1)
        self.read, self.length, self.gram, self.ordered = read, length, gram, ordered
        self.key = StructField(key, docs.schema[key].dataType)
        self.blocks = make_blocks(docs, text, key)
        total = self.blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
        per_anchor = (length - gram + 2) / 2 * (6 if read is as_words else 1)
        self.ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / per_anchor / RANGE_ANCHORS) + 1)
        self.replies = self._answers()

    def _answers(self) -> DataFrame:
        read, length, gram, ranges, ordered = self.read, self.length, self.gram, self.ranges, self.ordered

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block(batch, i, read)
                    found = entries(anchors(block.symbols.codes, block.symbols.ends, length, gram), block.order)
                    if not len(found.gram):
                        continue
                    to = hash_range(found.gram, ranges)
                    head = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[head[:-1]], pa.int64()), pa.array([block.number] * (len(head) - 1), pa.int64()),
                         pa.array([_pack(found, a, b) for a, b in zip(head[:-1], head[1:])], pa.binary())], names=["range", "block", "data"])

        sent = self.blocks.mapInArrow(send, "range long, block long, data binary")
        answers = sent.groupBy("range").applyInArrow(lambda t: answer(t, ordered), "block long, range long, codes binary")
        return stored(answers.groupBy("block").agg(F.collect_list(F.struct("range", "codes")).alias("replies")))

    def _visit(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Anchors, Entries, np.ndarray, pa.RecordBatch, int]]:
        """Blocks with their anchors and the code of every occurrence."""
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, self.read)
                found = anchors(block.symbols.codes, block.symbols.ends, self.length, self.gram)
                kinds = entries(found, block.order)
                replies = sorted((r["range"], r["codes"]) for r in batch["replies"][i].as_py() or [])
                codes = np.frombuffer(b"".join(c for _, c in replies), np.uint8)
                yield block, found, kinds, codes, batch, i

    def contexts(self) -> DataFrame:
        """Contexts for the kernel: (gram, block, at, before, order, many, symbols); ``before`` symbols stand before the anchor."""
        me, length = self._task_side(), self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, found, kinds, codes, _, _ in me._visit(batches):
                code = codes[kinds.of]
                first = np.zeros(len(code), bool)
                # one occurrence of each pair: the earliest document's first
                by = np.lexsort((found.at, block.order[found.doc], kinds.of))
                first[by[np.concatenate(([True], np.diff(kinds.of[by]) > 0))] if len(by) else by] = True
                send = np.flatnonzero(first & (code >= 2))
                if not len(send):
                    continue
                a, b = found.low[send], found.high[send] + length
                s = block.symbols
                if s.starts_at is not None:
                    a, b = s.starts_at[a], s.ends_at[b - 1]
                raw = block.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.gram[send].astype(np.int64)), pa.array([block.number] * len(send), pa.int64()), pa.array(found.at[send], pa.int64()),
                     pa.array(found.at[send] - found.low[send], pa.int64()), pa.array(found.high[send] - found.low[send] + 1, pa.int64()),
                     pa.array(block.order[found.doc[send]], pa.int64()), pa.array(code[send] == 3, pa.bool_()),
                     pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())],
                    names=["gram", "block", "at", "before", "windows", "order", "many", "symbols"])

        joined = self.blocks.join(self.replies, "block")
        return stored(joined.mapInArrow(run, "gram long, block long, at long, before long, windows long, order long, many boolean, symbols binary"))

    def _task_side(self) -> Repeats:
        """The parameters alone, without tables, for use inside tasks."""
        twin = object.__new__(Repeats)
        twin.read, twin.length, twin.gram, twin.ordered = self.read, self.length, self.gram, self.ordered
        return twin

    def removed(self, masks: DataFrame, finish: Callable[[Block, np.ndarray], list[pa.Array]], columns: StructType) -> DataFrame:
        """What ``finish`` makes of every block and its removed symbols; ``masks`` has (block, at, mask) from the kernel,
        bit o of a mask standing for the window that begins o symbols before the anchor."""
        me, length, gram, ordered = self._task_side(), self.length, self.gram, self.ordered
        names = [f.name for f in columns.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, found, kinds, codes, batch, i in me._visit(batches):
                edge = np.zeros(len(block.symbols.codes) + 1, np.int64)
                if len(codes):
                    whole = codes[kinds.of] & 1 == 1
                    if ordered:  # a later document of the same block has an earlier one beside it
                        whole |= block.order[found.doc] > kinds.order[kinds.of]
                    np.add.at(edge, found.low[whole], 1)
                    np.add.at(edge, found.high[whole] + length, -1)
                marks = batch["masks"][i].as_py()
                if marks:
                    at = np.array([m["at"] for m in marks])
                    bits = np.array([m["mask"] for m in marks], np.int64)
                    # the mask belongs to one occurrence; its like in documents of equal order follow it
                    pair = np.searchsorted(found.at, at)
                    mask_of = np.zeros(len(kinds.gram), np.int64)
                    mask_of[kinds.of[pair]] = bits
                    every = mask_of[kinds.of]
                    if ordered:
                        every = np.where(block.order[found.doc] == kinds.order[kinds.of], every, 0)
                    for o in range(length - gram + 1):
                        begin = found.at[(every >> o) & 1 == 1] - o
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, begin + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                yield pa.RecordBatch.from_arrays([block.keys, *finish(block, gone)], names=names)

        packed = masks.where("mask <> 0").groupBy("block").agg(F.collect_list(F.struct("at", "mask")).alias("masks"))
        joined = self.blocks.join(self.replies, "block", "left").join(packed, "block", "left")
        return joined.mapInArrow(run, columns)


def binned(rows: DataFrame, name: str, bin_bytes: int) -> DataFrame:
    """``rows`` with a column __bin: groups by the hash of ``name``, of about ``bin_bytes`` symbols each."""
    total = rows.agg(F.sum(F.octet_length("symbols"))).first()[0] or 0
    bins = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bin_bytes))
    return rows.withColumn("__bin", F.pmod(F.xxhash64(name), F.lit(bins)))


def hot(rows: DataFrame, name: str, limit: int = HOT_BYTES) -> DataFrame:
    """The values of ``name`` whose contexts together exceed the limit."""
    return stored(rows.groupBy(name).agg(F.sum(F.octet_length("symbols")).alias("__b")).where(F.col("__b") > limit).select(name))


def by_window(rows: DataFrame, codes_of: Callable[[bytes], np.ndarray], length: int, ordered: bool) -> DataFrame:
    """The kernel's answer for contexts of one hot anchor, window by window: full-depth hashes counted by aggregation."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                codes = codes_of(batch["symbols"][i].as_py())
                start = np.arange(batch["windows"][i].as_py())
                for to, values in zip(out, (
                        span_hashes(codes, start, start + length), span_hashes(mix(codes), start, start + length),
                        np.full(len(start), batch["block"][i].as_py()), np.full(len(start), batch["at"][i].as_py()),
                        batch["before"][i].as_py() - start, np.full(len(start), batch["order"][i].as_py() if ordered else 1 + batch["many"][i].as_py()))):
                    to.append(values.astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["h1", "h2", "block", "at", "o", "value"])

    each = stored(rows.mapInArrow(explode, "h1 long, h2 long, block long, at long, o long, value long"))
    if ordered:
        seen = each.groupBy("h1", "h2").agg(F.min("value").alias("least"))
        hit = each.join(seen, ["h1", "h2"]).where("value > least")
    else:
        seen = each.groupBy("h1", "h2").agg(F.sum("value").alias("times")).where("times > 1")
        hit = each.join(seen, ["h1", "h2"])
    return hit.groupBy("block", "at").agg(F.expr("bit_or(shiftleft(1L, cast(o as int)))").alias("mask"))
