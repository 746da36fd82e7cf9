"""Substring dedup by column-wise construction of a collection's Burrows-Wheeler transform, over UTF-8 bytes.

The collections are contexts of repeated anchors (see :mod:`tabloom.llm.repeats`), dealt by anchor into memory-sized
groups that lie in tables of the shared folder. Inside a group every round inserts one symbol of every context, from its
end to its start: the transform so far says where the longer suffix belongs, and the common prefixes with both new
neighbours are updated. Once a context has been read to its start, suffixes that share a window's length lie side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tabloom.llm import repeats
from tabloom.llm.common import byte_codes
from tabloom.llm.repeats import Block, Repeats, as_bytes

LENGTH, ANCHOR = 50, 20
#: One collection's symbols: a round reads its whole transform.
COLLECTION_BYTES = 2 << 20


class Collection:
    """The growing transform: per sorted suffix its preceding symbol, document, length, and whether it shares ``depth`` symbols with the one before."""

    def __init__(self, texts: list[np.ndarray], depth: int):
        self.depth, self.m = depth, len(texts)
        self.sizes = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        alphabet, flat = np.unique(flat, return_inverse=True)
        self.flat = (flat + 1).astype(np.uint8 if len(alphabet) < 256 else np.uint16)  # 0 marks a symbol not yet known and a context's start
        self.ends = np.cumsum(self.sizes)
        self.before = np.zeros(self.m, self.flat.dtype)
        self.doc = np.arange(self.m, dtype=np.int32)
        self.length = np.zeros(self.m, np.int16 if self.sizes.max() < 1 << 15 else np.int32)
        self.shared = np.zeros(self.m, bool)
        self.place = np.arange(self.m)

    def insert(self, round_: int) -> None:
        """One symbol of every context that has one left, ``round_`` symbols from its end."""
        docs = np.flatnonzero(self.sizes >= round_)
        at = self.place[docs]
        self.before[at] = self.flat[self.ends[docs] - round_]
        rank = np.empty(len(self.before), np.int64)
        rank[np.argsort(self.before, kind="stable")] = np.arange(len(self.before))
        new = self.m + rank[at] - np.count_nonzero(self.before == 0)
        old = np.ones(len(self.before) + len(docs), bool)
        old[new] = False
        for name, value in (("before", 0), ("doc", docs), ("length", round_), ("shared", False)):
            have = getattr(self, name)
            grown = np.empty(len(old), have.dtype)
            grown[old] = have
            grown[new] = value
            setattr(self, name, grown)
        self.place[docs] = new
        if round_ >= self.depth:
            self._compare(new)
            self._compare(new[new + 1 < len(old)] + 1)

    def _compare(self, at: np.ndarray) -> None:
        """Update the common prefixes of the suffixes at these places with the ones before them."""
        at = at[(self.length[at] >= self.depth) & (self.length[at - 1] >= self.depth)]
        start = self.ends[self.doc[at]] - self.length[at]
        other = self.ends[self.doc[at - 1]] - self.length[at - 1]
        same = np.ones(len(at), bool)
        for j in range(self.depth):
            if j % 10 == 0:
                live = np.flatnonzero(same)
            same[live] &= self.flat[start[live] + j] == self.flat[other[live] + j]
        self.shared[at] = same

    def build(self) -> Collection:
        for round_ in range(1, int(self.sizes.max()) + 1):
            self.insert(round_)
        return self


def kernel(table: pa.Table, length: int) -> pa.Table:
    """Masks of the windows that also stand in a context of smaller order."""
    texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["symbols"]]
    order, before = table["order"].to_numpy(), table["before"].to_numpy()
    c = Collection(texts, length).build()
    full = np.flatnonzero(c.length >= length)
    # neighbours in sorted order that share a window belong to one node; suffixes too short for one lie between nodes only
    node = np.cumsum(~c.shared[full])
    mine = order[c.doc[full]]
    least = np.full(int(node[-1]) + 1 if len(node) else 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, mine)
    hit = mine > least[node]
    doc = c.doc[full][hit]
    offset = before[doc] - (c.sizes[doc] - c.length[full][hit])
    masks = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(masks, doc, np.int64(1) << offset)
    return pa.table({"block": table["block"], "at": table["at"], "mask": pa.array(masks, pa.int64())})


def codes_of(raw: bytes) -> np.ndarray:
    return byte_codes()[np.frombuffer(raw, np.uint8)]


def repeated_windows(contexts: DataFrame, length: int, bin_bytes: int, hot_bytes: int) -> DataFrame:
    heavy = repeats.hot(contexts, "gram", hot_bytes)
    full = bool(heavy.head(1))
    fits = contexts.join(heavy, "gram", "left_anti") if full else contexts
    masks = repeats.binned(fits, "gram", bin_bytes).groupBy("__bin").applyInArrow(lambda t: kernel(t, length), "block long, at long, mask long")
    if full:
        masks = masks.unionByName(repeats.by_window(contexts.join(heavy, "gram", "left_semi"), codes_of, length, ordered=True))
    return masks


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR,
                 bin_bytes: int = COLLECTION_BYTES, hot_bytes: int = repeats.HOT_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept): every byte covered by a ``length``-byte string that also starts in a document of smaller key is removed.

    Keys are integers; a null key counts as the largest. Rows of equal key do not precede one another. Strings are judged
    on the input. Null and empty texts have no bytes; an empty table gives an empty result. ``spans`` are the maximal
    removed runs (start, end), ``kept`` the remaining bytes, which may end inside a character. Other columns are ignored.
    A task holds a block of whole documents, so its memory grows with the longest one.
    """
    exchange = Repeats(docs, text, key, as_bytes, length, anchor, ordered=True)
    masks = repeated_windows(exchange.contexts(), length, bin_bytes, hot_bytes)

    def finish(block: Block, gone: np.ndarray) -> list[pa.Array]:
        begin = np.concatenate(([0], block.ends[:-1]))
        sums = np.concatenate(([0], np.cumsum(gone)))
        removed = sums[block.ends] - sums[begin]
        spans, texts = [], []
        for a, b, n in zip(begin.tolist(), block.ends.tolist(), removed.tolist()):
            if not n:
                spans.append([])
                texts.append(block.data[a:b].tobytes())
                continue
            step = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:b].view(np.int8), [0]))))
            spans.append([{"start": int(x), "end": int(y)} for x, y in step.reshape(-1, 2)])
            texts.append(block.data[a:b][~gone[a:b]].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(block.ends - begin, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.binary())]

    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    return exchange.removed(masks, finish, StructType([
        exchange.key, StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("spans", span), StructField("kept", BinaryType())]))
