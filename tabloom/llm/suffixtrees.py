"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are indexed at anchors (see :mod:`tabloom.llm.repeats`): any repeated window has a repeated anchor at the same
place. Contexts are split into memory-sized groups by the words that follow the anchor: a prefix of one word, made longer
(2, 4, 8, then the whole anchor) wherever a prefix has more contexts than a task should hold. Inside a group the suffixes
are sorted and their longest common prefixes give the subtree; a window that begins o words before its anchor is
repeated when its suffix shares a node at least length - o words deep with another suffix whose last o words on the left
agree as well. A single anchor with too many contexts is taken to the full depth of a window instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabloom.llm import repeats
from tabloom.llm.common import byte_codes, span_hashes, stored, word_spans
from tabloom.llm.repeats import Block, Repeats, as_words

LENGTH, ANCHOR = 35, 12
PREFIXES = (1, 2, 4, 8, ANCHOR)


def codes_of(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    a, b = word_spans(data)
    return span_hashes(byte_codes()[data], a, b)


def nodes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows of a symbol matrix and the common prefix of each row with the one before it."""
    order = np.lexsort(table.T[::-1])
    s = table[order]
    differs = s[1:] != s[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), table.shape[1])
    return order, np.concatenate(([0], common))


def subtree(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray, windows: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """Bit masks of the repeated windows of contexts flat[begin:end] whose anchor stands ``before`` symbols in."""
    m, wide = len(begin), int(before.max()) + 1
    anchor = begin + before

    def column(at: np.ndarray, valid: np.ndarray) -> np.ndarray:
        return np.where(valid, flat[np.where(valid, at, 0)], 0)

    right = np.stack([column(anchor + j, anchor + j < end) for j in range(length)], axis=1)
    left = np.stack([column(anchor - 1 - j, anchor - 1 - j >= begin) for j in range(max(1, wide - 1))], axis=1)
    (r_order, r_common), (l_order, l_common) = nodes(right), nodes(left)
    r_node, l_node = np.empty(m, np.int64), np.empty(m, np.int64)
    weight = 1 + many
    masks = np.zeros(m, np.int64)
    for o in range(wide):
        rows = np.flatnonzero((o <= before) & (o > before - windows))
        if len(rows) < 1:
            continue
        r_node[r_order] = np.cumsum(r_common < length - o)
        l_node[l_order] = np.cumsum(l_common < o) if o else 0
        _, leaf = np.unique(r_node[rows] * (m + 1) + l_node[rows], return_inverse=True)
        masks[rows] |= (np.bincount(leaf, weight[rows])[leaf] > 1).astype(np.int64) << o
    return masks


def kernel(table: pa.Table, length: int) -> pa.Table:
    parts = [codes_of(x.as_py()) for x in table["symbols"]]
    end = np.cumsum([len(p) for p in parts])
    before, windows = table["before"].to_numpy(), table["windows"].to_numpy()
    masks = subtree(np.concatenate(parts), end - [len(p) for p in parts], end, before, windows, table["many"].to_numpy(zero_copy_only=False), length)
    return pa.table({"block": table["block"], "at": table["at"], "mask": pa.array(masks, pa.int64())})


def _prefixed(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` with the hash of the first words after the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw, before in zip(batch["symbols"].to_pylist(), batch["before"].to_pylist()):
                codes = codes_of(raw)[before: before + words]
                found.append(int(span_hashes(codes, np.array([0]), np.array([len(codes)]))[0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns) if n != "prefix"], pa.array(found, pa.int64())],
                                             names=[n for n in batch.schema.names if n != "prefix"] + ["prefix"])

    fields = [f for f in rows.schema.fields if f.name != "prefix"]
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", prefix long")


def repeated_windows(contexts: DataFrame, length: int, bin_bytes: int, hot_bytes: int) -> DataFrame:
    rest, masks = contexts, None
    for words in PREFIXES:
        rows = stored(_prefixed(rest, words))
        heavy = repeats.hot(rows, "prefix", hot_bytes)
        full = bool(heavy.head(1))
        fits = rows.join(heavy, "prefix", "left_anti") if full else rows
        out = repeats.binned(fits, "prefix", bin_bytes).groupBy("__bin").applyInArrow(lambda t: kernel(t, length), "block long, at long, mask long")
        masks = out if masks is None else masks.unionByName(out)
        if not full:
            return masks
        rest = rows.join(heavy, "prefix", "left_semi")
    return masks.unionByName(repeats.by_window(rest, codes_of, length, ordered=False))


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR,
                 bin_bytes: int = repeats.BIN_BYTES, hot_bytes: int = repeats.HOT_BYTES) -> DataFrame:
    """(key, n_words, n_removed, kept): every word covered by a window of ``length`` words that starts anywhere else as well is removed.

    Windows are judged on the input. Null and empty texts have no words; texts shorter than a window keep all; repeated
    rows are documents like others, so both lose what they share; an empty table gives an empty result. ``kept`` is the
    kept words joined by one space. Other columns are ignored. A task holds a block of whole documents, so its memory
    grows with the longest one.
    """
    exchange = Repeats(docs, text, key, as_words, length, anchor, ordered=False)
    masks = repeated_windows(exchange.contexts(), length, bin_bytes, hot_bytes)

    def finish(block: Block, gone: np.ndarray) -> list[pa.Array]:
        s = block.symbols
        raw = block.data.tobytes()
        begin = np.concatenate(([0], s.ends[:-1]))
        left = np.concatenate(([0], np.cumsum(gone)))
        n = s.ends - begin
        texts = []
        for a, b in zip(begin.tolist(), s.ends.tolist()):
            keep = np.flatnonzero(~gone[a:b]) + a
            texts.append(b" ".join([raw[x:y] for x, y in zip(s.starts_at[keep].tolist(), s.ends_at[keep].tolist())]))
        return [pa.array(n, pa.int64()), pa.array(left[s.ends] - left[begin], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]

    return exchange.removed(masks, finish, StructType([
        exchange.key, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]))
