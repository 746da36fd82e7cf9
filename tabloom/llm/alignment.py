"""Alignment of two tokenizers: byte offsets where tokens of both end cut a text into groups; overlapping tokens are linked.

A text is tokenised in byte ranges. What a range yields is an element of a monoid: an open prefix (tokens up to the first
common end), closed groups, and an open suffix (tokens behind the last common end). Composing two neighbours joins the
suffix of one with the prefix of the other and cuts that again, so any tree over the ranges gives the groups of the whole
text. Texts of one range are complete at once; the ranges of longer ones go to different tasks and are composed pairwise.

Ids lie in blocks of about a million tokens. Per block the distinct linked pairs are counted, the counts are summed by Spark
over all blocks, and every block gets the sums of its own pairs back: neither texts nor ids are shuffled for that.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import only, stored, worker_cache
from tabloom.session import shared_folder

#: A longer text is tokenised and cut in ranges of this size.
CHUNK_BYTES = 64 << 10
#: Tokens of both kinds in a block (a task holds some 150 bytes for each), and rows of it.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 20, 1 << 15
#: Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts tokenised together.
TEXTS = 512


# ---- the monoid -------------------------------------------------------------------------------------------------------

@dataclass
class Tokens:
    """Tokens of both kinds with the byte offsets where they end, and the offset where they begin."""

    at: int
    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def between(self, low: int, high: int) -> Tokens:
        i, j = np.searchsorted(self.a_ends, [low, high], "right")
        k, m = np.searchsorted(self.b_ends, [low, high], "right")
        return Tokens(low, self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])

    def then(self, other: Tokens) -> Tokens:
        return Tokens(self.at, *[np.concatenate((getattr(self, n), getattr(other, n))) for n in ("a", "a_ends", "b", "b_ends")])


@dataclass
class Fragment:
    """Open prefix, closed groups, open suffix; no suffix where no end is common."""

    prefix: Tokens
    closed: list[Tokens]
    suffix: Tokens | None


def fragment(tokens: Tokens) -> Fragment:
    common = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
    if not len(common):
        return Fragment(tokens, [], None)
    first, last, end = int(common[0]), int(common[-1]), (1 << 62)
    prefix = tokens.between(-1, first)
    prefix.at = tokens.at
    return Fragment(prefix, [tokens.between(first, last)] if last > first else [], tokens.between(last, end))


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of both ranges together; associative."""
    seam = fragment((x.prefix if x.suffix is None else x.suffix).then(y.prefix))
    closed = seam.closed
    if x.suffix is not None and seam.suffix is not None:
        closed = [seam.prefix, *closed]
    if y.suffix is not None:
        suffix = y.suffix
    elif seam.suffix is not None:
        suffix = seam.suffix
    else:
        suffix = None if x.suffix is None else seam.prefix
    return Fragment(seam.prefix if x.suffix is None else x.prefix, x.closed + closed + y.closed, suffix)


# ---- tokenizers -------------------------------------------------------------------------------------------------------

class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str, rank_path: str | None = None):
        import base64
        import os

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.slow = Tokenizer.from_file(byte_path)
        self.slow.encode_special_tokens = True
        # byte-level vocabularies write printable bytes as themselves and the others from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        entries = self.slow.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        #: No piece reaches over the start of a run of spaces, so a text may be cut there.
        self.divisible = not any(re.search(b"[^ ] ", n) for n in self.b_bytes)
        self.fast = None
        if rank_path:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
            if all(self.a_bytes[i] == token for token, i in ranks.items()):
                self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)
        # letters and spaces beyond these depend on a library's Unicode tables; long runs of spaces make its pattern backtrack
        self.odd, self.gap = re.compile("[^\x00-ɏ‐-…]"), re.compile(r"\s{64}")
        self.dtype = "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4"

    def encode_a(self, text: str) -> list[int]:
        if self.fast and not self.odd.search(text) and not self.gap.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def both(self, spaced: str) -> tuple[list[int], list[int]]:
        """Ids of a text that begins with a space; none where the tokens do not give its bytes."""
        a, b = self.encode_a(spaced), self.pieces.encode(spaced[1:])
        data = spaced.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return [], []
        return a, b

    def part(self, data: bytes, low: int, a_range: tuple[int, int], b_range: tuple[int, int]) -> tuple[Tokens, bool]:
        """Tokens of one range; ``data`` begins at byte ``low`` of the text."""
        one, two = (data[s - low: e - low] for s, e in (a_range, b_range))
        a = self.encode_a(one.decode()) if one else []
        b = self.pieces.encode(two[1:].decode()) if two else []
        good = b"".join([self.a_bytes[i] for i in a]) == one and b"".join([self.b_bytes[i] for i in b]) == two
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return Tokens(low, a, a_range[0] + np.cumsum(self.a_lengths[a]), b, b_range[0] + np.cumsum(self.b_lengths[b])), good


def pair_of(paths: tuple) -> Pair:
    """The tokenizers of this worker."""
    held = worker_cache()
    if ("pair", paths) not in held:
        held["pair", paths] = Pair(*paths)
    return held["pair", paths]


def borders(data: bytes, size: int, divisible: bool) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Ranges of a text in bytes, one for each tokenizer: each is cut where tokens end whatever stands before and behind.

    Those places are not the same for both, so a token of one may lie in another range than the tokens it overlaps.
    """
    places: list[list[int]] = [[0], [0]]
    for target in range(size, len(data), size):
        a = re.compile(rb"(?<=[!-~])[ \n]").search(data, target)
        b = re.compile(rb"(?<=[!-~]) (?=[!-~])").search(data, target) if divisible else None
        places[0].append(a.start() if a else len(data))
        places[1].append(b.start() if b else len(data))
    for p in places:
        p.append(len(data))
    a, b = places
    return [((a[i], a[i + 1]), (b[i], b[i + 1])) for i in range(len(a) - 1)]


# ---- blocks -----------------------------------------------------------------------------------------------------------

@dataclass
class Links:
    """Overlaps of tokens: every stretch between neighbouring ends of either kind lies in one token of each."""

    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cut: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    a_ends: np.ndarray


def links(a: np.ndarray, b: np.ndarray, pair: Pair) -> Links:
    """Links between two token sequences that spell the same bytes."""
    a_ends, b_ends = np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b])
    size = int(a_ends[-1]) + 1 if len(a) else 1
    in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
    in_a[a_ends] = True
    in_b[b_ends] = True
    ends = np.flatnonzero(in_a | in_b)
    of_a, of_b = in_a[ends], in_b[ends]
    return Links(ends, a[np.cumsum(of_a) - of_a], b[np.cumsum(of_b) - of_b], of_a & of_b, in_b[a_ends], in_a[b_ends], a_ends)


class Blocks:
    """Collects rows (row id, place in the text, ids) into blocks with their distinct linked pairs."""

    def __init__(self, pair: Pair, size: int, key_type: pa.DataType):
        self.pair, self.size, self.key_type = pair, size, key_type
        self.number = TaskContext.get().partitionId() << 33
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows, self.ids, self.tokens = [], [], ([], []), 0

    def add(self, key, row: int, at: int, a: list[int], b: list[int]) -> None:
        self.keys.append(key)
        self.rows.append((row, at, len(a), len(b)))
        for to, ids in zip(self.ids, (a, b)):
            to.append(np.array(ids, self.pair.dtype))
        self.tokens += len(a) + len(b)

    @property
    def full(self) -> bool:
        return self.tokens >= self.size or len(self.rows) >= BLOCK_ROWS

    def take(self) -> list:
        """The columns of one block."""
        a, b = (np.concatenate(x) for x in self.ids)
        found = links(a.astype(np.int64), b.astype(np.int64), self.pair)
        codes, counts = np.unique(found.a * len(self.pair.b_bytes) + found.b, return_counts=True)
        rows = np.array(self.rows, np.int64).T
        out = [pa.array([self.number], pa.int64()), pa.array([self.keys], pa.list_(self.key_type)), *[pa.array([x.tobytes()], pa.binary()) for x in (*rows, a, b)],
               pa.array([codes], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
        self.number += 1
        self.clear()
        return out


BLOCK_COLUMNS = ["block", "keys", "rows", "ats", "n_a", "n_b", "a", "b", "codes", "counts"]


def block_schema(kind: str) -> str:
    return f"block long, keys array<{kind}>, rows binary, ats binary, n_a binary, n_b binary, a binary, b binary, codes array<long>, counts array<long>"


def kept(df: DataFrame) -> DataFrame:
    """The blocks as a table bucketed by block, in the shared folder."""
    spark = df.sparkSession
    name = f"tabloom_tokens_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "block").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def digits(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..limit-1, left-aligned with one free column, and their number."""
    width = len(str(limit))
    text = np.array([str(i).ljust(width + 1) for i in range(limit)], f"S{width + 1}")
    table = text.view(np.uint8).reshape(limit, width + 1).copy()
    return table, np.array([len(str(i)) for i in range(limit)], np.int64)


def written(found: Links, a: np.ndarray, b: np.ndarray, row_ends: np.ndarray, table: np.ndarray, width: np.ndarray) -> pa.Array:
    """Every row's groups as ``a1,a2|b1;a3|b2``; ``row_ends`` counts the tokens of both kinds up to each row's end."""
    a_end, b_end = (np.concatenate(([0], np.flatnonzero(x) + 1)) for x in (found.a_last, found.b_last))
    at_a = np.arange(len(a)) + b_end[np.cumsum(found.a_last) - found.a_last]
    at_b = np.arange(len(b)) + a_end[np.cumsum(found.b_last) - found.b_last + 1]
    ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[at_a], ids[at_b] = a, b
    marks[at_a], marks[at_b] = np.where(found.a_last, ord("|"), ord(",")), np.where(found.b_last, ord(";"), ord(","))
    n = width[ids]
    size = n + 1
    size[row_ends[np.diff(row_ends, prepend=0) > 0] - 1] -= 1  # no mark behind a row's last group
    parts, step = [], 1 << 20
    columns = np.arange(table.shape[1])
    for i in range(0, len(ids), step):
        few = slice(i, i + step)
        block = table[ids[few]]
        block[np.arange(len(block)), n[few]] = marks[few]
        parts.append(block[columns < size[few, None]])
    ends = np.concatenate(([0], np.cumsum(size)))
    offsets = np.concatenate(([0], ends[row_ends])).astype(np.int32)
    return pa.StringArray.from_buffers(len(row_ends), pa.py_buffer(offsets), pa.py_buffer(np.concatenate(parts) if parts else np.zeros(0, np.uint8)))


# ---- the operator -----------------------------------------------------------------------------------------------------

SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_TOKENS = "struct<at:long,a:array<long>,a_ends:array<long>,b:array<long>,b_ends:array<long>>"
_FRAGMENT = f"row long, part int, good boolean, prefix {_TOKENS}, closed array<{_TOKENS}>, suffix {_TOKENS}"


def _struct(t: Tokens | None) -> dict | None:
    return None if t is None else {"at": t.at, **{n: getattr(t, n).tolist() for n in ("a", "a_ends", "b", "b_ends")}}


def _tokens(d: dict | None) -> Tokens | None:
    return None if d is None else Tokens(d["at"], *[np.array(d[n], np.int64) for n in ("a", "a_ends", "b", "b_ends")])


def _fragment_type() -> pa.Schema:
    ints = pa.list_(pa.int64())
    tokens = pa.struct([("at", pa.int64()), *[(n, ints) for n in ("a", "a_ends", "b", "b_ends")]])
    return pa.schema([("row", pa.int64()), ("part", pa.int32()), ("good", pa.bool_()), ("prefix", tokens), ("closed", pa.list_(tokens)), ("suffix", tokens)])


def tokenized(docs: DataFrame, paths: tuple, text: str, key: str, chunk_bytes: int, block_tokens: int) -> DataFrame:
    """Block rows of the texts of one range, and one row (row, key, part, ranges, data) for every range of longer ones."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(paths)
        row = TaskContext.get().partitionId() << 33
        blocks, none = None, None
        more = [("row", pa.int64()), ("part", pa.int32()), ("ranges", pa.list_(pa.int64())), ("data", pa.binary())]

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*blocks.take(), none, *[pa.nulls(1, t) for _, t in more]], names=[*BLOCK_COLUMNS, "key", *[n for n, _ in more]])

        for whole in batches:
            if blocks is None:
                blocks, none = Blocks(pair, block_tokens, whole["__key"].type), pa.nulls(1, whole["__key"].type)
            for first in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(first, TEXTS)
                long = []
                for key_of, value in zip(batch["__key"].to_pylist(), batch["__text"].to_pylist()):
                    row += 1
                    spaced = " " + (value or "")
                    if len(spaced) * 4 > chunk_bytes and len(data := spaced.encode()) > chunk_bytes:
                        for i, (one, two) in enumerate(borders(data, chunk_bytes, pair.divisible)):
                            low = min(one[0], two[0])
                            long.append((key_of, row, i, [low, *one, *two], data[low: max(one[1], two[1])]))
                        continue
                    blocks.add(key_of, row, 0, *(pair.both(spaced) if value else ([], [])))
                    if blocks.full:
                        yield block()
                if long:
                    keys, *columns = zip(*long)
                    n = len(keys)
                    kinds = [pa.int64(), pa.list_(whole["__key"].type), *[pa.binary()] * 6, *[pa.list_(pa.int64())] * 2]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.nulls(n, t) for t in kinds], pa.array(keys, whole["__key"].type), *[pa.array(c, t) for c, (_, t) in zip(columns, more)]],
                        names=[*BLOCK_COLUMNS, "key", *[n for n, _ in more]])
        if blocks is not None and blocks.rows:
            yield block()

    slim = only(docs, *dict.fromkeys((key, text))).select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    return kept(slim.mapInArrow(run, block_schema(kind) + f", key {kind}, row long, part int, ranges array<long>, data binary"))


def composed(chunks: DataFrame, paths: tuple) -> tuple[DataFrame, DataFrame]:
    """(row, at, a, b): closed groups of long texts, from their ranges by tree reduction; and (row) of the texts that both tokenizers spell."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(paths)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                low, a0, a1, b0, b1 = r["ranges"]
                tokens, good = pair.part(r["data"], low, (a0, a1), (b0, b1))
                f = fragment(tokens)
                out.append({"row": r["row"], "part": r["part"], "good": good, "prefix": _struct(f.prefix), "closed": [_struct(c) for c in f.closed], "suffix": _struct(f.suffix)})
            yield pa.RecordBatch.from_pylist(out, schema=_fragment_type())

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        first = rows[0]
        f = Fragment(_tokens(first["prefix"]), [], _tokens(first["suffix"]))
        for r in rows[1:]:
            f = compose(f, Fragment(_tokens(r["prefix"]), [], _tokens(r["suffix"])))
        return pa.Table.from_pylist([{"row": first["row"], "part": first["part"] // 2, "good": all(r["good"] for r in rows), "prefix": _struct(f.prefix),
                                      "closed": [_struct(c) for c in f.closed], "suffix": _struct(f.suffix)}], schema=_fragment_type())

    parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    state = stored(chunks.select("row", "part", "ranges", "data").repartition(parts, "row", "part").mapInArrow(cut, _FRAGMENT))
    rounds = [state]
    last = state.agg(F.max("part")).first()[0]
    while last > 0:
        # two neighbours a group; closed groups are left behind in the round's table
        state = stored(state.drop("closed").groupBy("row", F.floor(F.col("part") / 2).alias("__pair")).applyInArrow(merge, _FRAGMENT))
        rounds.append(state)
        last //= 2
    good = state.where("good").select("row")
    closed = [r.select("row", F.explode("closed").alias("c")) for r in rounds]
    # what stands before the first common end begins with the text and is a group; behind the last one nothing is left
    closed.append(state.select("row", F.col("prefix").alias("c")))
    every = closed[0]
    for more in closed[1:]:
        every = every.unionByName(more)
    return every.join(good, "row", "left_semi").select("row", F.col("c.at").alias("at"), F.col("c.a").alias("a"), F.col("c.b").alias("b")), good


def closed_blocks(parts: DataFrame, paths: tuple, block_tokens: int) -> DataFrame:
    """The closed groups of long texts as blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(pair_of(paths), block_tokens, pa.int64())
        for batch in batches:
            for r in batch.to_pylist():
                blocks.add(None, r["row"], r["at"], r["a"], r["b"])
                if blocks.full:
                    yield pa.RecordBatch.from_arrays(blocks.take(), names=BLOCK_COLUMNS)
        if blocks.rows:
            yield pa.RecordBatch.from_arrays(blocks.take(), names=BLOCK_COLUMNS)

    return kept(parts.mapInArrow(run, block_schema("long")))


def scored(blocks: DataFrame, pairs: DataFrame, paths: tuple, key: str, kind: str) -> DataFrame:
    """(key, row, at, sums, groups) of every row of the blocks."""
    wanted = blocks.select("block", F.explode("codes").alias("code"))
    answers = wanted.join(pairs, "code").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", "n", "best"))).alias("answers"))
    answers = answers.select("block", *[F.col(f"answers.{c}").alias(f"x_{c}") for c in ("n", "best")])
    joined = blocks.drop("counts").join(answers, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(paths)
        table, width = digits(max(len(pair.a_bytes), len(pair.b_bytes)))
        for batch in batches:
            for i in range(batch.num_rows):
                rows, ats, n_a, n_b = (np.frombuffer(batch[c][i].as_buffer(), np.int64) for c in ("rows", "ats", "n_a", "n_b"))
                a, b = (np.frombuffer(batch[c][i].as_buffer(), pair.dtype).astype(np.int64) for c in ("a", "b"))
                found = links(a, b, pair)
                codes = batch["codes"][i].values.to_numpy()
                place = np.searchsorted(codes, found.a * len(pair.b_bytes) + found.b)
                if len(codes):
                    count = batch["x_n"][i].values.to_numpy()[place]
                    best = batch["x_best"][i].values.to_numpy(zero_copy_only=False)[place]
                else:
                    count = best = place
                byte_ends = np.concatenate(([0], found.a_ends))[np.cumsum(n_a)]
                high = np.searchsorted(found.ends, byte_ends, "right")

                def total(values: np.ndarray) -> np.ndarray:
                    return np.diff(np.concatenate(([0], np.cumsum(values)))[high], prepend=0)

                groups = written(found, a, b, np.cumsum(n_a + n_b), table, width)
                out = [rows, ats, n_a, n_b, total(found.cut), np.diff(high, prepend=0), total(best), total(count)]
                yield pa.RecordBatch.from_arrays(
                    [batch["keys"][i].values, *[pa.array(np.asarray(x, np.int64)) for x in out], groups], names=["key", "row", "at", *SUMS, "groups"])

    out = joined.mapInArrow(run, f"key {kind}, row long, at long, " + ", ".join(f"{s} long" for s in SUMS) + ", groups string")
    return out.select(F.col("key").alias(key), "row", "at", *SUMS, "groups")


def align(docs: DataFrame, byte_path: str, piece_path: str, rank_path: str | None = None, text: str = "text", key: str = "doc_id",
          chunk_bytes: int = CHUNK_BYTES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is ``a1,a2|b1;a3|b2``; a linked pair's count is over all rows, and it is the best of its B id where no other
    pair of that id has a higher count (ties included). ``rank_path`` names the same byte-level vocabulary as ranks; it is
    used where it is proven equal, and only for texts without characters whose class depends on a library's tables.

    Null and empty texts, and texts that either tokenizer does not spell byte for byte, have no tokens: zeros and an empty
    string. Rows with equal or null keys stay rows of their own, repeated rows count each. An empty table gives none.
    Other columns are ignored.
    """
    paths = (byte_path, piece_path, rank_path)
    kind = docs.schema[key].dataType.simpleString()
    table = tokenized(docs, paths, text, key, chunk_bytes, block_tokens)
    blocks = table.where("block IS NOT NULL").select(*BLOCK_COLUMNS)
    chunks = table.where("block IS NULL")
    counted = blocks.select(F.explode(F.arrays_zip("codes", "counts")).alias("x"))
    ranged = bool(chunks.select("row").head(1))
    if ranged:
        parts, good = composed(chunks, paths)
        extra = closed_blocks(parts, paths, block_tokens)
        counted = counted.unionByName(extra.select(F.explode(F.arrays_zip("codes", "counts")).alias("x")))
    n_b = piece_count(piece_path)
    sums = stored(counted.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.counts").alias("n")))
    b_id = F.pmod("code", F.lit(n_b).cast("long"))
    # one row per id of the second vocabulary at most
    top = F.broadcast(sums.groupBy(b_id.alias("__b")).agg(F.max("n").alias("__top")))
    pairs = sums.join(top, b_id == F.col("__b")).select("code", "n", (F.col("n") == F.col("__top")).alias("best"))
    out = scored(blocks, pairs, paths, key, kind).drop("row", "at")
    if ranged:
        rows = scored(extra, pairs, paths, "__none", "long").groupBy("row").agg(
            *[F.sum(s).alias(s) for s in SUMS], F.array_sort(F.collect_list(F.struct("at", "groups"))).alias("__parts"))
        heads = chunks.where("part = 0").select(F.col("key").alias(key), "row")
        whole = heads.join(rows, "row", "left").select(
            key, *[F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in SUMS], F.coalesce(F.array_join("__parts.groups", ";"), F.lit("")).alias("groups"))
        out = out.unionByName(whole)
    return out


def piece_count(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
