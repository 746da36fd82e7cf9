"""Packing along a space-filling curve: hashed document vectors are projected to a few dimensions, ordered by Hilbert key, cut into sequences.

Documents lie end to end along the curve and are cut wherever a sequence is full, so that every sequence but the last
few is full; the remainder at the end of the curve is written as sequences whose lengths are powers of two, which need
no padding. Token ids travel as 16-bit numbers (32-bit for larger vocabularies).
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import only, stored, text_bytes, worker_cache

END_ID = 2
LENGTH = 4096
#: Hashed features of a document vector, projected dimensions, and bits of each coordinate of the curve.
FEATURES, DIMENSIONS, BITS = 1 << 10, 4, 12
#: Known pieces, and parts of pieces, in each of two generations (some 150 bytes each); texts tokenised together.
CACHE_WORDS, CACHE_PARTS, TEXTS = 250_000, 250_000, 256
#: White space and the pattern of pieces, as the vocabulary's own file has them.
RULES = (r"\s+", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, d) with coordinates below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(up, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[d - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Generations(dict):
    """Known values of two generations: when this one is full, :meth:`young` starts another that looks here first."""

    def __init__(self, old: dict, most: int):
        super().__init__()
        self.old, self.most = old, most

    def __missing__(self, name: bytes) -> bytes:
        found = self.old.get(name)
        if found is None:
            found = self.made(name)
        self[name] = found
        return found


class Parts(Generations):
    """Ids of parts that the pattern does not split further, lower-cased, by the vocabulary's merges."""

    def __init__(self, tokenizer, dtype: str, old: dict | None = None):
        super().__init__({} if old is None else old, CACHE_PARTS)
        self.tokenizer, self.dtype, self.merge = tokenizer, dtype, tokenizer.model.tokenize
        self.code = "H" if dtype == "<u2" else "I"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [i for i in range(256) if i not in set(shown)]
        self.signs = {b: 256 + i for i, b in enumerate(hidden)}

    def made(self, part: bytes) -> bytes:
        text = part.decode() if part.isascii() else part.decode("latin-1").translate(self.signs)
        return array(self.code, [t.id for t in self.merge(text)]).tobytes()

    def young(self) -> Parts:
        if len(self) < self.most:
            return self
        self.old = {}
        return Parts(self.tokenizer, self.dtype, self)


class Words(Generations):
    """Token ids of white-space separated pieces, as bytes. A missing piece is tokenised when it is asked for.

    Pieces of plain letters and signs are put together from their parts; the tokenizer's own normalising and splitting,
    which cost more than the merging, come down to ``lower`` and one pattern for them. All others go through the tokenizer.
    """

    def __init__(self, tokenizer, dtype: str, old: dict | None = None, parts: Parts | None = None):
        super().__init__({} if old is None else old, CACHE_WORDS)
        self.tokenizer, self.dtype = tokenizer, dtype
        self.parts = Parts(tokenizer, dtype) if parts is None else parts
        # where case and classes are the same in every library: signs, digits and letters up to U+017F but U+0130
        self.plain = re.compile("[!-~À-įı-ſ]+").fullmatch
        self.split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^a-zÀ-ÖØ-öø-ſ0-9]+").findall
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)").search

    def made(self, piece: bytes) -> bytes:
        if piece.isalpha():  # of bytes: ASCII letters
            return self.parts[piece.lower()]
        text = piece.decode()
        if self.plain(text) and not self.added(text):
            found = self.split(text.lower())
            if len(found) == 1:
                return self.parts[found[0].encode()]
            return b"".join([self.parts[p.encode()] for p in found])
        return array(self.parts.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def young(self) -> Words:
        self.parts = self.parts.young()
        if len(self) < self.most:
            return self
        self.old = {}
        return Words(self.tokenizer, self.dtype, self, self.parts)


class Whole:
    """Token ids of whole texts, for tokenizers that do not split and normalise by :data:`RULES`."""

    def __init__(self, tokenizer, dtype: str):
        self.tokenizer, self.dtype = tokenizer, dtype

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]


def by_pieces(tokenizer) -> bool:
    """Whether the tokenizer lower-cases and then splits by :data:`RULES`: no token then crosses white space."""
    config = json.loads(tokenizer.to_str())
    normal, split = config["normalizer"] or {}, config["pre_tokenizer"] or {}
    steps, parts = normal.get("normalizers", []), split.get("pretokenizers", [])
    added = tokenizer.get_added_tokens_decoder().values()
    return (not any(t.lstrip or t.rstrip or regex.search(RULES[0], t.content) for t in added) and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": RULES[0]} and steps[1]["content"] == " "
            and [s["type"] for s in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": RULES[1]} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
            and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"])


def id_type(tokenizer_path: str) -> str:
    """16 or 32 bits an id, as the vocabulary needs."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """(key, curve, n_tokens, ids): a text's token ids with the closing id, and its Hilbert key. Null text is empty."""
    field = docs.schema[key]
    dtype = id_type(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        held, name = worker_cache(), ("pieces", tokenizer_path)
        if name not in held:
            tokenizer = Tokenizer.from_file(tokenizer_path)
            held[name] = Words(tokenizer, dtype) if by_pieces(tokenizer) else Whole(tokenizer, dtype)
        random = np.random.default_rng(11)
        most = 1 << 16 if dtype == "<u2" else Tokenizer.from_file(tokenizer_path).get_vocab_size()
        bucket = random.integers(0, FEATURES, most)
        sign = random.choice([-1.0, 1.0], most)
        directions = random.normal(size=(FEATURES, DIMENSIONS))
        last = np.array([end_id], dtype).tobytes()
        for whole, first in ((w, i) for w in batches for i in range(0, w.num_rows, TEXTS)):
            batch = whole.slice(first, TEXTS)
            counts, vectors = [], []
            data, offsets = text_bytes(batch["__text"])
            texts = [data[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            known = held[name]
            if isinstance(known, dict):
                of = known.__getitem__
                blobs = [b"".join(map(of, t.split())) + last for t in texts]
                held[name] = known.young()
            else:
                blobs = [ids + last for ids in known(texts)]
            for ids in blobs:
                codes = np.frombuffer(ids, dtype)[:-1]
                counts.append(len(codes) + 1)
                # signed counts of hashed tokens, damped, brought to unit length and projected
                v = np.bincount(bucket[codes], sign[codes], FEATURES)
                v = np.sign(v) * np.log1p(np.abs(v))
                vectors.append(v @ directions / max(1e-9, float(np.sqrt(v @ v))))
            points = np.clip((0.5 + np.arctan(np.array(vectors).reshape(-1, DIMENSIONS)) / np.pi) * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(hilbert_keys(points), pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                names=["__key", "__curve", "__n", "__ids"])

    return only(docs, *dict.fromkeys((key, text))).select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).mapInArrow(
        run, f"__key {field.dataType.simpleString()}, __curve long, __n long, __ids binary")


def pieces_of(start: int, n: int, total: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start in document, length, sequence, offset) of the pieces of n tokens that begin at ``start`` of the whole curve."""
    full = total // length
    out, at = [], start
    while at < start + n:
        if at < full * length:
            seq, begin, end = at // length, at // length * length, (at // length + 1) * length
        else:  # the remainder: one sequence for each binary digit, largest first
            seq, begin, rest = full, full * length, total - full * length
            while True:
                size = 1 << (rest.bit_length() - 1)
                if at < begin + size:
                    end = begin + size
                    break
                begin, rest, seq = begin + size, rest - size, seq + 1
        stop = min(end, start + n)
        out.append((at - start, stop - at, seq, at - begin))
        at = stop
    return out


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve key.

    Null and empty texts are one closing id. Equal texts share a curve key and lie in order of their keys; rows with
    equal keys are packed each for itself. An empty table gives no pieces. Other columns are ignored. ``with_ids`` adds
    each piece's ids as an array.
    """
    spark, dtype = docs.sparkSession, id_type(tokenizer_path)
    tokens = stored(tokenize(docs, tokenizer_path, text, key, end_id))  # ranges are sampled from a table, texts are tokenised once
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("__ids")
    along = tokens.withColumn("__tie", tie).repartitionByRange(parts, "__curve", "__key", "__tie").sortWithinPartitions("__curve", "__key", "__tie")
    names = tokens.columns
    schema = "__part int, __begin long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema.fields)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            n = batch["__n"].to_numpy()
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch["__part"], pa.array(begin, pa.int64()), *[batch[c] for c in names]], names=["__part", "__begin", *names])

    along = along.select(F.spark_partition_id().alias("__part"), *names)
    laid = stored(along.mapInArrow(lay, schema))
    # one row per partition: as many as there are shuffle partitions
    ends = laid.groupBy("__part").agg(F.sum("__n").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__first"),
                       F.sum("__sum").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"))
    key_type = tokens.schema["__key"].dataType.simpleString()
    out_schema = (f"`{key}` {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long"
                  + (", ids array<int>" if with_ids else ""))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            take, texts = [], []
            columns = [batch[c].to_pylist() for c in ("__begin", "__first", "__total", "__n")]
            for i, (begin, first, total, n) in enumerate(zip(*columns)):
                ids = np.frombuffer(batch["__ids"][i].as_buffer(), dtype).astype("<u4")
                for start, size, seq, offset in pieces_of(begin + first, n, total, length):
                    piece = ids[start: start + size]
                    for to, value in zip(rows, (start, size, zlib.crc32(piece.tobytes()), n, seq, offset)):
                        to.append(value)
                    take.append(i)
                    if with_ids:
                        texts.append(piece.astype(np.int32).tolist())
            index = pa.array(take, pa.int64())
            arrays = [batch["__key"].take(index), *[pa.array(c, pa.int64()) for c in rows], batch["__curve"].take(index)]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(texts, pa.list_(pa.int32()))] if with_ids else []),
                                             names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"] + ["ids"] * with_ids)

    return laid.join(F.broadcast(ends), "__part").mapInArrow(cut, out_schema)
