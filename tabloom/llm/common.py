"""Helpers that several operators share: column names, native word columns, vectorised word codes, stored tables."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

WHITE = " \t\n\u000b\f\r"
_WHITE_BYTE = np.zeros(256, bool)
_WHITE_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def worker_cache() -> dict:
    """What a Python worker keeps between its tasks. Functions travel by value, so a module's own globals would be new in each."""
    return sys.modules.setdefault("tabloom_worker_cache", types.ModuleType("tabloom_worker_cache")).__dict__


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from there, so that a lost executor costs a reread only."""
    return cut_lineage(df)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: whatever else a table carries cannot clash with the operator's own columns."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def packed(df: DataFrame, **names: str) -> DataFrame:
    """Whole rows as the struct ``row``, and the columns an operator reads under its own names: no other name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`").alias(n) for n, c in names.items()])


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def words(text: Column) -> Column:
    """Maximal runs of bytes other than ASCII white space; an empty array for null and blank text."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+"))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit codes (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of them."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for every span; equal spans hash alike wherever they lie."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_codes(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_WHITE_BYTE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else offsets
