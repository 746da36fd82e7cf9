"""Expressions on single cells: missing tokens, coercion, replacement, clipping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens read as missing on top of the reader defaults.
NA_TOKENS = ("_", "", " ", "NaN", "nan", "NA", "na", "N/A", "n/a")
# Tokens the usual CSV reader already takes as missing.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Tokens with a meaning of their own.
SPECIAL_TOKENS = ("NP", "l", "I", "L")
# Fixed value: decimal numbers only, so that Spark's `1d` and `1f` stay text.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def null_tokens(c: Column, tokens: Sequence[str] = NA_TOKENS + DEFAULT_NA_TOKENS, trim: bool = True) -> Column:
    """NULL for every missing token; ``trim`` drops leading blanks first, as the reader would."""
    shown = F.ltrim(c) if trim else c
    return F.when(~shown.isin(*sorted(set(tokens))), shown)


def to_number(c: Column) -> Column:
    """Double, or NULL where the text is no decimal number."""
    return finite(F.when(c.rlike(NUMBER_PATTERN), F.trim(c)).try_cast("double"))


def replace_tokens(c: Column, mapping: Mapping[str, str | None]) -> Column:
    """Exact-match replacement; a ``None`` target gives NULL."""
    branches = [(c == F.lit(k), F.lit(v).cast("string")) for k, v in mapping.items()]
    chain = reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0]))
    return chain.otherwise(c)


def clip(c: Column, low, high) -> Column:
    """Clamp to [low, high]; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def divide(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def pair_label(a: Column, b: Column, width: int = 20) -> Column:
    """Display label of two groups; shortened labels may collide, so it is never a key."""
    return F.concat(F.left(a, F.lit(width)), F.lit(" vs "), F.left(b, F.lit(width)))


def argmax(c: Column) -> Column:
    """0-based position of the first maximum of an array."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def softmax(c: Column) -> Column:
    """exp(v - max) / sum over an array."""
    raised = F.transform(c, lambda v: F.exp(v - F.array_max(c)))
    total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raised, lambda v: v / total)


def repair_nan(c: Column, low: float, high: float) -> Column:
    """The middle of the range where a decoded value is undefined."""
    return F.coalesce(F.when(~F.isnan(c), c), F.lit((low + high) / 2.0))
