"""From text cells to typed columns: tokens, coercion, groups, extremes, constants, rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.cells import DEFAULT_NA_TOKENS, NA_TOKENS, SPECIAL_TOKENS, finite, null_tokens, replace_tokens, to_number
from tabloom.functions.names import col
from tabloom.operators.quantiles import exact_quantiles

# Fixed value: meaning of the tokens of a zero-by-definition measurement.
ZERO_TOKEN_MEANING = {"NP": "0", "l": None}


def replaced(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Put expressions in place of columns (and append new names), order kept, names quoted."""
    kept = [(new[c] if c in new else col(c)).alias(c) for c in df.columns]
    added = [e.alias(c) for c, e in new.items() if c not in df.columns]
    return df.select(*kept, *added)


def mark_missing(df: DataFrame, columns: Sequence[str] | None = None, tokens: Sequence[str] = NA_TOKENS,
                 defaults: bool = True, trim: bool = True) -> DataFrame:
    """NULL for missing tokens in text columns."""
    text = {n for n, t in df.dtypes if t == "string"}
    chosen = [c for c in (df.columns if columns is None else columns) if c in text]
    every = tuple(tokens) + (DEFAULT_NA_TOKENS if defaults else ())
    return replaced(df, {c: null_tokens(col(c), every, trim) for c in chosen})


def apply_tokens(df: DataFrame, columns: Sequence[str], meaning: Mapping[str, str | None] = ZERO_TOKEN_MEANING) -> DataFrame:
    return replaced(df, {c: replace_tokens(col(c), meaning) for c in columns if c in df.columns})


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coerce to double; text that is no number becomes NULL."""
    kinds = dict(df.dtypes)
    return replaced(df, {c: to_number(col(c)) if kinds[c] == "string" else finite(col(c)) for c in columns if c in kinds})


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return replaced(df, {c: F.coalesce(col(c), F.lit(v)) for c, v in values.items()})


def with_group(df: DataFrame, column: str | None = None, name: str = "_group", unknown: str = "Unknown") -> DataFrame:
    """Group label of each row; the last column when none is named."""
    source = df.columns[-1] if column is None else column
    return df.withColumn(name, F.coalesce(col(source).cast("string"), F.lit(unknown)))


def group_sizes(df: DataFrame, group: str = "_group") -> DataFrame:
    return df.groupBy(col(group).alias("label")).agg(F.count("*").alias("n"))


def round_half_even(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return replaced(df, {c: F.bround(col(c), digits) for c in columns})


def null_above(df: DataFrame, columns: Sequence[str], p: float = 0.99) -> DataFrame:
    """NULL above the exact p-quantile of each column."""
    tops = exact_quantiles(df, {c: col(c) for c in columns}, [p])
    return replaced(df, {c: F.when(col(c) <= F.lit(tops[c][p]), col(c)) for c in columns if tops[c][p] is not None})


def null_outside(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """NULL outside [low, high] for the columns flagged for treatment."""
    return replaced(df, {c: F.when(col(c).between(lo, hi), col(c)) for c, (lo, hi) in bounds.items()})


def trim_range(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> tuple[float, float] | None:
    """[p_low, p_high] of a column, or the full range when fewer than two values would survive."""
    return trim_ranges(df, [column], low, high)[column]


def trim_ranges(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float] | None]:
    q = exact_quantiles(df, {c: col(c) for c in columns}, [0.0, low, high, 1.0])
    counts = df.agg(*[F.count_if(col(c).between(q[c][low], q[c][high])).alias(f"n{i}") if q[c][low] is not None
                      else F.lit(0).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    out: dict[str, tuple[float, float] | None] = {}
    for i, c in enumerate(columns):
        if q[c][low] is None:
            out[c] = None
        else:
            out[c] = (q[c][low], q[c][high]) if counts[i] >= 2 else (q[c][0.0], q[c][1.0])
    return out


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.where(~any_null(df.columns if columns is None else columns))


def incomplete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.where(any_null(df.columns if columns is None else columns))


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col(c).isNull() for c in columns])


def special_tokens(df: DataFrame, columns: Sequence[str] | None = None, tokens: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """(column, value, n) of text cells that spell a special token once trimmed."""
    text = [n for n, t in df.dtypes if t == "string" and (columns is None or n in columns)]
    cells = [p for c in text for p in (F.lit(c), F.when(F.trim(col(c)).isin(*tokens), col(c)))]
    long = df.select(F.stack(F.lit(len(text)), *cells).alias("column", "value")).where("value IS NOT NULL")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first rows by key: Spark keeps only n rows per task."""
    return df.orderBy(col(key)).limit(n)


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column)).where(col(column).isNotNull()).orderBy(col(column))
