"""Scaling, label and one-hot encoding, and their inverses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.cells import argmax, softmax
from tabloom.functions.hashing import uniform
from tabloom.functions.names import col, strings
from tabloom.operators.cleaning import replaced
from tabloom.operators.duplicates import salted_join
from tabloom.session import consecutive

INLINE_CATEGORIES = 10_000


@dataclass
class Scaler:
    """Mean and population deviation per column; a deviation of 0 counts as 1."""

    stats: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return replaced(df, {
            c: (F.coalesce(col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()})


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Missing cells count as 0, in the fit as in the transform."""
    filled = {c: F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns}
    row = df.agg(*[e.alias(f"{t}{i}") for i, c in enumerate(columns) for t, e in (
        ("m", F.avg(filled[c])), ("s", F.stddev_pop(filled[c])))]).first()
    return Scaler({c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns) if row[f"m{i}"] is not None})


def categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category): distinct non-missing text values."""
    cells = [p for c in columns for p in (F.lit(c), col(c).cast("string"))]
    return df.select(F.stack(F.lit(len(columns)), *cells).alias("column", "category")).where(
        "category IS NOT NULL").distinct()


def numbered(values: DataFrame, name: str = "idx") -> DataFrame:
    """Position of every row in sorted order; the sort and the numbering both run in parallel."""
    return consecutive(values.orderBy(*values.columns), name)


def label_encode(df: DataFrame, column: str, key: str, out: str, unknown: str = "Unknown") -> DataFrame:
    """Alphabetical position of each label, missing ones as ``unknown``.

    Up to ``INLINE_CATEGORIES`` labels, which is counted first, are broadcast; more are numbered in parallel and joined with
    their hot labels spread.
    """
    marked = df.withColumn("__label", F.coalesce(col(column).cast("string"), F.lit(unknown)))
    values = marked.select("__label").distinct()
    found = [r[0] for r in values.limit(INLINE_CATEGORIES + 1).collect()]
    if len(found) <= INLINE_CATEGORIES:
        rows = [(v, i) for i, v in enumerate(sorted(found))]
        codes = F.broadcast(df.sparkSession.createDataFrame(rows, f"__label string, `{out}` int"))
        coded = marked.join(codes, "__label")
    else:
        coded = salted_join(marked, numbered(values).withColumn(out, F.col("idx").cast("int")).drop("idx"), ["__label"], key)
    return coded.drop("__label")


@dataclass
class OneHot:
    """Sorted categories per column, in column order."""

    table: dict[str, list[str]] = field(default_factory=dict)

    @property
    def fitted(self) -> bool:
        return bool(self.table)

    def known(self, column: str) -> list[str]:
        if not self.fitted:
            raise ValueError("fit the encoder before using it")
        if column not in self.table:
            raise ValueError(f"column {column} was not fitted")
        return self.table[column]

    def width(self, columns: Sequence[str] | None = None) -> int:
        """Total one-hot length; columns that were not fitted add nothing."""
        if not self.fitted:
            raise ValueError("fit the encoder before using it")
        return sum(len(self.table.get(c, ())) for c in (self.table if columns is None else columns))

    def index(self, column: str) -> Column:
        """Category position; an unseen or missing label takes position 0."""
        place = F.array_position(strings(self.known(column)), col(column).cast("string"))
        return F.greatest(F.coalesce(place, F.lit(0)) - 1, F.lit(0)).cast("int")

    def vector(self, column: str) -> Column:
        """One-hot ``array<double>``."""
        size, place = len(self.known(column)), self.index(column)
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == place).cast("double"))

    def transform(self, df: DataFrame, columns: Sequence[str], out: str = "onehot") -> DataFrame:
        return df.withColumn(out, F.concat(*[self.vector(c) for c in columns]))

    def label(self, column: str, place: Column) -> Column:
        return F.element_at(strings(self.known(column)), place.cast("int") + 1)

    def inverse(self, df: DataFrame, columns: Sequence[str], source: str = "onehot",
                sample_seed: int | None = None, key: str | None = None) -> DataFrame:
        """Labels from a stacked vector: by first maximum, or sampled by softmax weights when a seed and key are given."""
        start, new = 1, {}
        for c in columns:
            size = len(self.known(c))
            part = F.slice(F.col(source), start, size)
            if sample_seed is not None:
                part = gumbel(softmax(part), sample_seed, key, c)
            new[c] = self.label(c, argmax(part))
            start += size
        return replaced(df, new)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, i, v) for c, vs in self.table.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "column string, idx int, category string")

    @staticmethod
    def from_table(table: DataFrame, columns: Sequence[str]) -> OneHot:
        found: dict[str, list[str]] = {c: [] for c in columns}
        for r in table.orderBy("column", "idx").collect():
            if r["column"] in found:
                found[r["column"]].append(r["category"])
        return OneHot(found)


def gumbel(weights: Column, seed: int, key: str, column: str) -> Column:
    """Scores whose first maximum is a draw by ``weights`` (Gumbel-max)."""
    return F.transform(weights, lambda w, i: F.ln(w) - F.ln(-F.ln(uniform(seed, col(key), F.lit(column), i))))


def fit_one_hot(df: DataFrame, columns: Sequence[str], max_categories: int = INLINE_CATEGORIES) -> OneHot:
    """Categories of each column; more than ``max_categories`` is an error, as the encoded width would grow with the data."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    rows = categories(df, columns).limit(max_categories * len(columns) + 1).collect()
    table: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        table[r["column"]].append(r["category"])
    for c, vs in table.items():
        if len(vs) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories; sparse.fit_sparse takes any number")
        vs.sort()
    return OneHot(table)


def smoothed(vector: Column, clip: float) -> Column:
    """One-hot 0/1 to percentiles clip .. 1-clip."""
    return F.transform(vector, lambda v: v * F.lit(1 - 2 * clip) + F.lit(clip))


def unsmoothed(vector: Column, clip: float) -> Column:
    return F.transform(vector, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.lit(clip)) / F.lit(1 - 2 * clip))))
