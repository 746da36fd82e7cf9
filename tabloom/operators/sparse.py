"""One-hot encoding of any number of categories: a row holds the places of its ones, the dictionary is a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.names import col, strings
from tabloom.session import consecutive, cut_lineage

# A key is hot when it holds at least this share of the rows of its group, so a group has at most HOT_SHARE hot keys.
HOT_SHARE = 1_000


def looked_up(rows: DataFrame, dictionary: DataFrame, keys: Sequence[str], value: str, any_cold: bool = True) -> DataFrame:
    """Left join of ``rows`` to ``dictionary`` (``keys``, ``value``, ``hot``), NULL where a key is unknown or missing.

    Hot entries are broadcast (at most ``HOT_SHARE`` a group); only rows of other keys are shuffled.
    """
    hot = dictionary.where("hot").select(*keys, F.col(value).alias("__hot"))
    near = rows.join(F.broadcast(hot), [*keys], "left")
    if not any_cold:
        return near.withColumnRenamed("__hot", value)
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    settled = near.where(F.col("__hot").isNotNull() | missing).withColumnRenamed("__hot", value)
    rest = near.where(F.col("__hot").isNull() & ~missing).drop("__hot")
    return settled.unionByName(rest.join(dictionary.where("NOT hot").select(*keys, value), [*keys], "left"))


def with_heat(counted: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Add ``hot`` to a table of counts ``n``: the entries with at least 1 / ``HOT_SHARE`` of their group's sum."""
    if not group:
        total = counted.agg(F.sum("n")).first()[0] or 0
        return counted.withColumn("hot", F.col("n") * HOT_SHARE >= F.lit(total))
    totals = counted.groupBy(*group).agg(F.sum("n").alias("__total"))
    return counted.join(F.broadcast(totals), [*group]).withColumn("hot", F.col("n") * HOT_SHARE >= F.col("__total")).drop("__total")


@dataclass
class SparseOneHot:
    """``table``: (ci, category, n, hot, place), where ``place`` is the position of the one in the stacked vector of all
    columns: columns as given, categories sorted within each. ``spans``: first place and number of categories per column."""

    columns: list[str]
    table: DataFrame
    spans: dict[int, tuple[int, int]]
    any_cold: bool

    def width(self) -> int:
        """Length of the stacked vector; a column without a value adds nothing."""
        return sum(size for _, size in self.spans.values())

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """(key, column, place): one row per row and fitted column. An unseen or missing label takes the first category."""
        used = sorted(self.spans)
        if not used:
            return df.select(col(key)).where("false").withColumns({"column": F.lit(""), "place": F.lit(0).cast("bigint")})
        cells = [p for i in used for p in (F.lit(i), col(self.columns[i]).cast("string"))]
        long = df.select(col(key).alias("__key"), F.stack(F.lit(len(used)), *cells).alias("ci", "category"))
        found = looked_up(long, self.table, ["ci", "category"], "place", self.any_cold)
        first = F.element_at(F.array(*[F.lit(self.spans[i][0] if i in self.spans else -1).cast("bigint")
                                       for i in range(len(self.columns))]), F.col("ci") + 1)
        return found.select(col("__key").alias(key), F.element_at(strings(self.columns), F.col("ci") + 1).alias("column"),
                            F.coalesce("place", first).alias("place"))

    def inverse(self, encoded: DataFrame, key: str) -> DataFrame:
        """(key, column, category) of encoded rows; a place outside the vector has no category."""
        found = looked_up(encoded.select(col(key).alias("__key"), "column", "place"), self.table, ["place"], "category", self.any_cold)
        return found.select(col("__key").alias(key), "column", "category")


def fit_sparse(df: DataFrame, columns: Sequence[str]) -> SparseOneHot:
    """Categories and their counts from one aggregation, numbered in parallel; one row per column comes to the driver."""
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    cells = [p for i, c in enumerate(columns) for p in (F.lit(i), col(c).cast("string"))]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("ci", "category")).where("category IS NOT NULL")
    counted = cut_lineage(long.groupBy("ci", "category").agg(F.count("*").alias("n")))
    table = cut_lineage(consecutive(with_heat(counted, ["ci"]).orderBy("ci", "category"), "place"))
    facts = table.groupBy("ci").agg(F.min("place"), F.count("*"), F.bool_and("hot")).collect()
    return SparseOneHot(columns, table, {r[0]: (r[1], r[2]) for r in facts}, not all(r[3] for r in facts))


def indicator_correlation(encoded: DataFrame, key: str) -> DataFrame:
    """(a, b, n_both, corr): Pearson correlation of the 0/1 columns ``a`` < ``b`` that are 1 together in some row.

    Places of one column never meet, and all other pairs follow from their counts alone: with n rows
    corr = -sqrt(n_a n_b / ((n - n_a) (n - n_b))). A constant 0/1 column has correlation 0. ``key`` must be unique.
    """
    encoded = cut_lineage(encoded.select(col(key).alias("key"), "column", "place"))
    names = sorted(r[0] for r in encoded.select("column").distinct().collect())
    rows = encoded.select("key").distinct().count()
    counts = with_heat(cut_lineage(encoded.groupBy("place").agg(F.count("*").alias("n"))))
    if len(names) < 2:
        return encoded.sparkSession.createDataFrame([], "a bigint, b bigint, n_both bigint, corr double")
    wide = encoded.groupBy("key").agg(*[F.max(F.when(F.col("column") == c, F.col("place"))).alias(f"p{i}") for i, c in enumerate(names)])
    pairs = F.array(*[F.struct(F.least(f"p{i}", f"p{j}").alias("a"), F.greatest(f"p{i}", f"p{j}").alias("b"))
                      for i, j in combinations(range(len(names)), 2)])
    both = wide.select(F.explode(pairs).alias("e")).select("e.a", "e.b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    for side in "ab":
        both = looked_up(both, counts.withColumnsRenamed({"place": side, "n": f"n_{side}"}), [side], f"n_{side}")
    a, b, n = F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.lit(float(rows))
    spread = F.sqrt(a * (n - a)) * F.sqrt(b * (n - b))
    corr = F.when(spread > 0, (n * F.col("n_both") - a * b) / spread).otherwise(0.0)
    return both.select("a", "b", "n_both", corr.alias("corr"))
