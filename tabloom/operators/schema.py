"""Column roles: blank headers, ids, numeric against categorical, order and types."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tabloom.functions.cells import to_number
from tabloom.functions.names import col

log = logging.getLogger(__name__)

# Fixed value: generated names of blank header cells, as pandas and as Spark write them.
BLANK_HEADER = re.compile(r"^(Unnamed.*|_c[0-9]+|\s*)$")


def drop_blank_columns(df: DataFrame, anywhere: bool = False) -> DataFrame:
    """Drop columns without a header; ``anywhere`` also drops names that hold `Unnamed` further in."""
    gone = [c for c in df.columns if BLANK_HEADER.match(c) or (anywhere and "Unnamed" in c)]
    return df.select(*[col(c) for c in df.columns if c not in gone])


def drop_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in set(ids)])


def all_except(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(excluded)]


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist; the others are logged."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        log.warning("columns not found: %s", missing)
    return [c for c in wanted if c in df.columns]


def in_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in columns])


def first_columns(columns: Sequence[str], most: int | None = None) -> list[str]:
    return list(columns) if most is None else list(columns)[:most]


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, column string, type string")


def parse_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, filled, parsable) in one scan."""
    columns = df.columns if columns is None else list(columns)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}

    def as_number(c):
        return col(c) if c in numeric else to_number(col(c).cast("string"))

    wide = df.agg(*[e.alias(f"{t}{i}") for i, c in enumerate(columns)
                    for t, e in (("f", F.count(col(c))), ("p", F.count(as_number(c))))])
    cells = [p for i, c in enumerate(columns) for p in (F.lit(c), F.col(f"f{i}"), F.col(f"p{i}"))]
    return wide.select(F.stack(F.lit(len(columns)), *cells).alias("column", "filled", "parsable"))


def classify(df: DataFrame, columns: Sequence[str] | None = None, ids: Sequence[str] = (), share: float = 0.5,
             min_valid: int | None = None, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """(column, filled, parsable, kind): numeric above ``share`` parsable, or above ``min_valid`` parsable values."""
    counts = parse_counts(df, columns)
    parsable, filled = F.col("parsable"), F.col("filled")
    by_rule = parsable > min_valid if min_valid is not None else (filled > 0) & (parsable > filled * F.lit(share))
    kind = F.when(F.col("column").isin(*ids), "categorical") if ids else F.when(F.lit(False), "")
    for name, forced in (overrides or {}).items():
        kind = kind.when(F.col("column") == name, forced)
    return counts.withColumn("kind", kind.when(by_rule, "numeric").otherwise("categorical"))


def numeric_columns(df: DataFrame, ids: Sequence[str] = (), **rule) -> list[str]:
    """Names classified as numeric, in table order; one row per column comes back."""
    kinds = {r["column"]: r["kind"] for r in classify(df, ids=ids, **rule).collect()}
    return [c for c in df.columns if kinds[c] == "numeric"]
