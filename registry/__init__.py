"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is omitted where SQL cannot state the answer."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that the last bits of a sum do not decide a comparison."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), special.get(n, digits)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A projection given as SQL text that both engines read."""
    return df.selectExpr(*[f"{e} AS `{n}`" for n, e in columns.items()])


def view_sql(name: str, columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + f" FROM {name}"


def long_sql(relation: str, columns, extra: str = "") -> str:
    """(col, x) rows of a relation's columns, missing cells left out."""
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS col, CAST(\"{c}\" AS DOUBLE) AS x FROM {relation} WHERE \"{c}\" IS NOT NULL" for c in columns)
