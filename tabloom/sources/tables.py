"""Reading dirty CSV and writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.cells import NA_TOKENS
from tabloom.functions.names import col
from tabloom.operators.cleaning import mark_missing
from tabloom.operators.schema import drop_blank_columns
from tabloom.session import consecutive


def read_dirty_csv(spark: SparkSession, path: str, tokens: Sequence[str] = NA_TOKENS, defaults: bool = True,
                   trim: bool = True, keep_blank_headers: bool = False) -> DataFrame:
    """All-text scan; every missing token is NULL. No schema inference, so the files are read once.

    ``tokens=()`` gives the plain reader, in which `_` survives as text.
    """
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", trim).option("escape", '"')
    df = mark_missing(reader.csv(path), tokens=tokens, defaults=defaults, trim=trim)
    return df if keep_blank_headers else drop_blank_columns(df)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cells are written as they are, outer blanks included."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Consecutive ids in read order, fixed once by writing the table out."""
    if name in df.columns:
        return df
    return consecutive(df, name).select(col(name), *[col(c) for c in df.columns])


def result_document(sections: Mapping[str, DataFrame], key: str = "column") -> DataFrame:
    """One JSON row (section -> key -> statistics); a key with several rows in its section has an array of them."""
    parts = []
    for name, table in sections.items():
        body = F.struct(*[col(c) for c in table.columns if c != key])
        entry = F.struct("key", "value") if key in table.columns else None
        if entry is not None:
            each = table.select(col(key).cast("string").alias("key"), F.to_json(body).alias("value"))
            several = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]"))
            table = each.groupBy("key").agg(F.when(F.count("*") == 1, F.min("value")).otherwise(several).alias("value"))
        if entry is None:
            text = F.to_json(F.first(body))
        else:
            pairs = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(
                F.regexp_extract(F.to_json(F.struct(e["key"].alias("k"))), r'^\{"k":(.*)\}$', 1), F.lit(":"), e["value"]))
            text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
        parts.append(table.agg(text.alias("body")).select(F.lit(name).alias("section"), "body"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))),
                        lambda e: F.concat(F.lit('"'), e["section"], F.lit('":'), e["body"]))
    return out.agg(F.concat(F.lit("{"), F.array_join(whole, ","), F.lit("}")).alias("document"))


def write_document(sections: Mapping[str, DataFrame], path: str) -> None:
    result_document(sections).write.mode("overwrite").text(path)


def facts_of(section: str, table: DataFrame, key: Sequence[str] = ("column",)) -> DataFrame:
    """(section, subject, fact, value): any summary table as text facts for a report."""
    keys = [k for k in key if k in table.columns]
    subject = F.concat_ws(" / ", *[col(k).cast("string") for k in keys]) if keys else F.lit("table")
    values = [c for c in table.columns if c not in keys]
    kinds = dict(table.dtypes)
    cells = [p for c in values for p in (
        F.lit(c), F.concat_ws(",", col(c)) if kinds[c].startswith("array") else col(c).cast("string"))]
    return table.select(F.lit(section).alias("section"), subject.alias("subject"), F.stack(F.lit(len(values)), *cells).alias("fact", "value"))
