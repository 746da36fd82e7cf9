"""Column names with blanks, dots, percent signs and slashes."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant(values: list, kind: str) -> Column:
    """A constant array as one folded literal, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def doubles(values) -> Column:
    return constant([None if v is None else float(v) for v in values], "double")


def longs(values) -> Column:
    return constant([int(v) for v in values], "bigint")


def strings(values) -> Column:
    return constant([str(v) for v in values], "string")
