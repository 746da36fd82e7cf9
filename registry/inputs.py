"""Derived inputs as SQL text: the driver's tables hold no missing cells, so gaps and dirt are made from the keys."""

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def dirty(key: str, value: str) -> str:
    return (f"CASE WHEN {key} % 11 = 0 THEN '_' WHEN {key} % 13 = 0 THEN 'NP' WHEN {key} % 17 = 0 THEN 'l' "
            f"WHEN {key} % 19 = 0 THEN ' n/a' ELSE CAST(CAST(floor({value}) AS INT) AS STRING) END")


def nulled(key: str, m: int, r: int, value: str) -> str:
    return f"CASE WHEN {key} % {m} = {r} THEN NULL ELSE {value} END"


# Text table with many spellings of "missing", special tokens, an id and a label.
DIRTY_PART = {
    "p_partkey": "p_partkey",
    "retail %": dirty("p_partkey", "p_retailprice"),
    "size %": "CASE WHEN p_partkey % 23 = 0 THEN 'NP' WHEN p_partkey % 29 = 0 THEN ' l ' ELSE CAST(p_size AS STRING) END",
    "rare": "CASE WHEN p_partkey % 10 < 6 THEN 'NA' ELSE CAST(p_size AS STRING) END",
    "third": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS STRING) END",
    "seventh": "CASE WHEN p_partkey % 7 = 1 THEN 'nan' ELSE CAST(CAST(floor(p_retailprice) AS INT) AS STRING) END",
    "twentieth": "CASE WHEN p_partkey % 20 = 2 THEN 'N/A' ELSE CAST(p_size AS STRING) END",
    "p_brand": "CASE WHEN p_partkey % 25 = 3 THEN '_' ELSE p_brand END",
    "p_type": "p_type",
}
DIRTY_NAMES = [c for c in DIRTY_PART if c != "p_partkey"]

# Numeric table with gaps of different sizes.
GAPPY_PART = {
    "p_partkey": "p_partkey",
    "size": nulled("p_partkey", 7, 1, "CAST(p_size AS DOUBLE)"),
    "retail": nulled("p_partkey", 20, 2, "p_retailprice"),
    "letters": nulled("p_partkey", 3, 0, "CAST(length(p_name) AS DOUBLE)"),
    "mix": "CAST(p_size AS DOUBLE) * 2 + p_retailprice / 10",
    "p_type": nulled("p_partkey", 25, 4, "p_type"),
}
GAPS = ["size", "retail", "letters", "mix"]

# A few impossible readings among ordinary ones.
EXTREME_EVENTS = {
    "event_id": "event_id",
    "event_type": "event_type",
    "value": "value",
    "reading": "CASE WHEN event_id % 997 = 0 THEN value * 100 ELSE value END",
    "share %": "CASE WHEN event_id % 501 = 0 THEN 150e0 ELSE value / 10 END",
    "zeros": "CASE WHEN event_id % 4 = 0 THEN 0e0 ELSE value END",
}
EXTREMES = ["value", "reading", "share %", "zeros"]

# An original table and three whole-table versions of it.
SOURCES = {
    "original": {c: c for c in LINE_COLUMNS},
    "scaled": {c: f"{c} * 1.1e0" for c in LINE_COLUMNS},
    "coarse": {
        "l_quantity": "CAST(floor(l_quantity / 5) AS DOUBLE) * 5",
        "l_extendedprice": "CAST(floor(l_extendedprice / 1000) AS DOUBLE) * 1000",
        "l_discount": "CAST(floor(l_discount * 50) AS DOUBLE) / 50",
    },
    "gappy": {c: nulled("l_partkey", 7, i, c) for i, c in enumerate(LINE_COLUMNS)},
}
