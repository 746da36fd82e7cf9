"""Cleaning, roles, missing data, duplicates."""

from pyspark.sql import functions as F

from registry import query, rounded, table, view, view_sql
from registry.inputs import DIRTY_NAMES, DIRTY_PART, EXTREME_EVENTS, GAPPY_PART
from tabloom.functions.cells import DEFAULT_NA_TOKENS, NA_TOKENS
from tabloom.functions.names import col
from tabloom.operators import cleaning, duplicates, encode, impute, profile, rules, schema
from tabloom.plans.preprocess import preprocess
from tabloom.session import shared_folder
from tabloom.sources.tables import read_dirty_csv, result_document, write_csv

TOKENS = ", ".join("'" + t + "'" for t in sorted(set(NA_TOKENS) | set(DEFAULT_NA_TOKENS)))
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def marked_sql(names, source="raw"):
    cells = ", ".join(f'CASE WHEN ltrim("{c}") IN ({TOKENS}) THEN NULL ELSE ltrim("{c}") END AS "{c}"' for c in names)
    return f"SELECT p_partkey, {cells} FROM {source}"


RAW = view_sql("part", DIRTY_PART)
MARKED = f"WITH raw AS ({RAW}), marked AS ({marked_sql(DIRTY_NAMES)})"
NUMERIC = ["retail %", "size %", "rare", "third", "seventh", "twentieth"]


def number_sql(c):
    return f"CASE WHEN regexp_matches({c}, '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def dirty_part(spark, sf):
    return view(table(spark, sf, "part"), DIRTY_PART)


def marked_part(spark, sf):
    return cleaning.mark_missing(dirty_part(spark, sf))


def gappy_part(spark, sf):
    return view(table(spark, sf, "part"), GAPPY_PART)


@query("mark_missing", f"{MARKED} SELECT * FROM marked")
def mark_missing(spark, sf):
    return marked_part(spark, sf)


@query("mark_missing_untrimmed", f"""WITH raw AS ({RAW}) SELECT p_partkey, {", ".join(
    f'CASE WHEN "{c}" IN ({TOKENS}) THEN NULL ELSE "{c}" END AS "{c}"' for c in DIRTY_NAMES)} FROM raw""")
def mark_missing_untrimmed(spark, sf):
    return cleaning.mark_missing(dirty_part(spark, sf), trim=False)


CLEANED = ", ".join(f'{number_sql(expr)} AS "{c}"' for c, expr in [
    ("retail %", "CASE WHEN \"retail %\" = 'NP' THEN '0' WHEN \"retail %\" = 'l' THEN NULL ELSE \"retail %\" END"),
    *[(c, f'"{c}"') for c in NUMERIC[1:]]])


@query("clean_tokens", f'{MARKED} SELECT p_partkey, {CLEANED}, p_brand, p_type FROM marked')
def clean_tokens(spark, sf):
    replaced = cleaning.apply_tokens(marked_part(spark, sf), ["retail %"])
    return cleaning.to_numeric(replaced, NUMERIC)


@query("csv_scan", f'{MARKED} SELECT p_partkey, "retail %", "size %", p_brand FROM marked')
def csv_scan(spark, sf):
    """Write the dirty table as CSV into the shared folder and read it back with all token rules."""
    import uuid

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(dirty_part(spark, sf).select("p_partkey", col("retail %"), col("size %"), "p_brand"), path)
    back = read_dirty_csv(spark, path)
    return back.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("classify_columns", f"""{MARKED}, counts AS ({" UNION ALL ".join(
    f'''SELECT '{c}' AS "column", count("{c}") AS filled, count({number_sql(f'"{c}"')}) AS parsable FROM marked''' for c in DIRTY_NAMES)})
    SELECT "column", filled, parsable, CASE WHEN "column" = 'p_type' THEN 'categorical'
    WHEN filled > 0 AND parsable > filled * 0.5e0 THEN 'numeric' ELSE 'categorical' END AS kind FROM counts""")
def classify_columns(spark, sf):
    return schema.classify(schema.drop_ids(marked_part(spark, sf), ["p_partkey"]), ids=["p_type"])


@query("classify_any_value", f"""{MARKED}, counts AS ({" UNION ALL ".join(
    f'''SELECT '{c}' AS "column", count("{c}") AS filled, count({number_sql(f'"{c}"')}) AS parsable FROM marked''' for c in DIRTY_NAMES)})
    SELECT "column", filled, parsable, CASE WHEN "column" = 'seventh' THEN 'categorical'
    WHEN parsable > 5 THEN 'numeric' ELSE 'categorical' END AS kind FROM counts""")
def classify_any_value(spark, sf):
    return schema.classify(schema.drop_ids(marked_part(spark, sf), ["p_partkey"]), min_valid=5, overrides={"seventh": "categorical"})


SUMMARY = f"""{MARKED}, summary AS ({" UNION ALL ".join(
    f'''SELECT '{c}' AS "column", count(*) - count("{c}") AS n_missing, (count(*) - count("{c}")) * 100e0 / count(*) AS pct_missing,
    count("{c}") AS n_filled, count(*) AS n_rows, coalesce(bool_or(trim("{c}") = 'NP'), false) AS has_zero_token,
    coalesce(bool_or(trim("{c}") IN ('NP', 'l', 'I', 'L')), false) AS has_special,
    count({number_sql(f'"{c}"')}) AS parsable FROM marked''' for c in DIRTY_NAMES)})"""


@query("missing_summary", f"""{SUMMARY} SELECT "column", n_missing, round(pct_missing, 6) AS pct_missing, n_filled, n_rows,
    has_zero_token, has_special FROM summary""")
def missing_summary(spark, sf):
    return rounded(profile.missing_summary(marked_part(spark, sf), DIRTY_NAMES))


@query("total_missing", f"{SUMMARY} SELECT CAST(sum(n_missing) AS BIGINT) AS total_missing FROM summary")
def total_missing(spark, sf):
    return profile.total_missing(marked_part(spark, sf))


@query("lightly_missing_columns", f"""{SUMMARY} SELECT "column", round(pct_missing, 6) AS pct_missing FROM summary
    WHERE pct_missing > 0 AND pct_missing < 10""")
def lightly_missing_columns(spark, sf):
    summary = profile.missing_summary(marked_part(spark, sf), DIRTY_NAMES)
    return rounded(profile.columns_with_missing(summary, 0.0, 10.0).select("column", "pct_missing"))


STRATEGY = """CASE WHEN pct_missing > 50 THEN 'DROP_COLUMN' WHEN pct_missing > 30 THEN 'RETAIN_AS_CATEGORY'
    WHEN {zero} WHEN pct_missing < 10 THEN {low} ELSE 'IMPUTE_KNN' END"""
ZERO_CLASS = "\"column\" IN ('retail %', 'size %') AND has_special THEN CASE WHEN has_zero_token THEN 'REPLACE_WITH_ZERO' END"
LOW_CLASS = "CASE WHEN parsable > n_rows * 0.5e0 THEN 'IMPUTE_MEDIAN' ELSE 'IMPUTE_MODE' END"


@query("missing_strategy", f"""{SUMMARY} SELECT "column", n_missing, round(pct_missing, 6) AS pct_missing,
    {STRATEGY.format(zero=ZERO_CLASS, low=LOW_CLASS)} AS action FROM summary WHERE n_missing > 0 OR has_special""")
def missing_strategy(spark, sf):
    df = marked_part(spark, sf)
    summary = profile.missing_summary(df, DIRTY_NAMES)
    return rounded(rules.missing_strategy(summary, ["retail %", "size %"], schema.parse_counts(df, DIRTY_NAMES)))


@query("missing_strategy_by_name", f"""{SUMMARY} SELECT "column", n_missing, round(pct_missing, 6) AS pct_missing,
    {STRATEGY.format(zero="\"column\" IN ('twentieth') THEN 'REPLACE_WITH_ZERO'", low="'IMPUTE_MEDIAN'")} AS action
    FROM summary WHERE n_missing > 0 OR has_zero_token""")
def missing_strategy_by_name(spark, sf):
    summary = profile.missing_summary(marked_part(spark, sf), DIRTY_NAMES)
    return rounded(rules.missing_strategy(summary, ["twentieth"], by_name_only=True))


@query("summary_with_strategy", f"""{SUMMARY} SELECT "column", n_missing, coalesce(CASE WHEN n_missing > 0 OR has_special THEN
    {STRATEGY.format(zero=ZERO_CLASS, low=LOW_CLASS)} END, 'N/A') AS action FROM summary""")
def summary_with_strategy(spark, sf):
    df = marked_part(spark, sf)
    summary = profile.missing_summary(df, DIRTY_NAMES)
    strategy = rules.missing_strategy(summary, ["retail %", "size %"], schema.parse_counts(df, DIRTY_NAMES))
    return rules.summary_with_strategy(summary, strategy).select("column", "n_missing", "action")


@query("drop_by_strategy", f"{MARKED} SELECT * EXCLUDE (rare) FROM marked")
def drop_by_strategy(spark, sf):
    df = marked_part(spark, sf)
    strategy = rules.missing_strategy(profile.missing_summary(df, DIRTY_NAMES))
    return schema.drop_ids(df, rules.columns_to_drop(strategy))


@query("special_tokens", f"""{MARKED} SELECT col AS "column", v AS value, count(*) AS n FROM ({" UNION ALL ".join(
    f'''SELECT '{c}' AS col, "{c}" AS v FROM marked''' for c in DIRTY_NAMES)}) WHERE trim(v) IN ('NP', 'l', 'I', 'L') GROUP BY ALL""")
def special_tokens(spark, sf):
    return cleaning.special_tokens(marked_part(spark, sf), DIRTY_NAMES)


@query("complete_rows", f"""WITH g AS ({view_sql("part", GAPPY_PART)}) SELECT * FROM g WHERE size IS NOT NULL AND retail IS NOT NULL
    AND letters IS NOT NULL AND mix IS NOT NULL AND p_type IS NOT NULL""")
def complete_rows(spark, sf):
    return cleaning.complete_rows(gappy_part(spark, sf))


@query("incomplete_rows", f"""WITH g AS ({view_sql("part", GAPPY_PART)}) SELECT * FROM g WHERE size IS NULL OR retail IS NULL
    OR letters IS NULL OR mix IS NULL OR p_type IS NULL""")
def incomplete_rows(spark, sf):
    return cleaning.incomplete_rows(gappy_part(spark, sf))


@query("group_labels", f"""WITH g AS ({view_sql("part", GAPPY_PART)}) SELECT coalesce(p_type, 'Unknown') AS label, count(*) AS n
    FROM g GROUP BY ALL""")
def group_labels(spark, sf):
    return cleaning.group_sizes(cleaning.with_group(gappy_part(spark, sf)))


@query("fill_constant", f"""WITH g AS ({view_sql("part", GAPPY_PART)}) SELECT p_partkey, coalesce(size, 0e0) AS size, retail, letters, mix,
    coalesce(p_type, 'Unknown') AS p_type FROM g""")
def fill_constant(spark, sf):
    return cleaning.fill_constant(gappy_part(spark, sf), {"size": 0.0, "p_type": "Unknown"})


@query("missing_as_category", f"""WITH g AS ({view_sql("part", GAPPY_PART)}) SELECT p_partkey, size, retail, letters, mix,
    coalesce(p_type, 'Missing') AS p_type, CAST(p_type IS NULL AS INT) AS p_type_missing, CAST(size IS NULL AS INT) AS size_missing FROM g""")
def missing_as_category(spark, sf):
    return impute.missing_as_category(gappy_part(spark, sf), ["p_type", "size"])


@query("mode_impute", f"""WITH g AS ({view_sql("part", GAPPY_PART)}), m AS (SELECT p_type FROM g WHERE p_type IS NOT NULL GROUP BY p_type
    ORDER BY count(*) DESC, p_type LIMIT 1) SELECT p_partkey, coalesce(p_type, (SELECT p_type FROM m)) AS p_type FROM g""")
def mode_impute(spark, sf):
    return impute.mode_impute(gappy_part(spark, sf), ["p_type"]).select("p_partkey", "p_type")


@query("median_impute", f"""WITH g AS ({view_sql("part", GAPPY_PART)}), m AS (SELECT median(size) AS a, median(retail) AS b, median(letters) AS c
    FROM g) SELECT p_partkey, coalesce(size, (SELECT a FROM m)) AS size, round(coalesce(retail, (SELECT b FROM m)), 6) AS retail,
    coalesce(letters, (SELECT c FROM m)) AS letters FROM g""")
def median_impute(spark, sf):
    return rounded(impute.median_impute(gappy_part(spark, sf), ["size", "retail", "letters"]).select("p_partkey", "size", "retail", "letters"))


EVENTS = f"WITH e AS ({view_sql('events', EXTREME_EVENTS)})"


def extreme_events(spark, sf):
    return view(table(spark, sf, "events"), EXTREME_EVENTS)


@query("null_extremes", f"""{EVENTS}, q AS (SELECT quantile_cont(value, 0.99) AS a, quantile_cont(reading, 0.99) AS b FROM e)
    SELECT event_id, CASE WHEN value <= (SELECT a FROM q) THEN value END AS value,
    CASE WHEN reading <= (SELECT b FROM q) THEN round(reading, 6) END AS reading FROM e""")
def null_extremes(spark, sf):
    return rounded(cleaning.null_above(extreme_events(spark, sf), ["value", "reading"]).select("event_id", "value", "reading"))


@query("null_outside_fences", f"""{EVENTS}, q AS (SELECT quantile_cont(reading, 0.25) AS a, quantile_cont(reading, 0.75) AS b FROM e)
    SELECT event_id, CASE WHEN reading BETWEEN (SELECT a - 1.5e0 * (b - a) FROM q) AND (SELECT b + 1.5e0 * (b - a) FROM q)
    THEN round(reading, 6) END AS reading FROM e""")
def null_outside_fences(spark, sf):
    from tabloom.operators.outliers import fences

    df = extreme_events(spark, sf)
    lo, hi = fences(df, ["reading"])["reading"][2:]
    return rounded(cleaning.null_outside(df, {"reading": (lo, hi)}).select("event_id", "reading"))


@query("trim_range", f"""{EVENTS}, q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM e)
    SELECT event_id, value FROM e WHERE value BETWEEN (SELECT lo FROM q) AND (SELECT hi FROM q)""")
def trim_range(spark, sf):
    df = extreme_events(spark, sf)
    lo, hi = cleaning.trim_range(df, "value")
    return df.where(F.col("value").between(lo, hi)).select("event_id", "value")


@query("round_half_even", """SELECT p_partkey, round_even(p_retailprice / 8, 2) AS eighth, round_even(p_size / 2.0e0, 0) AS half FROM part""")
def round_half_even(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey", "p_retailprice / 8 AS eighth", "p_size / 2.0D AS half")
    return cleaning.round_half_even(cleaning.round_half_even(df, ["eighth"], 2), ["half"], 0)


DUPED = "SELECT p_brand, p_type, p_size FROM part UNION ALL SELECT p_brand, p_type, p_size FROM part WHERE p_partkey % 50 = 0"


@query("duplicate_count", f"""SELECT CAST(sum(c - 1) AS BIGINT) AS n_duplicate_rows FROM (SELECT count(*) AS c FROM ({DUPED}) GROUP BY ALL_COLS)""".replace(
    "GROUP BY ALL_COLS", "GROUP BY p_brand, p_type, p_size"))
def duplicate_count(spark, sf):
    part = table(spark, sf, "part")
    both = part.unionByName(part.where("p_partkey % 50 = 0")).select("p_brand", "p_type", "p_size")
    return duplicates.duplicate_count(both)


@query("duplicate_rows", """SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type, p_size
    ORDER BY p_partkey) AS r FROM part) WHERE r > 1""")
def duplicate_rows(spark, sf):
    return duplicates.duplicate_rows(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])


CONSTANT = ["l_linestatus", "l_returnflag", "l_shipmode", "l_partkey", "l_extendedprice", "l_empty"]


@query("constant_columns", f"""WITH d AS (SELECT *, 'AIR' AS l_shipmode, CAST(NULL AS STRING) AS l_empty FROM lineitem), c AS ({" UNION ALL ".join(
    f'''SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, count({c}) AS n_filled FROM d''' for c in CONSTANT)})
    SELECT "column", n_distinct, n_filled, CASE WHEN n_distinct = 1 THEN 'constant' WHEN n_filled > 0 AND n_distinct < n_filled * 0.05e0
    THEN 'near_constant' ELSE 'varied' END AS status FROM c""")
def constant_columns(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("l_shipmode", F.lit("AIR")).withColumn("l_empty", F.lit(None).cast("string"))
    return profile.constant_columns(df, CONSTANT)


@query("value_counts", """SELECT col AS "column", v AS value, count(*) AS n FROM (SELECT 'p_brand' AS col, p_brand AS v FROM part
    UNION ALL SELECT 'p_size', CAST(p_size AS STRING) FROM part) GROUP BY ALL""")
def value_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "part"), ["p_brand", "p_size"])


@query("repeated_values", """SELECT 'o_totalprice' AS "column", CAST(o_totalprice AS STRING) AS value, count(*) AS n FROM orders GROUP BY ALL
    HAVING count(*) > 1""")
def repeated_values(spark, sf):
    counts = profile.value_counts(table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), ["o_totalprice"])
    out = duplicates.repeated_values(counts)
    return out.withColumn("value", F.col("value").cast("double").cast("string"))


@query("distinct_values", "SELECT DISTINCT p_type AS value FROM part ORDER BY value")
def distinct_values(spark, sf):
    return profile.distinct_values(table(spark, sf, "part"), "p_type")


@query("head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def head(spark, sf):
    return cleaning.head(table(spark, sf, "orders"), "o_orderkey")


@query("sorted_column", "SELECT c_acctbal FROM customer ORDER BY c_acctbal")
def sorted_column(spark, sf):
    return cleaning.sorted_values(table(spark, sf, "customer"), "c_acctbal")


@query("table_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def table_shape(spark, sf):
    return profile.shape(table(spark, sf, "lineitem"))


@query("standard_scale", f"""WITH g AS ({view_sql("part", GAPPY_PART)}), f AS (SELECT p_partkey, coalesce(size, 0e0) AS size,
    coalesce(retail, 0e0) AS retail FROM g), s AS (SELECT avg(size) AS ma, stddev_pop(size) AS sa, avg(retail) AS mb, stddev_pop(retail) AS sb FROM f)
    SELECT p_partkey, round((size - (SELECT ma FROM s)) / (SELECT sa FROM s), 6) AS size,
    round((retail - (SELECT mb FROM s)) / (SELECT sb FROM s), 6) AS retail FROM f""")
def standard_scale(spark, sf):
    df = gappy_part(spark, sf).select("p_partkey", "size", "retail")
    return rounded(encode.fit_scaler(df, ["size", "retail"]).transform(df))


@query("label_encode", f"""WITH g AS ({view_sql("part", GAPPY_PART)}), l AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS i FROM
    (SELECT DISTINCT coalesce(p_type, 'Unknown') AS v FROM g)) SELECT p_partkey, p_type, i AS code FROM g JOIN l ON coalesce(p_type, 'Unknown') = v""")
def label_encode(spark, sf):
    return encode.label_encode(gappy_part(spark, sf), "p_type", "p_partkey", "code").select("p_partkey", "p_type", "code")


@query("label_encode_many", """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS STRING)) - 1 AS INT) AS code FROM orders""")
def label_encode_many(spark, sf):
    """The path for more labels than are inlined: numbered in parallel, joined with hot labels spread."""
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    coded = encode.numbered(df.select(F.col("customer").alias("category")).distinct())
    joined = duplicates.salted_join(df.withColumnRenamed("customer", "category"), coded, ["category"], "o_orderkey")
    return joined.select("o_orderkey", F.col("idx").cast("int").alias("code"))


PRE = ["retail %", "size %", "seventh", "twentieth"]
PRE_NUM = ", ".join(f'{number_sql(e)} AS "{c}"' for c, e in [
    ("retail %", "CASE WHEN \"retail %\" = 'NP' THEN '0' WHEN \"retail %\" = 'l' THEN NULL ELSE \"retail %\" END"),
    ("size %", "CASE WHEN \"size %\" = 'NP' THEN '0' WHEN \"size %\" = 'l' THEN NULL ELSE \"size %\" END"),
    ("seventh", "seventh"), ("twentieth", "twentieth")])


@query("preprocess", f"""{MARKED}, num AS (SELECT p_partkey, p_type, {PRE_NUM} FROM marked),
    cut AS (SELECT * REPLACE (CASE WHEN seventh <= (SELECT quantile_cont(seventh, 0.99) FROM num) THEN seventh END AS seventh) FROM num),
    pct AS (SELECT {", ".join(f'(count(*) - count("{c}")) * 100e0 / count(*) AS "{c}"' for c in PRE)} FROM cut),
    med AS (SELECT {", ".join(f'median("{c}") AS "{c}"' for c in PRE)} FROM cut),
    filled AS (SELECT p_partkey, p_type, {", ".join(f'''coalesce("{c}", CASE WHEN (SELECT "{c}" FROM pct) > 0 AND (SELECT "{c}" FROM pct) < 10
        THEN (SELECT "{c}" FROM med) ELSE 0e0 END) AS "{c}"''' for c in PRE)} FROM cut),
    stat AS (SELECT {", ".join(f'avg("{c}") AS "m {c}", stddev_pop("{c}") AS "s {c}"' for c in PRE)} FROM filled),
    code AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS i FROM (SELECT DISTINCT coalesce(p_type, 'Unknown') AS v FROM filled))
    SELECT p_partkey, p_type, {", ".join(f'round(("{c}" - (SELECT "m {c}" FROM stat)) / (SELECT "s {c}" FROM stat), 6) AS "{c}"' for c in PRE)},
    i AS "p_type Encoded" FROM filled JOIN code ON coalesce(p_type, 'Unknown') = v""")
def preprocess_query(spark, sf):
    df = dirty_part(spark, sf).select("p_partkey", "p_type", *[col(c) for c in PRE])
    return rounded(preprocess(df, "p_partkey", PRE, "p_type", ["retail %", "size %"], ["seventh"]))


@query("validity_rules", f"""{EVENTS} SELECT 'share within 100' AS rule, count("share %") AS n_checked,
    CAST(sum(CASE WHEN "share %" <= 100 THEN 0 ELSE 1 END) AS BIGINT) AS n_broken FROM e UNION ALL
    SELECT 'reading below ten times value', count(reading), CAST(sum(CASE WHEN reading <= value * 10 THEN 0 ELSE 1 END) AS BIGINT) FROM e""")
def validity_rules(spark, sf):
    return rules.validity(extreme_events(spark, sf), {
        "share within 100": col("share %") <= 100, "reading below ten times value": F.col("reading") <= F.col("value") * 10})


SOME = ["seventh", "p_partkey", "retail %"]


@query("configured_columns", f'{MARKED} SELECT p_partkey, "seventh", "retail %" FROM marked')
def configured_columns(spark, sf):
    """A configured list in its own order; names that the table does not have are left out."""
    df = marked_part(spark, sf)
    return schema.in_order(df, schema.existing(df, [*SOME, "absent"]))


@query("first_feature_columns", f'{MARKED} SELECT "retail %", "size %", "rare" FROM marked')
def first_feature_columns(spark, sf):
    """The first three columns that are no ids."""
    df = marked_part(spark, sf)
    return schema.in_order(df, schema.first_columns(schema.all_except(df, ["p_partkey"]), 3))


TYPED = ["o_orderkey", "o_orderstatus", "o_totalprice"]


@query("column_types", f"""WITH n AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS filled FROM orders" for c in TYPED)})
    SELECT CAST(column_index - 1 AS INT) AS "position", column_name AS "column",
    CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS type, filled
    FROM duckdb_columns() JOIN n ON n.c = column_name WHERE table_name = 'orders'""")
def column_types(spark, sf):
    df = table(spark, sf, "orders")
    filled = schema.parse_counts(df, TYPED).select("column", "filled")
    return schema.column_types(df).join(filled, "column").select("position", "column", "type", "filled")


@query("result_document", """WITH p AS (SELECT o_orderpriority AS k, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY k),
    s AS (SELECT o_orderstatus AS k, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY k, priority),
    sk AS (SELECT k, '[' || string_agg('{"priority":"' || priority || '","n":' || n || '}', ',' ORDER BY '{"priority":"' || priority || '","n":' || n || '}') || ']' AS body FROM s GROUP BY k)
    SELECT '{"priorities":{' || (SELECT string_agg('"' || k || '":{"n":' || n || ',"customers":' || customers || '}', ',' ORDER BY k) FROM p)
    || '},"statuses":{' || (SELECT string_agg('"' || k || '":' || body, ',' ORDER BY k) FROM sk) || '},"table":{"n":' || (SELECT count(*) FROM orders) || '}}' AS document""")
def result_document_query(spark, sf):
    """Sections with one row per key, with several rows per key, and without a key."""
    df = table(spark, sf, "orders")
    return result_document({
        "priorities": df.groupBy(F.col("o_orderpriority").alias("column")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers")),
        "statuses": df.groupBy(F.col("o_orderstatus").alias("column"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")),
        "table": df.agg(F.count("*").alias("n"))})
