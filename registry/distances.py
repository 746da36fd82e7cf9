"""Two-sample distances between groups and between whole tables; histogram, box and Q-Q tables."""

from pyspark.sql import functions as F

from registry import long_sql, query, rounded, table, view, view_sql
from registry.cleaning import MARKED, marked_part, number_sql
from registry.inputs import DIRTY_NAMES, LINE_COLUMNS, SOURCES
from tabloom.functions.cells import pair_label
from tabloom.functions.pvalues import limit_sql, with_p_value
from tabloom.operators import cleaning
from tabloom.operators import compare as cmp
from tabloom.operators import rules
from tabloom.operators.cdf import build_axis, two_sample
from tabloom.operators.histogram import box_statistics, density_histogram, jensen_shannon, qq_table, shared_bins
from tabloom.operators.impute import median_impute
from tabloom.plans.analysis import group_tests
from tabloom.plans.comparison import compare, wide_distances


def two_sample_sql(long, against=None, min_size=1):
    """CTEs ending in ``d``: distances of every pair of labels g in (col, g, x) rows."""
    pairs = f"a.g = '{against}' AND b.g <> a.g" if against else "a.g < b.g"
    return f"""long AS ({long}), n AS (SELECT col, g, count(*) AS n FROM long GROUP BY ALL HAVING count(*) >= {min_size}),
        pairs AS (SELECT a.col, a.g AS ga, b.g AS gb, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.col = b.col AND {pairs}),
        v AS (SELECT col, g, x, count(*) AS c FROM long GROUP BY ALL),
        axis AS (SELECT p.col, ga, gb, na, nb, x, sum(CASE WHEN g = ga THEN c ELSE 0 END) AS ca, sum(CASE WHEN g = gb THEN c ELSE 0 END) AS cb
            FROM pairs p JOIN v ON v.col = p.col AND v.g IN (ga, gb) GROUP BY ALL),
        cum AS (SELECT *, sum(ca) OVER w / na AS fa, sum(cb) OVER w / nb AS fb, lead(x) OVER w AS nx FROM axis
            WINDOW w AS (PARTITION BY col, ga, gb ORDER BY x)),
        d AS (SELECT col AS "column", ga AS label_a, gb AS label_b, max(na) AS n_a, max(nb) AS n_b, max(abs(fa - fb)) AS ks,
            sum(abs(fa - fb) * coalesce(nx - x, 0)) AS wasserstein FROM cum GROUP BY col, ga, gb)"""


def grouped_long(relation, columns, group):
    return long_sql(relation, columns, f"{group} AS g, ")


SHOWN = "\"column\", label_a, label_b, n_a, n_b, round(ks, 9) AS ks, round(wasserstein, 6) AS wasserstein"
LINE_GROUPS = two_sample_sql(grouped_long("lineitem", LINE_COLUMNS, "l_returnflag"))
EVENT_GROUPS = two_sample_sql(grouped_long("events", ["value"], "event_type"), min_size=3)
ORDER_GROUPS = two_sample_sql(grouped_long("orders", ["o_totalprice", "o_custkey"], "o_orderpriority"), min_size=3)


@query("ks_wasserstein_by_group", f"WITH {LINE_GROUPS} SELECT {SHOWN} FROM d")
def ks_wasserstein_by_group(spark, sf):
    return rounded(two_sample(build_axis(table(spark, sf, "lineitem"), LINE_COLUMNS, "l_returnflag")), 6, ks=9)


@query("ks_wasserstein_bucketed", f"WITH {LINE_GROUPS} SELECT {SHOWN} FROM d")
def ks_wasserstein_bucketed(spark, sf):
    """The same answer on the path for large tables: every column cut into ordered buckets."""
    axis = build_axis(table(spark, sf, "lineitem"), LINE_COLUMNS, "l_returnflag", rows_per_bucket=5_000)
    return rounded(two_sample(axis), 6, ks=9)


MONTHS = two_sample_sql(grouped_long("orders", ["o_totalprice"], "strftime(o_orderdate, '%Y-%m')"))
DAYS = two_sample_sql(grouped_long("lineitem", ["l_quantity", "l_extendedprice"], "strftime(l_shipdate, '%Y-%m-%d')"))


@query("ks_wasserstein_by_month", f"WITH {MONTHS} SELECT {SHOWN} FROM d")
def ks_wasserstein_by_month(spark, sf):
    """All pairs of some eighty groups."""
    orders = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rounded(two_sample(build_axis(orders, ["o_totalprice"], "month", rows_per_bucket=2_000)), 6, ks=9)


@query("ks_wasserstein_by_day", f"""WITH {DAYS.replace("a.g < b.g", "a.g < b.g AND a.g = (SELECT min(g) FROM long)")} SELECT {SHOWN} FROM d""")
def ks_wasserstein_by_day(spark, sf):
    """The first shipping day against each of the others: thousands of groups."""
    lines = table(spark, sf, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    axis = build_axis(lines, ["l_quantity", "l_extendedprice"], "day", rows_per_bucket=20_000)
    return rounded(two_sample(axis, axis.labels[0]), 6, ks=9)


@query("group_pair_tests",f"""WITH {EVENT_GROUPS} SELECT {SHOWN}, left(label_a, 20) || ' vs ' || left(label_b, 20) AS pair FROM d""")
def group_pair_tests(spark, sf):
    tests = two_sample(build_axis(table(spark, sf, "events"), ["value"], "event_type"), min_size=3)
    return rounded(tests.withColumn("pair", pair_label(F.col("label_a"), F.col("label_b"))), 6, ks=9)


@query("group_pair_p_values")
def group_pair_p_values(spark, sf):
    return group_tests(table(spark, sf, "events"), ["value"], "event_type")


@query("limit_p_values", f"""WITH {ORDER_GROUPS} SELECT "column", label_a, label_b, round({limit_sql("ks", "n_a", "n_b")}, 6) AS p_value FROM d""")
def limit_p_values(spark, sf):
    tests = two_sample(build_axis(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "o_orderpriority"), min_size=3)
    return rounded(with_p_value(tests, "limit").select("column", "label_a", "label_b", "p_value"))


@query("pooling_rule", f"""WITH {ORDER_GROUPS}, p AS (SELECT count(*) AS n_tests, avg(CASE WHEN {limit_sql("ks", "n_a", "n_b")} < 0.05 THEN 1e0 ELSE 0e0 END) * 100 AS pct FROM d)
    SELECT n_tests, round(pct, 6) AS pct_significant, CASE WHEN pct > 30 THEN 'DO_NOT_POOL' WHEN pct > 15 THEN 'CAUTION' ELSE 'POOLING_ACCEPTABLE' END AS pooling,
    CASE WHEN pct > 30 THEN 'per_group' ELSE 'pooled' END AS approach FROM p""")
def pooling_rule(spark, sf):
    tests = two_sample(build_axis(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "o_orderpriority"), min_size=3)
    return rounded(rules.pooling(with_p_value(tests, "limit")))


def histogram_sql(long, bins=49):
    """CTEs ending in ``h``: counts per column, label and bin over the joint range, compared with the edges themselves."""
    return f"""hl AS ({long}), span AS (SELECT col, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {float(bins)}e0 AS step FROM hl GROUP BY col),
        guess AS (SELECT hl.col, g, x, lo, step, floor((x - lo) / step) AS k FROM hl JOIN span ON span.col = hl.col WHERE step > 0),
        moved AS (SELECT col, g, k - CASE WHEN x < lo + k * step THEN 1 ELSE 0 END + CASE WHEN x >= lo + (k + 1) * step THEN 1 ELSE 0 END AS k FROM guess),
        h AS (SELECT col, g, CAST(greatest(0, least({bins - 1}, k)) AS INT) AS bin, count(*) AS c FROM moved GROUP BY ALL)"""


def js_sql(long, pairs, bins=49):
    """CTEs ending in ``j``: Jensen-Shannon distance for the label pairs of a join condition on labels a and b."""
    return f"""{histogram_sql(long, bins)}, tot AS (SELECT col, g, sum(c) AS t FROM h GROUP BY ALL), grid AS (SELECT DISTINCT col, bin FROM h),
        share AS (SELECT grid.col, tot.g, grid.bin, coalesce(c, 0) / t AS p FROM grid JOIN tot ON tot.col = grid.col
            LEFT JOIN h ON h.col = grid.col AND h.bin = grid.bin AND h.g = tot.g),
        j AS (SELECT a.col, a.g AS label_a, b.g AS label_b, sqrt(greatest(0e0, sum(CASE WHEN a.p > 0 THEN a.p * ln(2 * a.p / (a.p + b.p)) ELSE 0 END
            + CASE WHEN b.p > 0 THEN b.p * ln(2 * b.p / (a.p + b.p)) ELSE 0 END) / 2)) AS js
            FROM share a JOIN share b ON a.col = b.col AND a.bin = b.bin AND {pairs} GROUP BY ALL)"""


ORDER_LONG = grouped_long("orders", ["o_totalprice"], "o_orderstatus")


@query("js_distance", f"""WITH {js_sql(ORDER_LONG, "a.g < b.g")} SELECT col AS "column", label_a, label_b, round(js, 7) AS js FROM j""")
def js_distance(spark, sf):
    return rounded(jensen_shannon(build_axis(table(spark, sf, "orders"), ["o_totalprice"], "o_orderstatus")), 7)


@query("shared_histogram", f"""WITH {histogram_sql(ORDER_LONG)} SELECT 0 AS ci, bin, CAST(sum(CASE WHEN g = 'F' THEN c ELSE 0 END) AS BIGINT) AS n0,
    CAST(sum(CASE WHEN g = 'O' THEN c ELSE 0 END) AS BIGINT) AS n1, CAST(sum(CASE WHEN g = 'P' THEN c ELSE 0 END) AS BIGINT) AS n2
    FROM (SELECT e.bin, g, coalesce(c, 0) AS c FROM (SELECT CAST(range AS INT) AS bin FROM range(0, 49)) e LEFT JOIN h ON h.bin = e.bin) GROUP BY bin""")
def shared_histogram_query(spark, sf):
    return shared_bins(build_axis(table(spark, sf, "orders"), ["o_totalprice"], "o_orderstatus"))


@query("density_histogram", f"""WITH l AS ({ORDER_LONG}), r AS (SELECT col, g, min(x) AS a, max(x) AS b, count(*) AS size FROM l GROUP BY ALL),
    w AS (SELECT col, g, size, CASE WHEN a = b THEN a - 0.5e0 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5e0 ELSE b END AS hi FROM r), s AS (SELECT *, (hi - lo) / 20e0 AS step FROM w),
    k AS (SELECT l.col, l.g, x, lo, size, step, floor((x - lo) / step) AS k FROM l JOIN s ON s.col = l.col AND s.g = l.g),
    m AS (SELECT *, CAST(greatest(0, least(19, k - CASE WHEN x < lo + k * step THEN 1 ELSE 0 END + CASE WHEN x >= lo + (k + 1) * step THEN 1 ELSE 0 END)) AS INT) AS bin FROM k), c AS (SELECT col, g, bin, count(*) AS n FROM m GROUP BY ALL)
    SELECT s.col AS "column", s.g AS label, e.bin, round(lo + e.bin * step, 6) AS lo, round(lo + (e.bin + 1) * step, 6) AS hi, coalesce(n, 0) AS n,
    round(coalesce(n, 0) / (size * step), 12) AS density FROM s CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(0, 20)) e LEFT JOIN c ON c.col = s.col AND c.g = s.g AND c.bin = e.bin""")
def density_histogram_query(spark, sf):
    return rounded(density_histogram(build_axis(table(spark, sf, "orders"), ["o_totalprice"], "o_orderstatus")), 6, density=12)


@query("box_stats", f"""WITH l AS ({grouped_long("events", ["value"], "event_type")}), q AS (SELECT col, g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2,
    quantile_cont(x, 0.75) AS q3 FROM l GROUP BY ALL) SELECT l.col AS "column", l.g AS label, count(*) AS n, round(avg(x), 6) AS mean, round(max(q1), 6) AS q1,
    round(max(q2), 6) AS median, round(max(q3), 6) AS q3, min(CASE WHEN x BETWEEN q1 - (q3 - q1) * 1.5e0 AND q3 + (q3 - q1) * 1.5e0 THEN x END) AS whisker_low,
    max(CASE WHEN x BETWEEN q1 - (q3 - q1) * 1.5e0 AND q3 + (q3 - q1) * 1.5e0 THEN x END) AS whisker_high,
    CAST(sum(CASE WHEN x BETWEEN q1 - (q3 - q1) * 1.5e0 AND q3 + (q3 - q1) * 1.5e0 THEN 0 ELSE 1 END) AS BIGINT) AS fliers
    FROM l JOIN q ON q.col = l.col AND q.g = l.g GROUP BY l.col, l.g""")
def box_stats(spark, sf):
    return rounded(box_statistics(build_axis(table(spark, sf, "events"), ["value"], "event_type")))


@query("qq_table", f"""WITH l AS ({ORDER_LONG}), j AS (SELECT CAST(range AS INT) AS j FROM range(0, 100)), s AS (SELECT col, g, list(x ORDER BY x) AS xs, count(*) AS n FROM l GROUP BY ALL),
    h AS (SELECT col, g, j, xs, (j * (n - 1)) / 99e0 AS h FROM s, j) SELECT col AS "column", g AS label, j, round(j / 99e0, 9) AS p,
    round(xs[CAST(floor(h) AS BIGINT) + 1] + (xs[least(CAST(floor(h) AS BIGINT) + 2, len(xs))] - xs[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)), 4) AS value FROM h""")
def qq_query(spark, sf):
    axis = build_axis(table(spark, sf, "orders"), ["o_totalprice"], "o_orderstatus")
    return rounded(qq_table(axis, "F"), 9, value=4)


def source_tables(spark, sf):
    """The original, scaled and coarse versions, and a gappy one filled with its medians; each over the whole table."""
    line = table(spark, sf, "lineitem")
    out = {name: view(line, columns) for name, columns in SOURCES.items()}
    out["imputed"] = median_impute(out.pop("gappy"), LINE_COLUMNS)
    return out


def sources_long():
    parts = [long_sql(f"s_{name}", LINE_COLUMNS, f"'{name}' AS g, ") for name in ("original", "scaled", "coarse", "imputed")]
    return " UNION ALL ".join(parts)


SOURCE_SQL = ", ".join(f"s_{name} AS ({view_sql('lineitem', columns)})" for name, columns in SOURCES.items()) + (
    ", s_imputed AS (SELECT " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM s_gappy)) AS {c}" for c in LINE_COLUMNS) + " FROM s_gappy)")
FROM_ORIGINAL = "a.g = 'original' AND b.g <> a.g"
METRICS_SQL = (f"WITH {SOURCE_SQL}, {two_sample_sql(sources_long(), 'original')}, {js_sql(sources_long(), FROM_ORIGINAL)}, "
               """m AS (SELECT d."column", d.label_b AS candidate, n_a, n_b, wasserstein, ks, js FROM d JOIN j ON j.col = d."column" AND j.label_b = d.label_b),
    long_m AS (SELECT "column", candidate, 'wasserstein' AS metric, wasserstein AS v FROM m UNION ALL SELECT "column", candidate, 'ks', ks FROM m
    UNION ALL SELECT "column", candidate, 'js', js FROM m)""")


def comparison(spark, sf):
    tables = source_tables(spark, sf)
    return compare(tables.pop("original"), tables, LINE_COLUMNS)


@query("compare_datasets", f"""{METRICS_SQL} SELECT "column", candidate, n_a, n_b, round(wasserstein, 5) AS wasserstein, round(ks, 9) AS ks, round(js, 7) AS js FROM m""")
def compare_datasets(spark, sf):
    return rounded(comparison(spark, sf).distances, 5, ks=9, js=7)


@query("compare_datasets_wide", f"""{METRICS_SQL} SELECT "column", {", ".join(
    f"round(max(CASE WHEN candidate = '{c}' AND metric = '{m}' THEN v END), 6) AS {m}_{c}" for m in ("wasserstein", "ks", "js") for c in ("scaled", "coarse", "imputed"))}
    FROM long_m GROUP BY "column" """)
def compare_datasets_wide(spark, sf):
    c = comparison(spark, sf)
    return rounded(wide_distances(c.distances, c.candidates))


@query("metric_winners", f"""{METRICS_SQL} SELECT "column", metric, min_by(candidate, v) AS winner, round(min(v), 6) AS best FROM long_m GROUP BY "column", metric""")
def metric_winners(spark, sf):
    return rounded(comparison(spark, sf).winners())


@query("metric_wins", f"""{METRICS_SQL} SELECT metric, candidate, count(*) FILTER (v <= (SELECT min(o.v) FROM long_m o WHERE o."column" = a."column" AND o.metric = a.metric)) AS wins,
    count(v) AS columns FROM long_m a GROUP BY metric, candidate""")
def metric_wins(spark, sf):
    return comparison(spark, sf).wins()


@query("method_ranking", f"""{METRICS_SQL}, w AS (SELECT a.candidate, CAST(sum(CASE WHEN a.v < b.v THEN 1 ELSE 0 END) AS BIGINT) AS pairwise_wins FROM long_m a JOIN long_m b
    ON a."column" = b."column" AND a.metric = b.metric AND a.candidate <> b.candidate GROUP BY a.candidate)
    SELECT candidate, pairwise_wins, CAST(rank() OVER (ORDER BY pairwise_wins DESC) AS INT) AS place FROM w""")
def method_ranking(spark, sf):
    return comparison(spark, sf).ranking()


@query("comparison_facts", f"""{METRICS_SQL} SELECT 'winners' AS section, "column" || ' / ' || metric AS subject, 'winner' AS fact, min_by(candidate, v) AS value
    FROM long_m GROUP BY "column", metric""")
def comparison_facts(spark, sf):
    return comparison(spark, sf).facts().where("section = 'winners' AND fact = 'winner'")


@query("common_numeric_columns", f"""{MARKED}, counts AS ({" UNION ALL ".join(
    f'''SELECT '{c}' AS name, count("{c}") AS filled, count({number_sql(f'"{c}"')}) AS parsable FROM marked''' for c in DIRTY_NAMES)})
    SELECT name FROM counts WHERE filled > 0 AND filled = parsable UNION ALL SELECT 'p_partkey'""")
def common_numeric_columns(spark, sf):
    """One bad token makes a column text in one table, so it is common to none."""
    cleaned = cleaning.apply_tokens(marked_part(spark, sf), ["retail %", "size %"])
    shared = cmp.common_numeric([marked_part(spark, sf), cleaned], strict=True)
    return spark.createDataFrame([(c,) for c in shared], "name string")


@query("moments_by_source", f"""WITH {SOURCE_SQL}, l AS ({sources_long()}) SELECT col AS "column", g AS source, count(*) AS n, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std
    FROM l GROUP BY ALL""")
def moments_by_source(spark, sf):
    return rounded(cmp.moments_by_source(source_tables(spark, sf), LINE_COLUMNS), 5)


@query("value_counts_top8", """WITH t AS (SELECT 'customer' AS source, c_mktsegment AS v FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier),
    c AS (SELECT source, v, count(*) AS n FROM t GROUP BY source, v),
    r AS (SELECT *, sum(n) OVER (PARTITION BY source) AS t, row_number() OVER (PARTITION BY source ORDER BY n DESC, v) AS r FROM c)
    SELECT source, 'name' AS "column", v AS category, n, round(n / t, 9) AS share FROM r WHERE r <= 8""")
def value_counts_top8(spark, sf):
    tables = {"customer": table(spark, sf, "customer").selectExpr("c_mktsegment AS name"), "supplier": table(spark, sf, "supplier").selectExpr("s_name AS name")}
    return rounded(cmp.top_categories(tables, ["name"]), 9)


@query("category_coverage", """WITH a AS (SELECT DISTINCT p_brand AS c FROM part), b AS (SELECT DISTINCT replace(p_brand, '2', '7') AS c FROM part)
    SELECT 'p_brand' AS "column", coalesce(a.c, b.c) AS category, a.c IS NOT NULL AS in_real, b.c IS NOT NULL AS in_synthetic FROM a FULL JOIN b ON a.c = b.c""")
def category_coverage(spark, sf):
    part = table(spark, sf, "part")
    return cmp.category_coverage(part, part.withColumn("p_brand", F.replace("p_brand", F.lit("2"), F.lit("7"))), ["p_brand"])
