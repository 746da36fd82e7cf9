"""Profiles, rules on distributions, outliers, correlation, normality."""

from itertools import combinations

from pyspark.sql import functions as F

from registry import query, rounded, table, view_sql
from registry.cleaning import EVENTS, extreme_events, gappy_part
from registry.inputs import EXTREMES, GAPPY_PART, GAPS
from tabloom.functions.names import col
from tabloom.functions.normal import cdf_sql, ppf_sql
from tabloom.operators import correlation as corr
from tabloom.operators import normality, outliers, profile, rules
from tabloom.operators.quantiles import exact_quantiles

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def moments_sql(relation, columns):
    """One row per column with spelled-out central moments."""
    parts = []
    for c in columns:
        q = f'"{c}"'
        parts.append(f"""SELECT '{c}' AS "column", count({q}) AS n, CAST(min({q}) AS DOUBLE) AS min, CAST(max({q}) AS DOUBLE) AS max,
            max({q}) - min({q}) AS range, avg({q}) AS mean, stddev_samp({q}) AS std, var_samp({q}) AS variance,
            avg(power({q} - m, 3)) / power(avg(power({q} - m, 2)), 1.5) AS skewness,
            avg(power({q} - m, 4)) / power(avg(power({q} - m, 2)), 2) - 3 AS kurtosis,
            CASE WHEN avg({q}) = 0 THEN CAST('inf' AS DOUBLE) ELSE abs(stddev_samp({q}) / avg({q})) END AS cv,
            avg(CASE WHEN {q} = 0 THEN 1e0 WHEN {q} IS NOT NULL THEN 0e0 END) AS zero_share, median({q}) AS median
            FROM (SELECT {q}, avg({q}) OVER () AS m FROM {relation})""")
    return " UNION ALL ".join(parts)


MEASURES = ["min", "max", "range", "mean", "std", "variance", "skewness", "kurtosis", "cv", "zero_share", "median"]
SMALL = {"variance": 2, "mean": 4, "std": 4}


def shown(digits=6):
    return ", ".join(f"round({m}, {SMALL.get(m, digits)}) AS {m}" for m in MEASURES)


@query("profile_numeric", f"""WITH p AS ({moments_sql("lineitem", LINE)}) SELECT "column", n, {shown()} FROM p""")
def profile_numeric(spark, sf):
    return rounded(profile.numeric_profile(table(spark, sf, "lineitem"), LINE), 6, **SMALL)


@query("profile_with_gaps", f"""WITH g AS ({view_sql("part", GAPPY_PART)}), p AS ({moments_sql("g", GAPS)}) SELECT "column", n, {shown()} FROM p""")
def profile_with_gaps(spark, sf):
    return rounded(profile.numeric_profile(gappy_part(spark, sf), GAPS), 6, **SMALL)


FLAGS = """rtrim(CASE WHEN abs(skewness) > 1 THEN 'highly_skewed,' ELSE '' END || CASE WHEN kurtosis > 3 THEN 'heavy_tailed,' ELSE '' END
    || CASE WHEN zero_share > 0.1 THEN 'zero_inflated,' ELSE '' END
    || CASE WHEN min >= 0 AND max <= 100 AND contains("column", '%') THEN 'bounded_percentage,' ELSE '' END, ',')"""
CONCERNS = """rtrim(CASE WHEN abs(skewness) > 1 THEN 'extreme_skewness,' ELSE '' END || CASE WHEN kurtosis > 3 THEN 'heavy_tails,' ELSE '' END
    || CASE WHEN cv > 2 THEN 'high_relative_variance,' ELSE '' END, ',')"""


@query("distribution_flags", f"""{EVENTS}, p AS ({moments_sql("e", EXTREMES)}) SELECT "column", {FLAGS} AS characteristics, {CONCERNS} AS concerns,
    {CONCERNS} = '' AS suitable FROM p""")
def distribution_flags(spark, sf):
    flags = rules.distribution_flags(profile.numeric_profile(extreme_events(spark, sf), EXTREMES, with_median=False))
    return flags.select("column", F.array_join("characteristics", ",").alias("characteristics"),
                        F.array_join("concerns", ",").alias("concerns"), "suitable")


@query("scale_compat", f"""{EVENTS}, p AS ({moments_sql("e", EXTREMES)}), r AS (SELECT max(range) / min(CASE WHEN range > 0 THEN range END) AS scale_ratio FROM p)
    SELECT round(scale_ratio, 6) AS scale_ratio, CASE WHEN scale_ratio > 100 THEN 'incompatible' WHEN scale_ratio > 10 THEN 'moderate'
    ELSE 'compatible' END AS scale_compatibility FROM r""")
def scale_compat(spark, sf):
    p = profile.numeric_profile(extreme_events(spark, sf), EXTREMES, with_median=False)
    return rounded(rules.scale_compatibility(profile.scale_ratio(p)))


PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("exact_quantiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS p, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"""
    for c in LINE for p in PROBS))
def quantile_query(spark, sf):
    found = exact_quantiles(table(spark, sf, "lineitem"), {c: col(c) for c in LINE}, PROBS)
    rows = [(c, p, v) for c, by_p in found.items() for p, v in by_p.items()]
    return rounded(spark.createDataFrame(rows, "column string, p double, value double"))


def fences_sql(relation, columns):
    parts = []
    for c in columns:
        q = f'"{c}"'
        parts.append(f"""SELECT '{c}' AS "column", count({q}) AS n, max(q1) AS q1, max(q3) AS q3, max(q1 - 1.5e0 * (q3 - q1)) AS lower,
            max(q3 + 1.5e0 * (q3 - q1)) AS upper, CAST(max({q}) AS DOUBLE) AS max,
            CAST(sum(CASE WHEN {q} < q1 - 1.5e0 * (q3 - q1) OR {q} > q3 + 1.5e0 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
            FROM {relation}, (SELECT quantile_cont({q}, 0.25) AS q1, quantile_cont({q}, 0.75) AS q3 FROM {relation})""")
    return " UNION ALL ".join(parts)


OUTLIER_COLUMNS = ", ".join(f"round({m}, 6) AS {m}" for m in ("q1", "q3", "lower", "upper", "max"))


@query("iqr_outliers", f"""{EVENTS}, f AS ({fences_sql("e", EXTREMES)}) SELECT "column", n, {OUTLIER_COLUMNS}, n_outliers,
    round(n_outliers * 100e0 / n, 6) AS pct_outliers FROM f""")
def iqr_outliers(spark, sf):
    return rounded(outliers.iqr_outliers(extreme_events(spark, sf), EXTREMES))


@query("outlier_rows", f"""{EVENTS}, f AS ({fences_sql("e", EXTREMES)}), l AS ({" UNION ALL ".join(
    f'''SELECT event_id, '{c}' AS col, "{c}" AS value FROM e''' for c in EXTREMES)}) SELECT event_id, col AS "column", round(value, 6) AS value
    FROM l JOIN f ON col = "column" WHERE value < lower OR value > upper""")
def outlier_rows(spark, sf):
    return rounded(outliers.outlier_rows(extreme_events(spark, sf), "event_id", EXTREMES))


@query("mad_outliers", f"""{EVENTS}, m AS ({" UNION ALL ".join(
    f'''SELECT '{c}' AS "column", count(*) AS n, max(med) AS median, max(d) AS mad,
    CAST(sum(CASE WHEN abs(0.6745e0 * ("{c}" - med) / d) > 3.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
    FROM e, (SELECT median("{c}") AS med, mad("{c}") AS d FROM e)''' for c in EXTREMES)}) SELECT "column", n, round(median, 6) AS median,
    round(mad, 6) AS mad, n_outliers, round(n_outliers * 100e0 / n, 6) AS pct_outliers FROM m""")
def mad_outliers(spark, sf):
    return rounded(outliers.mad_outliers(extreme_events(spark, sf), EXTREMES))


CLASS = """CASE WHEN n_outliers > 0 AND max > (q3 + 3 * (q3 - q1)) * 10 THEN '{a}' WHEN "column" IN ('share %') AND max > 100 {some} THEN '{b}'
    {natural} END"""
IMPACT = "CASE WHEN n_outliers * 100e0 / n > 10 THEN 'HIGH' WHEN n_outliers > 0 THEN 'MODERATE' ELSE 'LOW' END AS synthetic_impact"


def class_sql(always):
    some = "" if always else "AND n_outliers > 0"
    natural = "ELSE 'NATURAL_VARIATION'" if always else "WHEN n_outliers > 0 THEN 'NATURAL_VARIATION'"
    return (f"""{EVENTS}, f AS ({fences_sql("e", EXTREMES)}) SELECT "column", n_outliers,
        {CLASS.format(a="MEASUREMENT_ERROR", b="IMPOSSIBLE_VALUE", some=some, natural=natural)} AS classification,
        {CLASS.format(a="INVESTIGATE", b="REMOVE", some=some, natural="ELSE 'RETAIN'")} AS treatment, {IMPACT} FROM f""")


@query("outlier_class", class_sql(False))
def outlier_class(spark, sf):
    table_ = rules.outlier_class(outliers.iqr_outliers(extreme_events(spark, sf), EXTREMES), ["share %"])
    return table_.select("column", "n_outliers", "classification", "treatment", "synthetic_impact")


@query("outlier_class_always", class_sql(True))
def outlier_class_always(spark, sf):
    table_ = rules.outlier_class(outliers.iqr_outliers(extreme_events(spark, sf), EXTREMES), ["share %"], always=True)
    return table_.select("column", "n_outliers", "classification", "treatment", "synthetic_impact")


@query("executive_facts", f"""{EVENTS}, f AS ({fences_sql("e", EXTREMES)}), p AS ({moments_sql("e", EXTREMES)}) SELECT
    (SELECT count(*) FROM p WHERE {CONCERNS} <> '') AS columns_with_concerns,
    (SELECT count(*) FROM f WHERE n_outliers > 0 AND (max > (q3 + 3 * (q3 - q1)) * 10 OR ("column" = 'share %' AND max > 100))) AS columns_with_severe_outliers""")
def executive_facts(spark, sf):
    df = extreme_events(spark, sf)
    flags = rules.distribution_flags(profile.numeric_profile(df, EXTREMES, with_median=False))
    classes = rules.outlier_class(outliers.iqr_outliers(df, EXTREMES), ["share %"])
    both = flags.select((~F.col("suitable")).alias("a"), F.lit(False).alias("b")).unionByName(
        classes.select(F.lit(False).alias("a"), (F.col("treatment") != "RETAIN").alias("b")))
    return both.agg(F.count_if("a").alias("columns_with_concerns"), F.count_if("b").alias("columns_with_severe_outliers"))


def corr_sql(relation, columns):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, CASE WHEN stddev_pop("{a}") * stddev_pop("{b}") = 0 THEN NULL
        ELSE round(covar_pop("{a}", "{b}") / (stddev_pop("{a}") * stddev_pop("{b}")), 6) END AS corr FROM {relation}
        WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL""" for a, b in combinations(columns, 2))


@query("corr_matrix", f"""WITH g AS (SELECT *, 1e0 AS one FROM ({view_sql("part", GAPPY_PART)})) {corr_sql("g", [*GAPS, "one"])}""")
def corr_matrix(spark, sf):
    return rounded(corr.correlation(gappy_part(spark, sf).withColumn("one", F.lit(1.0)), [*GAPS, "one"]))


@query("corr_matrix_blocks", f"""WITH g AS (SELECT *, 1e0 AS one FROM ({view_sql("part", GAPPY_PART)})) {corr_sql("g", [*GAPS, "one"])}""")
def corr_matrix_blocks(spark, sf):
    """The path for many columns: one block of products per task."""
    return rounded(corr.block_correlation(gappy_part(spark, sf).withColumn("one", F.lit(1.0)), [*GAPS, "one"]))


@query("corr_range", f"""WITH a AS ({corr_sql("lineitem", LINE)}), g AS ({view_sql("part", GAPPY_PART)}), b AS ({corr_sql("g", GAPS)})
    SELECT least(min(corr), 1e0) AS lowest, greatest(max(corr), 1e0) AS highest FROM (SELECT corr FROM a UNION ALL SELECT corr FROM b)""")
def corr_range(spark, sf):
    return rounded(corr.correlation_range([corr.correlation(table(spark, sf, "lineitem"), LINE), corr.correlation(gappy_part(spark, sf), GAPS)]))


@query("vif", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem),
    d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
    SELECT 'l_quantity' AS "column", round((1 - bc * bc) / det, 6) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - ac * ac) / det, 6) FROM d
    UNION ALL SELECT 'l_discount', round((1 - ab * ab) / det, 6) FROM d""")
def vif(spark, sf):
    return rounded(corr.variance_inflation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


def shapiro_sql(relation, columns):
    """Royston's steps in plain SQL over sorted values; ranks, weights and sums are separate steps."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM {relation} WHERE {c} IS NOT NULL" for c in columns)
    poly = {
        "a": "-2.706056 * power(u, 5) + 4.434685 * power(u, 4) - 2.07119 * power(u, 3) - 0.147981 * power(u, 2) + 0.221157 * u",
        "b": "-3.582633 * power(u, 5) + 5.682633 * power(u, 4) - 1.752461 * power(u, 3) - 0.293762 * power(u, 2) + 0.042981 * u"}
    return f"""WITH l AS ({long}), s AS (SELECT col, x, row_number() OVER (PARTITION BY col ORDER BY x) AS r, count(*) OVER (PARTITION BY col) AS n FROM l),
        p AS (SELECT *, (r - 0.375e0) / (n + 0.25e0) AS p FROM s WHERE n BETWEEN 12 AND 4999), m AS (SELECT *, {ppf_sql("p")} AS m FROM p),
        t AS (SELECT col, n, sum(m * m) AS mm, sum(CASE WHEN r = n THEN m END) AS mn, sum(CASE WHEN r = n - 1 THEN m END) AS mn1, 1 / sqrt(n) AS u,
            var_pop(x) * n AS ss FROM m GROUP BY col, n),
        w AS (SELECT *, {poly["a"]} + mn / sqrt(mm) AS an, {poly["b"]} + mn1 / sqrt(mm) AS an1 FROM t),
        f AS (SELECT *, sqrt((mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)) AS scale FROM w),
        stat AS (SELECT f.col, f.n, power(sum(x * CASE WHEN r = 1 THEN -an WHEN r = f.n THEN an WHEN r = 2 THEN -an1 WHEN r = f.n - 1 THEN an1 ELSE m / scale END), 2) / max(ss) AS w
            FROM f JOIN m ON m.col = f.col GROUP BY f.col, f.n),
        z AS (SELECT *, ln(n) AS y, (ln(1 - w) - (0.0038915 * power(ln(n), 3) - 0.083751 * power(ln(n), 2) - 0.31082 * ln(n) - 1.5861))
            / exp(0.0030302 * power(ln(n), 2) - 0.082676 * ln(n) - 0.4803) AS z FROM stat)
        SELECT col AS "column", n, round(w, 6) AS w, z > 1.6448536269514722 AS non_normal FROM z"""


@query("shapiro", shapiro_sql("supplier", ["s_acctbal", "s_nationkey"]))
def shapiro(spark, sf):
    tests = normality.shapiro(table(spark, sf, "supplier"), ["s_acctbal", "s_nationkey"])
    return rounded(tests.select("column", "n", "w", (F.col("p_value") < 0.05).alias("non_normal")))


SHAPIRO_PARTS = [("customer", ["c_acctbal"]), ("part", ["p_size", "p_retailprice"]), ("supplier", ["s_acctbal"]),
                 ("nation", ["n_nationkey"]), ("region", ["r_regionkey"])]


def shapiro_p_sql():
    """All branches of the statistic and of its p-value: 3 values, 4 and 5, up to 11, and more."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM {t} WHERE {c} IS NOT NULL" for t, cs in SHAPIRO_PARTS for c in cs)
    outer = "0.221157 * u - 0.147981 * power(u, 2) - 2.07119 * power(u, 3) + 4.434685 * power(u, 4) - 2.706056 * power(u, 5)"
    second = "0.042981 * u - 0.293762 * power(u, 2) - 1.752461 * power(u, 3) + 5.682633 * power(u, 4) - 3.582633 * power(u, 5)"
    return f"""WITH l AS ({long}), s AS (SELECT col, x, row_number() OVER (PARTITION BY col ORDER BY x) AS r, count(*) OVER (PARTITION BY col) AS n FROM l),
        p AS (SELECT *, (r - 0.375e0) / (n + 0.25e0) AS p FROM s WHERE n BETWEEN 3 AND 4999), m AS (SELECT *, {ppf_sql("p")} AS m FROM p),
        t AS (SELECT col, n, sum(m * m) AS mm, max(m) AS mn, max(CASE WHEN r = n - 1 THEN m END) AS mn1, 1 / sqrt(n) AS u, var_pop(x) * n AS ss
            FROM m GROUP BY col, n),
        w AS (SELECT *, {outer} + mn / sqrt(mm) AS an, {second} + mn1 / sqrt(mm) AS an1 FROM t WHERE ss > 0),
        f AS (SELECT *, CASE WHEN n <= 5 THEN sqrt(abs((mm - 2 * mn * mn) / (1 - 2 * an * an)))
            ELSE sqrt(abs((mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1))) END AS scale FROM w),
        g AS (SELECT m.col, m.n, x, ss, CASE WHEN m.n = 3 THEN sqrt(0.5e0) * (r - 2) WHEN r = 1 THEN -an WHEN r = m.n THEN an
            WHEN m.n > 5 AND r = 2 THEN -an1 WHEN m.n > 5 AND r = m.n - 1 THEN an1 ELSE m / scale END AS weight FROM m JOIN f ON f.col = m.col),
        stat AS (SELECT col, n, power(sum(x * weight), 2) / max(ss) AS w FROM g GROUP BY col, n),
        z AS (SELECT *, CASE WHEN n = 3 THEN 0e0 WHEN n <= 11 THEN CASE WHEN ln(1 - w) >= 0.459e0 * n - 2.273e0 THEN 40e0
            ELSE (-ln(0.459e0 * n - 2.273e0 - ln(1 - w)) - (0.544e0 - 0.39978e0 * n + 0.025054e0 * n * n - 0.0006714e0 * n * n * n))
                / exp(1.3822e0 - 0.77857e0 * n + 0.062767e0 * n * n - 0.0020322e0 * n * n * n) END
            ELSE (ln(1 - w) - (0.0038915 * power(ln(n), 3) - 0.083751 * power(ln(n), 2) - 0.31082 * ln(n) - 1.5861))
                / exp(0.0030302 * power(ln(n), 2) - 0.082676 * ln(n) - 0.4803) END AS z FROM stat)
        SELECT col AS "column", n, round(w, 6) AS w, round(CASE WHEN n = 3 THEN CASE WHEN w <= 0.75 THEN 0e0 ELSE 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75e0))) END
            ELSE {cdf_sql("(-z)")} END, 6) AS p_value FROM z"""


@query("shapiro_p_values", shapiro_p_sql())
def shapiro_p_values(spark, sf):
    out = None
    for name, columns in SHAPIRO_PARTS:
        one = normality.shapiro(table(spark, sf, name), columns)
        out = one if out is None else out.unionByName(one)
    return rounded(out)
