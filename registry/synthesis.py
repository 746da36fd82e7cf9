"""One-hot codes, marginals, normal scores, copula, sampling."""

from itertools import combinations

from pyspark.sql import functions as F

from registry import query, rounded, table, view, view_sql
from tabloom.functions.cells import argmax, softmax
from tabloom.functions.normal import cdf_sql, ppf_sql
from tabloom.operators import copula, encode, marginal, sparse
from tabloom.operators.compare import category_coverage, moments_side_by_side
from tabloom.plans.synthesis import learn
from tabloom.session import shared_folder
from tabloom.sources.models import load_model, save_model

NUMERIC = ["p_retailprice", "p_size"]
LABEL = "p_type"


def part(spark, sf):
    df = table(spark, sf, "part")
    return df.select("p_partkey", *[F.col(c).cast("double").alias(c) for c in NUMERIC], LABEL)


CATEGORIES = "cats AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS i, (SELECT count(DISTINCT p_type) FROM part) AS k FROM (SELECT DISTINCT p_type FROM part))"


@query("one_hot", f"""WITH {CATEGORIES} SELECT p_partkey, array_to_string([CASE WHEN j = i THEN 1 ELSE 0 END FOR j IN range(k)], '') AS code
    FROM part JOIN cats ON cats.p_type = part.p_type""")
def one_hot(spark, sf):
    df = part(spark, sf)
    out = encode.fit_one_hot(df, [LABEL]).transform(df, [LABEL])
    return out.select("p_partkey", F.array_join(F.transform("onehot", lambda v: v.cast("int").cast("string")), "").alias("code"))


@query("one_hot_unseen", """WITH cats AS (SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO') SELECT p_partkey,
    CASE WHEN part.p_type IN (SELECT p_type FROM cats) THEN p_type ELSE (SELECT min(p_type) FROM cats) END AS decoded FROM part""")
def one_hot_unseen(spark, sf):
    """Encode, then decode; a label the encoder never saw falls to the first category."""
    df = part(spark, sf)
    fitted = encode.fit_one_hot(df.where("p_type <> 'PROMO'"), [LABEL])
    return fitted.inverse(fitted.transform(df, [LABEL]), [LABEL]).select("p_partkey", F.col(LABEL).alias("decoded"))


@query("one_hot_width", "SELECT count(DISTINCT p_type) + count(DISTINCT p_brand) AS width FROM part")
def one_hot_width(spark, sf):
    model = encode.fit_one_hot(table(spark, sf, "part"), ["p_type", "p_brand"])
    return spark.createDataFrame([(model.width(),)], "width bigint")


# An encoding with as many categories as rows: customers, totals in cents, priorities.
WIDE = {"o_orderkey": "o_orderkey", "customer": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END",
        "cents": "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING)", "priority": "o_orderpriority"}
WIDE_SQL = f"""WITH o AS ({view_sql("orders", WIDE)}), l AS ({" UNION ALL ".join(
    f"SELECT o_orderkey, {i} AS ci, '{c}' AS \"column\", {c} AS category FROM o" for i, c in enumerate(list(WIDE)[1:]))}),
    d AS (SELECT ci, category, CAST(row_number() OVER (ORDER BY ci, category) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT ci, category FROM l WHERE category IS NOT NULL)),
    firsts AS (SELECT ci, min(place) AS place FROM d GROUP BY ci),
    e AS (SELECT l.o_orderkey, l.ci, l."column", coalesce(d.place, firsts.place) AS place FROM l JOIN firsts ON firsts.ci = l.ci
        LEFT JOIN d ON d.ci = l.ci AND d.category = l.category)"""


def wide_orders(spark, sf):
    return view(table(spark, sf, "orders"), WIDE)


@query("one_hot_sparse", f'{WIDE_SQL} SELECT o_orderkey, "column", place FROM e')
def one_hot_sparse(spark, sf):
    df = wide_orders(spark, sf)
    return sparse.fit_sparse(df, list(WIDE)[1:]).transform(df, "o_orderkey")


@query("one_hot_sparse_decoded", f'{WIDE_SQL} SELECT e.o_orderkey, e."column", d.category FROM e JOIN d ON d.place = e.place')
def one_hot_sparse_decoded(spark, sf):
    df = wide_orders(spark, sf)
    fitted = sparse.fit_sparse(df, list(WIDE)[1:])
    return fitted.inverse(fitted.transform(df, "o_orderkey"), "o_orderkey")


@query("one_hot_sparse_correlation", f"""{WIDE_SQL}, c AS (SELECT place, CAST(count(*) AS DOUBLE) AS k, (SELECT CAST(count(*) AS DOUBLE) FROM o) AS n FROM e GROUP BY place),
    b AS (SELECT x.place AS a, y.place AS b, count(*) AS n_both FROM e x JOIN e y ON x.o_orderkey = y.o_orderkey AND x.place < y.place GROUP BY x.place, y.place)
    SELECT a, b, n_both, round((ca.n * n_both - ca.k * cb.k) / (sqrt(ca.k * (ca.n - ca.k)) * sqrt(cb.k * (cb.n - cb.k))), 6) AS corr
    FROM b JOIN c ca ON ca.place = a JOIN c cb ON cb.place = b""")
def one_hot_sparse_correlation(spark, sf):
    df = wide_orders(spark, sf)
    return rounded(sparse.indicator_correlation(sparse.fit_sparse(df, list(WIDE)[1:]).transform(df, "o_orderkey"), "o_orderkey"))


@query("softmax_argmax", """WITH v AS (SELECT event_id, [value / 100, event_id % 7 / 3e0, (event_id % 11) / 4e0] AS v FROM events),
    e AS (SELECT event_id, v, [exp(x - list_max(v)) FOR x IN v] AS e FROM v) SELECT event_id, round(e[1] / list_sum(e), 9) AS p1, round(e[2] / list_sum(e), 9) AS p2,
    CAST(list_position(v, list_max(v)) - 1 AS INT) AS best FROM e""")
def softmax_argmax(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.expr("array(value / 100, event_id % 7 / 3D, (event_id % 11) / 4D)").alias("v"))
    soft = df.withColumn("p", softmax(F.col("v")))
    return rounded(soft.select("event_id", F.col("p")[0].alias("p1"), F.col("p")[1].alias("p2"), argmax(F.col("v")).alias("best")), 9)


@query("one_hot_sampled")
def one_hot_sampled(spark, sf):
    df = part(spark, sf)
    fitted = encode.fit_one_hot(df, [LABEL])
    return fitted.inverse(fitted.transform(df, [LABEL]), [LABEL], sample_seed=7, key="p_partkey").select("p_partkey", LABEL)


def kde_sql(c):
    """CTEs ending in ``grid_c``: the density of one column by summing every kernel at every grid point."""
    return f"""q_{c} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.01) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS b, min({c}) AS lo, max({c}) AS hi FROM part),
        t_{c} AS (SELECT CAST({c} AS DOUBLE) AS x FROM part, q_{c} WHERE {c} BETWEEN a AND b),
        h_{c} AS (SELECT power(count(*) * 0.75e0, -0.2e0) * stddev_samp(x) AS h, count(*) AS n FROM t_{c}),
        u_{c} AS (SELECT x, count(*) AS c FROM t_{c} GROUP BY x),
        axis_{c} AS (SELECT CAST(range AS INT) AS gi, lo - (hi - lo) * 0.1e0 + range * ((hi - lo) * 1.2e0 / 999) AS g FROM range(0, 1000), q_{c}),
        pdf_{c} AS (SELECT gi, g, sum(c * exp(-0.5e0 * power((g - x) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS pdf FROM axis_{c}, u_{c}, h_{c} GROUP BY gi, g),
        step_{c} AS (SELECT gi, g, pdf, coalesce((pdf + lag(pdf) OVER (ORDER BY gi)) / 2 * (g - lag(g) OVER (ORDER BY gi)), 0) AS s FROM pdf_{c}),
        grid_{c} AS (SELECT gi, g, pdf, sum(s) OVER (ORDER BY gi) / (SELECT sum(s) FROM step_{c}) AS cdf FROM step_{c})"""


KDE = ", ".join(kde_sql(c) for c in NUMERIC)


@query("kde_marginal", f"""WITH {KDE} {" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", gi, round(g, 6) AS x, round(pdf, 9) AS pdf, round(cdf, 9) AS cdf FROM grid_{c}" for c in NUMERIC)}""")
def kde_marginal(spark, sf):
    return rounded(marginal.grid_table(spark, marginal.fit_marginals(part(spark, sf), NUMERIC)), 9, x=6)


def percentile_sql(c, out):
    return f"""p_{c} AS (SELECT p_partkey, greatest(0.001e0, least(0.999e0, a.cdf + (b.cdf - a.cdf) * ({c} - a.g) / (b.g - a.g))) AS {out} FROM part
        JOIN grid_{c} a ON a.g <= {c} JOIN grid_{c} b ON b.gi = a.gi + 1 AND b.g > {c})"""


PERCENTILES = f"{KDE}, {percentile_sql('p_retailprice', 'u0')}, {percentile_sql('p_size', 'u1')}, u AS (SELECT p_partkey, u0, u1 FROM p_p_retailprice JOIN p_p_size USING (p_partkey))"


@query("kde_percentile", f"WITH {PERCENTILES} SELECT p_partkey, round(u0, 8) AS u0, round(u1, 8) AS u1 FROM u")
def kde_percentile(spark, sf):
    df = part(spark, sf)
    models = marginal.fit_marginals(df, NUMERIC)
    return rounded(marginal.with_percentiles(df, models, {"p_retailprice": "u0", "p_size": "u1"}).select("p_partkey", "u0", "u1"), 8)


@query("normal_scores", f"WITH {PERCENTILES} SELECT p_partkey, round({ppf_sql('u0')}, 7) AS z0, round({ppf_sql('u1')}, 7) AS z1 FROM u")
def normal_scores(spark, sf):
    df = part(spark, sf)
    models = marginal.fit_marginals(df, NUMERIC)
    coded = marginal.with_percentiles(df, models, {"p_retailprice": "u0", "p_size": "u1"})
    return rounded(copula.with_scores(coded, {"z0": "u0", "z1": "u1"}).select("p_partkey", "z0", "z1"), 7)


@query("scores_to_percentiles", f"""WITH z AS (SELECT c_custkey, c_acctbal / 2500 AS z FROM customer) SELECT c_custkey,
    round(greatest(1e-6, least(1e0 - 1e-6, {cdf_sql('z')})), 9) AS u FROM z""")
def scores_to_percentiles(spark, sf):
    z = table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal / 2500 AS z")
    return rounded(z.selectExpr("c_custkey", f"greatest(1e-6, least(1e0 - 1e-6, {cdf_sql('z')})) AS u"), 9)


#: The inverse as SQL: the spline's slopes by elimination along the kept grid points (``f``) and back (``b``), then its cubic on each interval.
SPLINE = f"""WITH RECURSIVE {KDE}, y AS MATERIALIZED (SELECT row_number() OVER (ORDER BY gi) AS i, count(*) OVER () AS n, g AS x, cdf AS u
    FROM (SELECT *, cdf - lag(cdf) OVER (ORDER BY gi) AS rise FROM grid_p_retailprice) WHERE rise IS NULL OR rise > 1e-10),
    h AS MATERIALIZED (SELECT *, lead(u) OVER w - u AS d, (lead(x) OVER w - x) / (lead(u) OVER w - u) AS r FROM y WINDOW w AS (ORDER BY i)),
    e AS MATERIALIZED (SELECT *, lag(d) OVER w AS d0, lag(r) OVER w AS r0, lead(d) OVER w AS d1, lead(r) OVER w AS r1, lag(d, 2) OVER w AS d00, lag(r, 2) OVER w AS r00 FROM h WINDOW w AS (ORDER BY i)),
    t AS MATERIALIZED (SELECT i, n, CASE WHEN i = 1 THEN 0e0 WHEN i = n THEN d0 + d00 ELSE d END AS lo, CASE WHEN i = 1 THEN d1 WHEN i = n THEN d00 ELSE 2 * (d0 + d) END AS ma,
        CASE WHEN i = 1 THEN d + d1 WHEN i = n THEN 0e0 ELSE d0 END AS hi, CASE WHEN i = 1 THEN ((d + 2 * (d + d1)) * d1 * r + d * d * r1) / (d + d1)
        WHEN i = n THEN ((d0 + 2 * (d0 + d00)) * d00 * r0 + d0 * d0 * r00) / (d0 + d00) ELSE 3 * (d * r0 + d0 * r) END AS ri FROM e),
    f(i, hi, ma, ri) AS (SELECT i, hi, ma, ri FROM t WHERE i = 1 UNION ALL SELECT t.i, t.hi, t.ma - t.lo / f.ma * f.hi, t.ri - t.lo / f.ma * f.ri FROM f JOIN t ON t.i = f.i + 1),
    g AS MATERIALIZED (SELECT * FROM f), b(i, s) AS (SELECT i, ri / ma FROM g WHERE i = (SELECT max(i) FROM g) UNION ALL
        SELECT g.i, (g.ri - g.hi * b.s) / g.ma FROM b JOIN g ON g.i = b.i - 1),
    k AS MATERIALIZED (SELECT h.i, x, u, u + d AS u2, d, r, b.s, lead(b.s) OVER (ORDER BY h.i) AS s2 FROM h JOIN b ON b.i = h.i),
    z AS (SELECT o_orderkey, (o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) AS q FROM orders),
    c AS (SELECT o_orderkey, greatest(0.001e0, least(0.999e0, q)) AS q FROM z),
    v AS (SELECT o_orderkey, x, s, q - u AS t, (r - s) / d - (s + s2 - 2 * r) / d AS c2, (s + s2 - 2 * r) / d / d AS c3 FROM c JOIN k ON k.u <= q AND k.u2 > q)"""


@query("kde_inverse", SPLINE + """ SELECT o_orderkey, round(least(greatest(((c3 * t + c2) * t + s) * t + x, (SELECT lo FROM q_p_retailprice)), (SELECT hi FROM q_p_retailprice)), 4) AS value FROM v""")
def kde_inverse(spark, sf):
    models = marginal.fit_marginals(part(spark, sf), ["p_retailprice"])
    orders = table(spark, sf, "orders")
    lo, hi = orders.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    u = orders.select("o_orderkey", ((F.col("o_totalprice") - lo) / (hi - lo)).alias("u"))
    return rounded(marginal.with_values(u, models, {"p_retailprice": "u"}).select("o_orderkey", F.col("p_retailprice").alias("value")), 4)


Z_HIGH = ppf_sql("9.99e-1")
SCORES = f"""{PERCENTILES}, s AS (SELECT u.p_partkey, {ppf_sql('u0')} AS z0, {ppf_sql('u1')} AS z1, p_type FROM u JOIN part ON part.p_partkey = u.p_partkey),
    t AS (SELECT DISTINCT p_type FROM part)"""


@query("copula_corr", f"""WITH {PERCENTILES}, z AS (SELECT {ppf_sql('u0')} AS z0, {ppf_sql('u1')} AS z1 FROM u) SELECT 'z0' AS col_a, 'z1' AS col_b, count(*) AS n, round(corr(z0, z1), 7) AS corr FROM z""")
def copula_corr(spark, sf):
    df = part(spark, sf)
    return rounded(copula.score_correlation(df, copula.fit_encoder(df, NUMERIC)), 7)


@query("copula_corr_mixed", f"""WITH {PERCENTILES}, {CATEGORIES}, s AS (SELECT u.p_partkey, {ppf_sql('u0')} AS z0, {ppf_sql('u1')} AS z1, i FROM u
    JOIN part ON part.p_partkey = u.p_partkey JOIN cats ON cats.p_type = part.p_type),
    l AS (SELECT p_partkey, 0 AS d, z0 AS z FROM s UNION ALL SELECT p_partkey, 1, z1 FROM s UNION ALL
    SELECT p_partkey, 2 + cats.i, CASE WHEN s.i = cats.i THEN {Z_HIGH} ELSE -({Z_HIGH}) END FROM s, cats)
    SELECT 'z' || a.d AS col_a, 'z' || b.d AS col_b, count(*) AS n, round(corr(a.z, b.z), 6) AS corr FROM l a JOIN l b ON a.p_partkey = b.p_partkey AND a.d < b.d GROUP BY a.d, b.d""")
def copula_corr_mixed(spark, sf):
    df = part(spark, sf)
    return rounded(copula.score_correlation(df, copula.fit_encoder(df, NUMERIC, [LABEL])), 6)


@query("copula_matrix")
def copula_matrix(spark, sf):
    """The repaired correlation of all encoded dimensions, with its condition number."""
    from tabloom.operators.correlation import condition_number

    model = learn(part(spark, sf), NUMERIC, [LABEL])
    names, cond = model.dimensions(), condition_number(model.matrix)
    rows = [(names[i], names[j], float(model.matrix[i, j]), cond) for i, j in combinations(range(model.width), 2)]
    return rounded(spark.createDataFrame(rows, "dim_a string, dim_b string, corr double, condition double"), 6, condition=0)


@query("encoded_range", f"""WITH {PERCENTILES} SELECT count(*) AS n_rows, round(least(min(u0), min(u1), 0.001e0), 6) AS lowest, round(greatest(max(u0), max(u1), 0.999e0), 6) AS highest,
    CAST(2 + (SELECT count(DISTINCT p_type) FROM part) AS INT) AS n_dimensions FROM u""")
def encoded_range(spark, sf):
    df = part(spark, sf)
    model = copula.fit_encoder(df, NUMERIC, [LABEL])
    return rounded(copula.encoded_range(copula.with_uniforms(df, model), model.width))


@query("encode_decode", "SELECT p_partkey, p_type, true AS within FROM part")
def encode_decode(spark, sf):
    """Round trip through percentiles: labels come back, numbers within one grid cell unless clamped."""
    df = part(spark, sf)
    model = copula.fit_encoder(df, NUMERIC, [LABEL])
    coded = copula.with_uniforms(df, model).select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"),
                                                   *[f"u{i}" for i in range(model.width)])
    back = copula.decode(coded, model)
    cell = {c: float(m.grid[1] - m.grid[0]) for c, m in model.marginals.items()}
    inner = F.col("u0").between(0.0011, 0.9989) & F.col("u1").between(0.0011, 0.9989)
    close = (F.abs(F.col("p_retailprice") - F.col("price")) <= cell["p_retailprice"]) & (F.abs(F.col("p_size") - F.col("size")) <= cell["p_size"])
    return back.select("p_partkey", LABEL, (~inner | close).alias("within"))


def synthetic(spark, sf):
    df = part(spark, sf)
    return copula.sample(spark, learn(df, NUMERIC, [LABEL]), df.count(), seed=42)


@query("synth_sample")
def synth_sample(spark, sf):
    return rounded(synthetic(spark, sf), 4)


@query("synth_from_saved_model")
def synth_from_saved_model(spark, sf):
    import uuid

    df = part(spark, sf)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    save_model(spark, learn(df, NUMERIC, [LABEL]), path)
    return rounded(copula.sample(spark, load_model(spark, path), df.count(), seed=42), 4)


@query("synth_summary")
def synth_summary(spark, sf):
    return rounded(moments_side_by_side({"real": part(spark, sf), "synthetic": synthetic(spark, sf)}, NUMERIC), 3)


@query("synth_coverage", """SELECT DISTINCT 'p_type' AS "column", p_type AS category, true AS in_real, true AS in_synthetic FROM part""")
def synth_coverage(spark, sf):
    return category_coverage(part(spark, sf), synthetic(spark, sf), [LABEL])
