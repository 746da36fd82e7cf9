"""Quantiles and distribution functions against numpy brute force, on both the small and the bucketed path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.cdf import build_axis, rank_quantiles, two_sample
from tabloom.operators.quantiles import exact_quantiles, median


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    n = 6000
    x = rng.lognormal(size=n)
    x[: n // 3] = 1.5  # one value holds a third of the rows
    y = np.round(rng.normal(size=n), 1)
    g = rng.choice(["a", "b", "c"], size=n, p=[0.7, 0.2, 0.1])
    rows = [(float(a), float(b) if i % 7 else None, str(c)) for i, (a, b, c) in enumerate(zip(x, y, g))]
    return rows, spark.createDataFrame(rows, "`x %` double, `y.z` double, g string").repartition(5).cache()


def brute_ks_w(a, b):
    axis = np.unique(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), axis, side="right") / len(a)
    g = np.searchsorted(np.sort(b), axis, side="right") / len(b)
    return np.abs(f - g).max(), float((np.abs(f - g)[:-1] * np.diff(axis)).sum())


@pytest.mark.parametrize("limit", [10_000_000, 50])
def test_quantiles(sample, limit):
    rows, df = sample
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, {"x": F.col("`x %`"), "y": F.col("`y.z`")}, probs, limit=limit, accuracy=100, sample_rows=500)
    xs = np.array([r[0] for r in rows])
    ys = np.array([r[1] for r in rows if r[1] is not None])
    for p in probs:
        assert got["x"][p] == pytest.approx(np.quantile(xs, p), rel=1e-12)
        assert got["y"][p] == pytest.approx(np.quantile(ys, p), rel=1e-12, abs=1e-12)


def test_quantile_edges(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    assert median(df, {"a": F.col("a"), "b": F.col("b")}) == {"a": 1.0, "b": None}
    assert exact_quantiles(df.limit(1), {"a": F.col("a")}, [0.1, 0.9])["a"] == {0.1: 1.0, 0.9: 1.0}


@pytest.mark.parametrize("per_bucket", [10_000_000, 300])
def test_two_sample(sample, per_bucket):
    rows, df = sample
    axis = build_axis(df, ["x %", "y.z"], "g", rows_per_bucket=per_bucket)
    assert axis.bucketed == (per_bucket == 300)
    got = {(r["column"], r["label_a"], r["label_b"]): r for r in two_sample(axis).collect()}
    assert len(got) == 6
    for i, c in enumerate(["x %", "y.z"]):
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            va, vb = (np.array([r[i] for r in rows if r[2] == g and r[i] is not None]) for g in (a, b))
            ks, w = brute_ks_w(va, vb)
            r = got[(c, a, b)]
            assert (r["n_a"], r["n_b"]) == (len(va), len(vb))
            assert r["ks"] == pytest.approx(ks, abs=1e-12)
            assert r["wasserstein"] == pytest.approx(w, rel=1e-9)


@pytest.mark.parametrize("per_bucket", [10_000_000, 300])
@pytest.mark.parametrize("m", [1, 2, 5, 100])
def test_rank_quantiles(sample, per_bucket, m):
    rows, df = sample
    got = rank_quantiles(build_axis(df, ["x %", "y.z"], "g", rows_per_bucket=per_bucket), m).collect()
    assert len(got) == 2 * 3 * m
    for r in got:
        i = 0 if r["column"] == "x %" else 1
        v = np.array([q[i] for q in rows if q[2] == r["label"] and q[i] is not None])
        assert r["value"] == pytest.approx(np.percentile(v, 100 * r["p"]), rel=1e-9, abs=1e-12)


def test_distance_to_self_is_zero(spark):
    df = spark.range(100).selectExpr("cast(id as double) v", "case when id % 2 = 0 then 'a' else 'b' end g")
    both = df.selectExpr("v", "'a' g").unionAll(df.selectExpr("v", "'b' g"))
    r = two_sample(build_axis(both, ["v"], "g")).first()
    assert r["ks"] == 0.0 and r["wasserstein"] == 0.0


@pytest.mark.parametrize("per_bucket", [100_000, 200])
@pytest.mark.parametrize("against", [None, "3"])
def test_many_labels(spark, per_bucket, against):
    rng = np.random.default_rng(3)
    rows = [(str(int(g)), round(float(x), 2), None if g == 5 else float(x > 0)) for g, x in zip(rng.integers(0, 70, 2500), rng.normal(size=2500))]
    df = spark.createDataFrame(rows, "g string, u double, v double").repartition(4)
    axis = build_axis(df, ["u", "v"], "g", rows_per_bucket=per_bucket)
    got = {(r["column"], r["label_a"], r["label_b"]): r for r in two_sample(axis, against, min_size=2).collect()}
    labels = sorted({r[0] for r in rows})
    expected = 0
    for at, name in ((1, "u"), (2, "v")):
        values = {g: np.array([r[at] for r in rows if r[0] == g and r[at] is not None]) for g in labels}
        full = [g for g in labels if len(values[g]) >= 2]
        pairs = [(a, b) for i, a in enumerate(full) for b in full[i + 1:]] if against is None else [(against, b) for b in full if b != against]
        expected += len(pairs)
        for a, b in pairs:
            r = got[name, a, b]
            assert (r["ks"], r["wasserstein"]) == pytest.approx(brute_ks_w(values[a], values[b]), abs=1e-12)
            assert (r["n_a"], r["n_b"]) == (len(values[a]), len(values[b]))
    assert len(got) == expected


def test_named_labels_pass_the_bound(spark):
    df = spark.range(60).selectExpr("cast(id % 20 as string) g", "cast(id as double) v")
    with pytest.raises(ValueError):
        build_axis(df, ["v"], "g", max_labels=10)
    assert two_sample(build_axis(df, ["v"], "g", ["1", "7"], max_labels=10)).count() == 1


def test_tiny_labels(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("c", None), (None, 9.0)], "g string, v double")
    axis = build_axis(df, ["v"], "g")
    assert axis.labels == ["a", "b", "c"]
    assert [r.asDict() for r in two_sample(axis, min_size=1).collect()] == [
        {"column": "v", "label_a": "a", "label_b": "b", "n_a": 1, "n_b": 2, "ks": 0.5, "wasserstein": 1.0}]
    assert two_sample(axis, min_size=3).count() == 0
    values = {(r["label"], r["j"]): r["value"] for r in rank_quantiles(axis, 5).collect()}
    assert values[("a", 4)] == 1.0 and values[("b", 2)] == 2.0 and ("c", 0) not in values
