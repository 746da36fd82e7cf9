"""Decision rules against the published values they produced."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile, rules


def test_missing_strategy_published(spark):
    # Fixed values: (column, missing of 53, token present, published action).
    published = [
        ("gravity", 8, False, "IMPUTE_KNN"), ("gravel", 5, False, "IMPUTE_MEDIAN"), ("clay", 19, False, "RETAIN_AS_CATEGORY"),
        ("liquid", 3, False, "IMPUTE_MEDIAN"), ("plastic", 3, True, "REPLACE_WITH_ZERO"), ("plasticity", 0, True, "REPLACE_WITH_ZERO"),
        ("omc", 6, False, "IMPUTE_KNN"), ("soaked", 26, False, "RETAIN_AS_CATEGORY"), ("wpi", 43, False, "DROP_COLUMN"), ("sand", 0, False, None)]
    rows = [(c, m, m * 100.0 / 53, 53 - m, 53, t, t) for c, m, t, _ in published]
    summary = spark.createDataFrame(rows, "column string, n_missing bigint, pct_missing double, n_filled bigint, n_rows bigint, "
                                          "has_zero_token boolean, has_special boolean")
    got = {r["column"]: r["action"] for r in rules.missing_strategy(summary, ["plastic", "plasticity"], by_name_only=True).collect()}
    assert got == {c: a for c, _, _, a in published if a}
    odd = summary.withColumn("has_zero_token", F.lit(False))
    assert {r["column"]: r["action"] for r in rules.missing_strategy(odd, ["plastic"]).collect()}["plastic"] is None


def test_flags_published(spark):
    # Fixed values: (skewness, kurtosis, published flags).
    published = [(2.12, 6.93, ["highly_skewed", "heavy_tailed"]), (-1.00008, -0.23, ["highly_skewed"]), (0.758, 1.23, []), (1.612, 2.08, ["highly_skewed"])]
    rows = [(f"c{i}", s, k, 0.0, 1.0, 200.0, 0.5) for i, (s, k, _) in enumerate(published)]
    p = spark.createDataFrame(rows, "column string, skewness double, kurtosis double, zero_share double, min double, max double, cv double")
    got = {r["column"]: r for r in rules.distribution_flags(p, basic=True).collect()}
    assert [got[f"c{i}"]["characteristics"] for i in range(4)] == [f for _, _, f in published]
    assert [got[f"c{i}"]["suitable"] for i in range(4)] == [False, False, True, False]


def test_scale_published(spark):
    p = spark.createDataFrame([("a", 2.8 - 2.221), ("b", 142.0 - 8.45), ("c", 0.0)], "column string, range double")
    r = rules.scale_compatibility(profile.scale_ratio(p)).first()
    assert r["scale_ratio"] == pytest.approx(230.65630397236626) and r["scale_compatibility"] == "incompatible"


@pytest.mark.parametrize("hits,total,verdict,approach", [
    (37, 75, "DO_NOT_POOL", "per_group"), (2, 10, "CAUTION", "pooled"), (1, 10, "POOLING_ACCEPTABLE", "pooled")])
def test_pooling(spark, hits, total, verdict, approach):
    tests = spark.createDataFrame([(0.01 if i < hits else 0.5,) for i in range(total)], "p_value double")
    r = rules.pooling(tests).first()
    assert (r["pooling"], r["approach"]) == (verdict, approach)
    assert r["pct_significant"] == pytest.approx(100 * hits / total)
    assert rules.pooling(tests.limit(0)).count() == 0


def test_outlier_class(spark):
    rows = [("ok", 50, 2.56, 2.75, 2.275, 3.035, 2.8, 2, 4.4), ("wild", 50, 10.0, 15.0, 2.5, 22.5, 1420.0, 1, 2.0),
            ("share", 50, 10.0, 60.0, -65.0, 135.0, 101.0, 0, 0.0), ("share2", 50, 10.0, 15.0, 2.5, 22.5, 120.0, 6, 12.0)]
    t = spark.createDataFrame(rows, "column string, n bigint, q1 double, q3 double, lower double, upper double, max double, n_outliers bigint, pct_outliers double")
    got = {r["column"]: (r["classification"], r["treatment"], r["synthetic_impact"]) for r in rules.outlier_class(t, ["share", "share2"]).collect()}
    assert got["ok"] == ("NATURAL_VARIATION", "RETAIN", "MODERATE")
    assert got["wild"] == ("MEASUREMENT_ERROR", "INVESTIGATE", "MODERATE")
    assert got["share"] == (None, "RETAIN", "LOW")
    assert got["share2"] == ("IMPOSSIBLE_VALUE", "REMOVE", "HIGH")
    always = {r["column"]: r["treatment"] for r in rules.outlier_class(t, ["share", "share2"], always=True).collect()}
    assert always["share"] == "REMOVE" and always["ok"] == "RETAIN"


def test_profile_edges(spark):
    df = spark.createDataFrame([(5.0, None, 1.0), (5.0, None, float("nan")), (5.0, None, float("inf"))], "same double, none double, odd double")
    got = {r["column"]: r for r in profile.numeric_profile(df, ["same", "none", "odd"]).collect()}
    assert got["same"]["std"] == 0.0 and got["same"]["skewness"] is None and got["same"]["median"] == 5.0
    assert got["none"]["n"] == 0 and got["none"]["median"] is None and got["none"]["cv"] is None
    assert got["odd"]["n"] == 1 and got["odd"]["max"] == 1.0 and got["odd"]["std"] is None
    status = {r["column"]: r["status"] for r in profile.constant_columns(df).collect()}
    assert status["same"] == "constant" and status["none"] == "varied"


def test_columns_that_cannot_be_judged(spark):
    from tabloom.operators import outliers

    df = spark.createDataFrame([(i, None, 3.0) for i in range(9)], "id long, empty double, same double")
    assert outliers.iqr_outliers(df, ["empty"]).collect() == [] and outliers.outlier_rows(df, "id", ["empty"]).collect() == []
    assert outliers.mad_outliers(df, ["empty", "same"]).collect() == []


def test_document_keeps_all_rows_of_a_key(spark):
    import json

    from tabloom.sources.tables import result_document

    tests = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "column string, pair string, p double")
    doc = json.loads(result_document({"group_tests": tests}).first()[0])["group_tests"]
    assert [d["p"] for d in doc["a"]] == [1.0, 2.0] and doc["b"]["p"] == 3.0
