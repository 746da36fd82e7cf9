"""Donor pool, audit, readers, writers, models, plans and the arriving-files path."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import audit, compare, donors
from tabloom.operators.cleaning import null_above, round_half_even, special_tokens
from tabloom.operators.duplicates import duplicate_count, duplicate_rows
from tabloom.operators.impute import median_impute
from tabloom.plans.analysis import analyze
from tabloom.plans.comparison import compare as run_comparison
from tabloom.plans.preprocess import preprocess
from tabloom.plans.synthesis import learn, pool_impute
from tabloom.sources.models import load_model, save_model
from tabloom.sources.tables import read_dirty_csv, result_document, with_row_id, write_csv


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        a = float(rng.normal(10, 2))
        rows.append((i, None if i % 5 == 0 else a, None if i % 7 == 0 else a * 2 + float(rng.normal()),
                     float(rng.normal()) if i % 35 else None, None if i % 11 == 0 else "xyz"[i % 3]))
    return spark.createDataFrame(rows, "id bigint, `a %` double, b double, c double, g string").cache()


def filled_cells_unique(before, after, columns):
    for c in columns:
        got = [r[0] for r in audit.imputed_cells(before, after, "id", [c]).select("value").collect()]
        assert None not in got and len(got) == len(set(got))


def test_donor_pool_never_reuses(spark, gappy):
    out = pool_impute(gappy, "id", ["a %", "b", "c"], ["g"], rows=600).cache()
    assert out.count() == 120
    filled_cells_unique(gappy, out, ["a %", "b", "c"])
    assert out.where("g is null").count() == 0
    joined = gappy.alias("x").join(out.alias("y"), "id")
    assert joined.where("x.`a %` is not null and x.`a %` <> y.`a %`").count() == 0
    again = pool_impute(gappy.repartition(3), "id", ["a %", "b", "c"], ["g"], rows=600)
    for x, y in zip(again.orderBy("id").collect(), out.orderBy("id").collect()):
        assert x["g"] == y["g"] and [x["a %"], x["b"], x["c"]] == pytest.approx([y["a %"], y["b"], y["c"]], rel=1e-6)


def test_donor_pool_runs_dry(spark):
    df = spark.createDataFrame([(i, 1.0, None) for i in range(40)] + [(100, None, None)], "id bigint, a double, b double")
    pool = spark.createDataFrame([(i, float(i), float(i % 10)) for i in range(20)], "pid bigint, a double, b double")
    out = donors.donor_impute(df, "id", ["a", "b"], pool, "pid", steps=(2, 4)).cache()
    filled_cells_unique(df, out, ["a", "b"])
    values = [r["b"] for r in out.collect()]
    assert sum(v == int(v) for v in values) == 10
    extra = spark.createDataFrame([(i, 0.0, 1000.0 + i) for i in range(60)], "pid bigint, a double, b double")
    more = donors.donor_impute(df, "id", ["a", "b"], pool, "pid", steps=(2,), resample=lambda _: extra)
    assert sum(v >= 1000 for v in [r["b"] for r in more.collect()]) == 31


def test_fallback_to_median(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id bigint, a double")
    assert pool_impute(df, "id", ["a"]).where("id = 2").first()["a"] == 2.0


def test_audit(spark, gappy):
    out = median_impute(gappy, ["a %", "b"])
    rows = {r["column"]: r for r in audit.uniqueness(gappy, {"median": out}, "id", ["a %", "b"]).collect()}
    assert rows["a %"]["n_imputed"] == 24 and rows["a %"]["n_unique"] == 1 and rows["a %"]["status"] == "1 repeated"
    repeated = audit.repeated_imputed(gappy, out, "id", ["a %"]).collect()
    assert sorted(r["id"] for r in repeated) == list(range(0, 120, 5)) and {r["n"] for r in repeated} == {24}
    assert audit.imputation_counts(gappy, out, ["b"]).first()["still_missing"] == 0


def test_csv_tokens(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,a %,b/c, d.e,,g\n1,_,NP,1.5,,x\n2, n/a,l,1d,,y\n3,7, 12 ,1e3,,NULL\n4,inf,2,abc,,"q,r"\n')
    df = read_dirty_csv(spark, str(path))
    assert df.columns == ["id", "a %", "b/c", "d.e", "g"]
    got = df.orderBy("id").collect()
    assert [r["a %"] for r in got] == [None, None, "7", "inf"]
    assert [r["g"] for r in got] == ["x", "y", None, "q,r"]
    assert {(r["column"], r["value"]) for r in special_tokens(df).collect()} == {("b/c", "NP"), ("b/c", "l")}
    out = preprocess(df, "id", ["a %", "b/c", "d.e"], "g", ["b/c"])
    assert [r["g Encoded"] for r in out.orderBy("id").collect()] == [2, 3, 0, 1]
    plain = read_dirty_csv(spark, str(path), tokens=())
    assert plain.where("`a %` = '_'").count() == 1
    write_csv(df, str(tmp_path / "out"))
    back = read_dirty_csv(spark, str(tmp_path / "out"))
    assert back.columns == df.columns and back.count() == 4
    ids = with_row_id(df)
    assert sorted(r["row_id"] for r in ids.collect()) == [0, 1, 2, 3]


def test_model_store(spark, gappy, tmp_path):
    from tabloom.operators.copula import fit_encoder, sample

    whole = gappy.na.drop()
    model = learn(whole, ["a %", "b"], ["g"])
    save_model(spark, model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert sample(spark, model, 50).collect() == sample(spark, again, 50).collect()
    with pytest.raises(ValueError):
        save_model(spark, fit_encoder(whole, ["b"]), str(tmp_path / "n"))


def test_analysis_and_document(spark, gappy, tmp_path):
    raw = gappy.select(F.col("id").cast("string"), F.when(F.col("a %").isNull(), "_").otherwise(F.col("a %").cast("string")).alias("a %"),
                       F.col("b").cast("string"), F.col("c").cast("string"), F.col("g"))
    a = analyze(raw, ids=["id"])
    missing = {r["column"]: r["n_missing"] for r in a.missing.collect()}
    assert missing["a %"] == 24 and missing["g"] == 11
    actions = {r["column"]: r["action"] for r in a.strategy.collect()}
    assert actions["a %"] == "IMPUTE_KNN" and actions["c"] == "IMPUTE_MEDIAN" and actions["g"] == "IMPUTE_MODE"
    assert a.group_tests.count() == 9 and a.pooling.count() == 1
    doc = json.loads(result_document({"missing": a.missing, "structure": a.structure}).first()[0])
    assert doc["missing"]["a %"]["n_missing"] == 24 and doc["structure"]["n_rows"] == 120
    facts = a.facts()
    assert facts.where("section = 'summary' and fact = 'columns_with_missing'").first()["value"] == "4"


def test_comparison(spark):
    base = spark.range(400).selectExpr("id", "cast(id as double) v", "cast(id % 7 as double) w", "1.0D as k")
    near = base.selectExpr("id", "v + 1 as v", "w", "k")
    far = base.selectExpr("id", "v * 3 as v", "w * 2 as w", "k")
    c = run_comparison(base, {"near": near, "far": far, "same": base}, ["v", "w", "k"])
    rows = {(r["column"], r["candidate"]): r for r in c.distances.collect()}
    assert rows[("v", "near")]["wasserstein"] == pytest.approx(1.0)
    same = rows[("v", "same")]
    assert same["ks"] == same["wasserstein"] == same["js"] == 0.0 and rows[("k", "far")]["js"] is None
    assert all(0 <= r["js"] <= 0.8326 for r in rows.values() if r["js"] is not None)
    assert {r["candidate"]: r["place"] for r in c.ranking().collect()} == {"same": 1, "near": 2, "far": 3}
    best = {(r["column"], r["metric"]): r["winner"] for r in c.winners().collect()}
    assert best[("v", "ks")] == "same" and best[("w", "ks")] == "near" and best[("k", "ks")] == "near"
    wins = {(r["metric"], r["candidate"]): r["wins"] for r in c.wins().collect()}
    assert wins[("ks", "same")] == 3 and wins[("ks", "near")] == 2 and wins[("js", "far")] == 0
    boxes = {(r["column"], r["label"]): r for r in c.boxes().collect()}
    assert boxes[("v", "original")]["q1"] == 99.75 and boxes[("v", "original")]["fliers"] == 0
    assert c.quantiles().count() == 3 * 4 * 100
    density = c.densities().where("column = 'v' and label = 'near'").collect()
    assert sum(r["density"] * (r["hi"] - r["lo"]) for r in density) == pytest.approx(1.0)


def test_published_wins(spark):
    """The published distances recount to 1 / 3 / 26 wins."""
    w = [(1.302, 2.111, 1.387), (5.525, 4.969, 2.449), (7.698, 7.074, 2.206), (5.199, 9.078, .623), (.066, .414, .019),
         (1.519, 4.950, .469), (4.263, 6.635, .401), (3.474, 4.991, 0.), (.130, .047, .013), (2.774, .749, 1.148)]
    k = [(.301, .312, .218), (.239, .263, .019), (.452, .639, .130), (.266, .496, .051), (.206, .625, .070),
         (.237, .588, .096), (.280, .438, .031), (.155, .243, 0.), (.411, .190, .050), (.590, .144, .349)]
    j = [(.574, .557, .369), (.237, .334, .082), (.542, .576, .267), (.411, .511, .067), (.299, .560, .117),
         (.342, .538, .165), (.460, .497, .122), (.439, .451, 0.), (.492, .464, .158), (.706, .543, .562)]
    names = ["copula", "gan", "imputed"]
    rows = [(f"c{i}", names[m], w[i][m], k[i][m], j[i][m]) for i in range(10) for m in range(3)]
    table = spark.createDataFrame(rows, "column string, candidate string, wasserstein double, ks double, js double")
    total = {r["candidate"]: r["n"] for r in compare.wins(table).groupBy("candidate").agg(F.sum("wins").alias("n")).collect()}
    assert total == {"copula": 1, "gan": 3, "imputed": 26}
    assert compare.ranking(table).orderBy("place").first()["candidate"] == "imputed"


def test_duplicates_and_rounding(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", None), (4, "b", 2.5)], "id int, s string, v double")
    assert duplicate_count(df.drop("id")).first()[0] == 2
    assert sorted(r["id"] for r in duplicate_rows(df, "id").collect()) == [2, 3]
    assert round_half_even(df, ["v"], 0).where("id = 4").first()["v"] == 2.0
    top = spark.range(101).selectExpr("id", "cast(id as double) v")
    assert null_above(top, ["v"]).where("v is null").count() == 1


def test_arriving_files(spark, tmp_path):
    from tabloom.operators.encode import Scaler
    from tabloom.streaming.arriving import clean_arriving, read_arriving_csv, write_arriving

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "one.csv").write_text("id,v,z\n1,_,NP\n2,4,l\n")
    schema = spark.createDataFrame([], "id string, v string, z string").schema
    stream = clean_arriving(read_arriving_csv(spark, str(inbox), schema), ["v", "z"], ["z"], Scaler({"v": (2.0, 2.0)}))
    query = write_arriving(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination(120)
    got = {r["id"]: (r["v"], r["z"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": (-1.0, 0.0), "2": (1.0, None)}
