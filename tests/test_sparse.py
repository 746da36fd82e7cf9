"""One-hot codes as places: against a plain loop, hot and cold categories, unseen and missing labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import sparse


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"v{rng.integers(0, 4000)}", "ab"[i % 2]) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id bigint, `many %` string, few string").cache()


def plain(rows, seen=None):
    seen = rows if seen is None else seen
    start, places = 0, {}
    for j in (1, 2):
        known = sorted({r[j] for r in seen if r[j] is not None})
        places.update({(j, v): start + i for i, v in enumerate(known)})
        places[j] = start
        start += len(known)
    return {(r[0], ("many %", "few")[j - 1]): places.get((j, r[j]), places[j]) for r in rows for j in (1, 2)}, start


@pytest.mark.parametrize("share", [1_000_000, 1_000, 1])
def test_places_and_back(labelled, monkeypatch, share):
    """All categories broadcast, some, none but a column of one value: the places are the same."""
    monkeypatch.setattr(sparse, "HOT_SHARE", share)
    rows, df = labelled
    want, width = plain(rows)
    fitted = sparse.fit_sparse(df, ["many %", "few"])
    out = fitted.transform(df, "id").collect()
    assert fitted.width() == width and len(out) == 2 * len(rows)
    assert {(r["id"], r["column"]): r["place"] for r in out} == want
    back = {(r["id"], r["column"]): r["category"] for r in fitted.inverse(fitted.transform(df, "id"), "id").collect()}
    assert all(back[i, "few"] == few and (many is None or back[i, "many %"] == many) for i, many, few in rows)


def test_unseen_empty_and_absent(spark, labelled):
    rows, df = labelled
    fitted = sparse.fit_sparse(df.where("id < 50"), ["many %", "few"])
    want, _ = plain(rows, rows[:50])
    assert {(r["id"], r["column"]): r["place"] for r in fitted.transform(df, "id").collect()} == want
    none = sparse.fit_sparse(df.where("false"), ["few"])
    assert none.width() == 0 and none.transform(df, "id").count() == 0
    assert fitted.transform(df.where("false"), "id").count() == 0
    gap = sparse.fit_sparse(df.where("few = 'a'").withColumn("many %", F.lit(None).cast("string")), ["many %", "few"])
    assert gap.width() == 1 and {r["column"] for r in gap.transform(df, "id").collect()} == {"few"}
    renamed = df.selectExpr("id AS category", "few")
    coded = sparse.fit_sparse(renamed, ["few"]).transform(renamed, "category")
    assert coded.columns == ["category", "column", "place"] and coded.count() == len(rows)
    with pytest.raises(ValueError):
        sparse.fit_sparse(df, ["other"])


def test_indicator_correlation(labelled):
    rows, df = labelled
    encoded = sparse.fit_sparse(df, ["many %", "few"]).transform(df, "id")
    want, width = plain(rows)
    dense = np.zeros((len(rows), width))
    for (i, _), place in want.items():
        dense[i, place] = 1
    got = sparse.indicator_correlation(encoded, "id").collect()
    both = dense.T @ dense
    assert len(got) == (np.triu(both, 1) > 0).sum()
    for r in got[::25]:
        assert r["n_both"] == both[r["a"], r["b"]]
        assert r["corr"] == pytest.approx(np.corrcoef(dense[:, r["a"]], dense[:, r["b"]])[0, 1], abs=1e-9)
