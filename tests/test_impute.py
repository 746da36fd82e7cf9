"""Imputers against small brute-force versions, with invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import chained, impute
from tabloom.operators.neighbors import nearest


def table(n=400, seed=2, gaps=(0.3, 0.15, 0.05, 0.0), hot=False):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    x = np.column_stack([base * 3 + rng.normal(size=n), base * -2 + rng.normal(size=n) + 5, rng.normal(size=n) * 10,
                         base + rng.normal(size=n) * 0.1])
    if hot:
        x[: n // 3] = x[0]
    for j, g in enumerate(gaps):
        x[rng.random(n) < g, j] = np.nan
    return x


def frame(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, `a %` double, `b.c` double, c double, d double").repartition(4)


COLUMNS = ["a %", "b.c", "c", "d"]


def brute_knn(x, k):
    n, d = x.shape
    out = x.copy()
    gap = x[:, None, :] - x[None, :, :]
    seen = ~np.isnan(gap)
    shared = seen.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.where(shared > 0, np.where(seen, gap**2, 0).sum(axis=2) * (d / shared), np.inf)
    for i, j in zip(*np.nonzero(np.isnan(x))):
        donors = [r for r in range(n) if not np.isnan(x[r, j]) and np.isfinite(dist[i, r])]
        donors.sort(key=lambda r: (dist[i, r], r))
        out[i, j] = x[donors[:k], j].mean() if donors else np.nanmean(x[:, j])
    return out


def collected(df):
    return np.array([[np.nan if v is None else v for v in r] for r in df.orderBy("id").select(*[f"`{c}`" for c in COLUMNS]).collect()], dtype=float)


@pytest.mark.parametrize("gaps,hot,block", [
    ((0.3, 0.15, 0.05, 0.0), False, 4096), ((0.3, 0.15, 0.05, 0.0), True, 40), ((0.3, 0.3, 0.3, 0.3), False, 40)])
def test_knn(spark, gaps, hot, block):
    x = table(gaps=gaps, hot=hot)
    got = collected(impute.knn_impute(frame(spark, x), "id", COLUMNS, 5, block_rows=block))
    assert np.allclose(got, brute_knn(x, 5), rtol=1e-12)


def test_nearest_needs_more_than_its_bucket(spark):
    rows = [(i, float(i % 50), float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    near = nearest(df.where("id < 100"), df, "id", "id", ["x"], 30, [F.lit(True)], [F.lit(True)], block_rows=20)
    got = {}
    for r in near.collect():
        got.setdefault(r["rid"], []).append((r["dist2"], r["did"]))
    for rid in (0, 17, 99):
        want = sorted((float((i % 50 - rid % 50) ** 2), i) for i in range(500))[:30]
        assert sorted(got[rid]) == want


def test_nearest_visits_few_pairs(spark):
    """The fullest column says nothing and the others come in clusters: the cells reached hold a small part of the pairs."""
    from tabloom.operators import neighbors

    rng = np.random.default_rng(4)
    n, centres = 1500, rng.normal(size=(30, 3)) * 100
    x = np.column_stack([np.ones(n), centres[rng.integers(0, 30, n)] + rng.normal(size=(n, 3))])
    x[rng.random(n) < 0.2, 1] = np.nan
    df = frame(spark, x)
    holes = int(np.isnan(x[:, 1]).sum())
    found, visits, donors = neighbors.search(df, df, "id", "id", COLUMNS, 5, [F.col("`b.c`").isNull()], [F.col("`b.c`").isNotNull()], block_rows=50)
    sizes = donors.groupBy("cell").count()
    assert 25 <= sizes.count() <= 30
    compared = sum(v.join(sizes, "cell").agg(F.sum("count")).first()[0] for v in visits)
    assert compared < 0.2 * holes * (n - holes)
    got = {}
    for r in found.collect():
        got.setdefault(r["rid"], []).append((r["dist2"], r["did"]))
    assert len(got) == holes
    gives = np.flatnonzero(~np.isnan(x[:, 1]))
    for rid, near in got.items():
        gap = (x[gives][:, [0, 2, 3]] - x[rid, [0, 2, 3]]) ** 2
        want = sorted(zip(gap.sum(axis=1) * 4 / 3, gives.tolist()))[:5]
        assert [d for _, d in sorted(near)] == [d for _, d in want]
        assert np.allclose([d for d, _ in sorted(near)], [d for d, _ in want])


def test_nearest_bounds_hold(spark):
    """No donor of a cell is closer than the cell's bound, whatever is missing on either side."""
    from tabloom.operators import neighbors

    x, y = table(n=300, gaps=(0.4, 0.3, 0.2, 0.1)), table(n=200, seed=5, gaps=(0.4, 0.3, 0.2, 0.5))
    tree = neighbors.grow(x[::3], 12)
    cell = tree.cells(x)
    names = np.unique(cell)
    with np.errstate(all="ignore"):
        low, high = (np.array([f(x[cell == c], axis=0, initial=v, where=~np.isnan(x[cell == c])) for c in names]) for f, v in ((np.min, np.inf), (np.max, -np.inf)))
    held = np.array([(~np.isnan(x[cell == c])).mean(axis=0) for c in names])
    cells = neighbors.Cells(names, low, high, held == 1, held > 0, np.ones((len(names), 1), np.int64))
    bound, real = cells.bounds(y), neighbors.block_distances(y, x)
    for at, c in enumerate(names):
        assert (bound[:, at] <= real[:, cell == c].min(axis=1) * (1 + 1e-12)).all()


def test_nearest_without_rows(spark):
    df = frame(spark, table(n=60))
    none = df.where("id < 0")
    for r, d in ((none, df), (df, none), (none, none)):
        assert nearest(r, d, "id", "id", COLUMNS, 3, [F.lit(True)], [F.lit(True)], block_rows=10).count() == 0
    odd = spark.createDataFrame([(1, float("nan"), 1.0), (2, float("inf"), 2.0), (3, None, None), (4, 5.0, 4.0)], "id bigint, x double, y double")
    got = nearest(odd, odd, "id", "id", ["x", "y"], 2, [F.lit(True)], [F.lit(True)]).collect()
    assert sorted({(r["rid"], r["did"], r["dist2"]) for r in got if r["rid"] in (1, 3)}) == [(1, 1, 0.0), (1, 2, 2.0)]


def test_many_targets_in_passes(spark, monkeypatch):
    from tabloom.operators import neighbors

    monkeypatch.setattr(neighbors, "TARGETS_PER_PASS", 3)
    x = table(n=120)
    assert np.allclose(collected(impute.knn_impute(frame(spark, x), "id", COLUMNS, 5)), brute_knn(x, 5), rtol=1e-12)


def brute_mice(x, rounds=10, tol=1e-3):
    missing = np.isnan(x)
    z = np.where(missing, np.nanmean(x, axis=0), x)
    order = sorted([j for j in range(x.shape[1]) if missing[:, j].any()], key=lambda j: (missing[:, j].mean(), j))
    for _ in range(rounds):
        old = z.copy()
        for j in order:
            others = [i for i in range(x.shape[1]) if i != j]
            seen = ~missing[:, j]
            a, y = z[seen][:, others], x[seen, j]
            ma, my = a.mean(axis=0), y.mean()
            coef, b = chained.bayesian_ridge(len(y), ma, my, (a - ma).T @ (a - ma), (a - ma).T @ (y - my), ((y - my) ** 2).sum())
            z[missing[:, j], j] = z[missing[:, j]][:, others] @ coef + b
        if np.abs(z - old).sum(axis=1).max() < tol * np.nanmax(np.abs(x)):
            break
    return z


def test_mice_by_patterns_and_by_rounds(spark):
    x = table()
    want = brute_mice(x)
    got = collected(chained.mice_impute(frame(spark, x), "id", COLUMNS))
    assert np.allclose(got, want, rtol=1e-6, atol=1e-7)
    slow = collected(chained.mice_impute(frame(spark, x), "id", COLUMNS, max_pattern_cells=20))
    assert np.allclose(slow, want, rtol=1e-6, atol=1e-7)


def test_forest(spark):
    x = table(n=200)
    got = collected(chained.forest_impute(frame(spark, x), "id", COLUMNS, trees=10, rounds=2, max_depth=6))
    seen = ~np.isnan(x)
    assert not np.isnan(got).any() and (got[seen] == x[seen]).all()
    for j in range(4):
        assert got[:, j].min() >= np.nanmin(x[:, j]) - 1e-9 and got[:, j].max() <= np.nanmax(x[:, j]) + 1e-9
    filled = np.isnan(x[:, 0])
    assert np.corrcoef(got[filled, 0], x[filled, 3])[0, 1] > 0.7


def test_forest_query_runs_the_defaults(monkeypatch):
    """The registered query asks for the operator's own trees, rounds and depth."""
    from unittest.mock import MagicMock

    from registry import QUERIES, imputing

    asked = MagicMock()
    monkeypatch.setattr(imputing, "gappy_part", MagicMock())
    monkeypatch.setattr(chained, "forest_impute", asked)
    QUERIES["forest_impute"](None, "")
    assert asked.call_args.kwargs == {} and len(asked.call_args.args) == 3


def test_simple_imputers(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, 2.0, "a"), (3, None, None), (4, 4.0, "a"), (5, 9.0, "b")], "id int, `v %` double, g string")
    assert impute.median_impute(df, ["v %"]).where("id = 3").first()["v %"] == 3.0
    assert impute.mode_impute(df, ["g"]).where("id = 3").first()["g"] == "a"
    marked = impute.missing_as_category(df, ["g", "v %"]).where("id = 3").first()
    assert marked["g"] == "Missing" and marked["g_missing"] == 1 and marked["v %"] is None and marked["v %_missing"] == 1
    assert not impute.enough_complete_rows(df) and impute.enough_complete_rows(df, least=4)
