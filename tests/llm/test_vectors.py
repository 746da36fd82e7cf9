"""Near vectors against all pairs, centroid clustering against plain integers, E8 decoding against its neighbours."""

import hashlib
import math

import numpy as np
import pytest

from tabloom.llm import lattice, pivots

SCHEMA = "vec_id bigint, embedding array<float>, label int, `h` string, id int, v array<int>, `a.b` int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, v, 1, "x", 2, [3], 4) for k, v in rows], schema).repartition(3)


def near_rows():
    """Clusters of near vectors at many distances, a hot group, copies, chains, and what cannot be compared."""
    rng = np.random.default_rng(4)
    rows = []

    def add(v):
        rows.append((len(rows), [float(np.float32(x)) for x in v]))

    base = rng.normal(size=(60, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    for b in base[:50]:
        add(b)
        for noise in rng.choice([0.0, 0.005, 0.02, 0.035, 0.04, 0.042, 0.05], 4):
            add((b + rng.normal(size=64) * noise) * rng.choice([1.0, 7.0, 1e-20]))
    for _ in range(400):
        add(base[50] + rng.normal(size=64) * 0.02)
    for _ in range(60):
        add(base[51])
    turn = base[52]
    for _ in range(12):
        add(turn)
        turn = turn + rng.normal(size=64) * 0.035
    ten = rng.normal(size=10)
    add(ten), add(ten * 2), add(ten + 0.01)
    for odd in (None, [], [0.0] * 64, [1.0] * 63 + [float("nan")], [float("inf")] + [1.0] * 63, [1.0] * 63 + [None]):
        rows.append((len(rows), odd))
    rows += [(None, rows[0][1]), (None, [1.0, -1.0]), (3, rows[3][1]), (3, [5.0, 5.0, 1.0])]
    return rows


def brute_near(rows, least=0.95):
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = []
    for ok, (_, v) in zip(fine, rows):
        u = np.array(v, float) / np.abs(v).max() if ok else None
        units.append(u / np.sqrt(u @ u) if ok else None)
    links = [[j for j in range(len(rows)) if j != i and fine[i] and fine[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        label[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return [(rows[i][0], len(links[i]), label[i], rows[i][0] == label[i]) for i in range(len(rows))], sum(map(len, links))


@pytest.mark.parametrize("block,bins", [(1024, 8192), (50, 300)])
def test_near_vectors(spark, monkeypatch, block, bins):
    monkeypatch.setattr(lattice, "BLOCK_ROWS", block)
    monkeypatch.setattr(lattice, "BIN_ROWS", bins)
    rows = near_rows()
    want, links = brute_near(rows)
    got = [tuple(r) for r in lattice.near_vectors(frame(spark, rows)).collect()]
    assert len(got) == len(want)
    assert sum(r[1] for r in got) >= 0.999 * links
    differ = set(map(repr, got)) ^ set(map(repr, want))
    assert len(differ) <= 0.01 * len(rows), sorted(differ)[:10]
    # none but true links are counted
    high = {}
    for k, n, *_ in want:
        high[k] = max(high.get(k, 0), n)
    assert all(n <= high[k] for k, n, *_ in got)


def test_recall_at_the_threshold(spark):
    """Pairs of cosine just above the similarity: the probability of losing one is below 0.001."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        u, w = rng.normal(size=(2, 64))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        rows += [(2 * i, u.tolist()), (2 * i + 1, (0.95001 * u + np.sqrt(1 - 0.95001 ** 2) * w).tolist())]
    out = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.where("n_links > 0").count() >= 2 * 3000 * 0.997


def test_decoding_and_probing():
    rng = np.random.default_rng(2)
    around = lattice.roots()
    assert len({tuple(r) for r in around}) == 240 and np.allclose((around ** 2).sum(axis=1), 2)
    y = rng.normal(size=(500, 8)) * 3
    got = lattice.decode(y)
    twice = np.rint(got * 2).astype(int)
    assert np.array_equal(twice, got * 2) and all(len(set(r % 2)) == 1 for r in twice) and np.all(got.sum(axis=1) % 2 == 0)
    best = ((y - got) ** 2).sum(axis=1)
    assert np.all(best[:, None] <= (((y[:, None] - got[:, None] - around) ** 2).sum(axis=2)) + 1e-12)
    v = rng.normal(size=(40, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    keys = lattice.cell_keys(v)
    assert keys.shape == (40, lattice.TABLES, lattice.VISITS) and all(len(set(k)) == lattice.VISITS for r in keys for k in r)
    assert np.array_equal(keys[7:8], lattice.cell_keys(v[7:8]))


def test_empty_tables(spark):
    assert lattice.near_vectors(frame(spark, [])).count() == 0
    assert pivots.cluster(frame(spark, [])).count() == 0
    assert pivots.cluster(frame(spark, [(1, [1.0]), (2, None)])).count() == 0


def brute_clusters(rows, size=64, seeds=8, rounds=10):
    kept = [(k, [math.floor(1024 * x) for x in v]) for k, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(1024 * x) < 2 ** 62 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:seeds]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        centres = [[sum(x) // len(x) for x in zip(*[v for (_, v), (_, j) in zip(kept, of) if j == i])] or c for i, c in enumerate(centres)]
    of = assign()
    inertia = [sum(d for d, j in of if j == i) for i in range(len(centres))]

    def fit(x):
        return x if x < 2 ** 63 else None

    big = {i for d, i in of if d >= 2 ** 63}
    return [(k, i, fit(d), None if i in big else fit(inertia[i]), None if big else fit(sum(inertia)), hashlib.sha256(",".join(map(str, centres[i])).encode()).hexdigest())
            for (k, _), (d, i) in zip(kept, of)]


def cluster_rows(seed, n=300):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 64))
    rows = [(i, (middle[rng.integers(12)] + rng.normal(size=64) * 0.2).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.5] * 64) for i in range(30)] + [(5, rows[5][1]), (None, rows[9][1]), (77, None), (78, []), (79, [1.0] * 63), (80, [float("nan")] * 64),
             (81, [None] + [1.0] * 63), (82, [-float("inf")] * 64), (83, [-0.0] * 64)]
    return rows


@pytest.mark.parametrize("extra", [[], [(90, [1e5] * 64), (91, [-1e6] + [0.0] * 63)], [(90, [1e15] * 64), (91, [4e15] * 64), (92, [1e30] * 64)]])
def test_clusters(spark, extra):
    rows = cluster_rows(3) + extra
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id bigint, embedding array<double>, cluster int").repartition(4)
    got = sorted(map(tuple, pivots.cluster(df).collect()), key=repr)
    assert got == sorted(brute_clusters(rows), key=repr)


def test_ties_and_few_rows(spark):
    same = [(i, [float(i % 2)] * 64) for i in range(40)]
    assert sorted(map(tuple, pivots.cluster(frame(spark, same)).collect()), key=repr) == sorted(brute_clusters(same), key=repr)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(tuple, pivots.cluster(frame(spark, few)).collect()), key=repr) == sorted(brute_clusters(few), key=repr)


def test_bounds_spare_distances():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(8, 64))[rng.integers(8, size=4000)] * 1024 + rng.normal(size=(4000, 64)) * 60).astype(np.int64)
    p = x[:8].copy()
    of, d, done = pivots.nearest(x, pivots.pivot_distances(x, p), p, p)
    full = ((x[:, None] - p[None]) ** 2).sum(axis=2)
    assert np.array_equal(of, full.argmin(axis=1)) and np.array_equal(d, full.min(axis=1))
    assert done < 0.5 * full.size
