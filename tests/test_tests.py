"""p-values against brute force and published values."""

from itertools import combinations

import numpy as np
import pytest

from tabloom.functions.pvalues import exact_ks, with_p_value
from tabloom.operators.normality import shapiro


def brute_p(m, n, gap):
    hits = total = 0
    for chosen in combinations(range(m + n), m):
        i = j = worst = 0
        for k in range(m + n):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            worst = max(worst, abs(i * n - j * m))
        total += 1
        hits += worst >= gap
    return hits / total


@pytest.mark.parametrize("m,n", [(3, 3), (3, 5), (4, 6), (5, 5)])
def test_exact_p(m, n):
    for gap in range(0, m * n + 1):
        assert exact_ks(m, n, gap) == pytest.approx(brute_p(m, n, gap), abs=1e-12)


def test_exact_meets_limit(spark):
    rows = [("c", "a", "b", n, n, d) for n in (500, 3000) for d in (0.02, 0.05, 0.08)]
    tests = spark.createDataFrame(rows, "column string, label_a string, label_b string, n_a bigint, n_b bigint, ks double")
    exact = {(r["n_a"], r["ks"]): r["p_value"] for r in with_p_value(tests).collect()}
    limit = {(r["n_a"], r["ks"]): r["p_value"] for r in with_p_value(tests, "limit").collect()}
    for k in exact:
        assert exact[k] == pytest.approx(limit[k], rel=0.1, abs=5e-3)
    assert exact_ks(10_000, 9_999, round(0.03 * 10_000 * 9_999)) < 1e-3


def test_shapiro_known_values(spark):
    # The weights of 11 men from the original paper: W = 0.79, p about 0.007; three values: closed form.
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = [(float(men[i]) if i < 11 else None, [1.0, 2.0, 4.0][i] if i < 3 else None, 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "men double, three double, constant double")
    got = {r["column"]: r for r in shapiro(df, ["men", "three", "constant"]).collect()}
    assert got["men"]["w"] == pytest.approx(0.79, abs=2e-3)
    assert got["men"]["p_value"] == pytest.approx(0.0067, abs=5e-4)
    assert got["three"]["w"] == pytest.approx(27 / 28, abs=1e-9)
    assert 0.6 < got["three"]["p_value"] < 0.65
    assert "constant" not in got


def test_shapiro_calibration(spark):
    rng = np.random.default_rng(3)
    cols = {f"n{i}": rng.normal(size=200) for i in range(20)} | {f"e{i}": rng.exponential(size=200) for i in range(5)}
    df = spark.createDataFrame([tuple(float(cols[c][k]) for c in cols) for k in range(200)], list(cols))
    p = {r["column"]: r["p_value"] for r in shapiro(df, list(cols)).collect()}
    assert sum(p[c] < 0.05 for c in p if c[0] == "n") <= 4
    assert all(p[c] < 1e-6 for c in p if c[0] == "e")
