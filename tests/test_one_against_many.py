"""One label against many others: as a plain loop says, ties, empty buckets and rare labels included."""

import numpy as np
import pytest

from tabloom.operators import cdf


@pytest.mark.parametrize("rows_per_bucket,cells", [(40, 2_000_000), (40, 30), (100_000, 2_000_000)])
def test_one_against_many(spark, monkeypatch, rows_per_bucket, cells):
    monkeypatch.setattr(cdf, "TASK_CELLS", cells)
    rng = np.random.default_rng(6)
    g = rng.integers(0, 30, 900)
    rows = [(f"g{a:02d}", float(np.round(rng.normal(a / 10, 1), 1)), float(rng.normal()) if a % 7 else None) for a in g.tolist()] + [("alone", 99.0, -99.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    axis = cdf.build_axis(df, ["x", "y"], "g", rows_per_bucket=rows_per_bucket)
    for against, least in (("g03", 1), ("alone", 1), ("g03", 20)):
        got = {(r["column"], r["label_b"]): r for r in cdf.named_pairs(cdf.many_two_sample(axis, against, least), axis).collect()}
        for i, c in enumerate(("x", "y"), 1):
            held = {n: np.sort([r[i] for r in rows if r[0] == n and r[i] is not None]) for n in axis.labels}
            a = held[against]
            others = [n for n in axis.labels if n != against and len(held[n]) >= least and len(a) >= least]
            assert {n for col, n in got if col == c} == set(others)
            for n in others:
                b = held[n]
                at = np.unique(np.concatenate((a, b)))
                gap = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b))
                r = got[c, n]
                assert (r["n_a"], r["n_b"]) == (len(a), len(b))
                assert r["ks"] == pytest.approx(gap.max(), abs=1e-12) and r["wasserstein"] == pytest.approx((gap[:-1] * np.diff(at)).sum(), rel=1e-9)
