"""Two-sided p-values of the two-sample Kolmogorov-Smirnov test, for the small table of test results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed value: largest sample for which the exact count is used.
EXACT_LIMIT = 10_000
TERMS = 6


def limit_sql(d: str, n_a: str, n_b: str) -> str:
    """Kolmogorov's limit with Stephens' correction as SQL text; two series, each used where it converges at once."""
    en = f"(CAST({n_a} AS DOUBLE) * CAST({n_b} AS DOUBLE) / (CAST({n_a} AS DOUBLE) + CAST({n_b} AS DOUBLE)))"
    lam = f"((sqrt({en}) + 1.2e-1 + 1.1e-1 / sqrt({en})) * {d})"
    far = " + ".join(f"({(-1.0) ** (k - 1):.1e} * exp({-2.0 * k * k:.17e} * {lam} * {lam}))" for k in range(1, TERMS + 1))
    near = " + ".join(
        f"exp({-((2 * k - 1) * math.pi) ** 2 / 8.0:.17e} / ({lam} * {lam}))" for k in range(1, TERMS + 1))
    return (f"(CASE WHEN {lam} < 5e-2 THEN 1e0 WHEN {lam} < 1e0 THEN 1e0 - {math.sqrt(2 * math.pi):.17e} / {lam} * ({near}) "
            f"ELSE 2e0 * ({far}) END)")


def limit_p(d: str, n_a: str, n_b: str) -> Column:
    return F.expr(limit_sql(d, n_a, n_b))


def exact_ks(m: int, n: int, gap: int) -> float:
    """P(max |i*n - j*m| >= gap) over all orderings of m and n values.

    A random ordering is a walk from (0, 0) to (m, n). The probability of every state still inside the band is carried
    step by step; what leaves the band is added up, so small p-values keep their precision.
    """
    if gap <= 0:
        return 1.0
    total, left, state = m + n, 0.0, np.ones(1)
    lo = 0
    for t in range(total):
        i = np.arange(lo, lo + len(state))
        ahead = np.zeros(len(state) + 1)
        ahead[:-1] = state * (n - (t - i)) / (total - t)
        ahead[1:] += state * (m - i) / (total - t)
        first = max(lo, ((t + 1) * m - gap) // total + 1)
        last = min(lo + len(state), -((-(t + 1) * m - gap) // total) - 1)
        if first > last:
            return min(1.0, left + float(ahead.sum()))
        left += float(ahead[:first - lo].sum() + ahead[last - lo + 1:].sum())
        state, lo = ahead[first - lo:last - lo + 1], first
    return min(1.0, left)


@F.pandas_udf(DoubleType())
def exact_p(d: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    return pd.Series([exact_ks(int(a), int(b), round(x * int(a) * int(b))) for x, a, b in zip(d, n_a, n_b)])


def with_p_value(tests: DataFrame, method: str = "auto") -> DataFrame:
    """Add ``p_value`` to (ks, n_a, n_b): exact up to ``EXACT_LIMIT`` values per sample, else the limit."""
    limit = limit_p("ks", "n_a", "n_b")
    if method == "limit":
        return tests.withColumn("p_value", limit)
    small = F.greatest("n_a", "n_b") <= EXACT_LIMIT
    # One row per test: spread them, as each exact count is a task's worth of work.
    spread = tests.where(small).repartition(tests.sparkSession.sparkContext.defaultParallelism, "column", "label_a", "label_b")
    exact = spread.withColumn("p_value", exact_p("ks", "n_a", "n_b"))
    return exact.unionByName(tests.where(~small).withColumn("p_value", limit))
