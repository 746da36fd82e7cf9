"""Shapiro-Wilk test by Royston's approximation (1995), for columns with 3 to 4,999 values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.functions.cells import finite
from tabloom.functions.names import col, strings
from tabloom.functions.normal import cdf_sql, number, polynomial, with_ppf

# Royston's polynomials, from the constant term up, and the sample sizes the test covers.
OUTER = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)
SMALLEST, LARGEST = 3, 4_999


def with_statistic(sums: DataFrame) -> DataFrame:
    """Add ``w`` from the sums of a column, one small step per projection."""
    steps = [
        {"u": "1e0 / sqrt(size)", "spread": "sqrt(squares)"},
        {"a1": f"{polynomial('u', OUTER)} - m1 / spread", "a2": f"{polynomial('u', SECOND)} - m2 / spread"},
        {"inner1": "sqrt(abs((squares - 2e0 * m1 * m1) / (1e0 - 2e0 * a1 * a1)))",
         "inner2": "sqrt(abs((squares - 2e0 * m1 * m1 - 2e0 * m2 * m2) / (1e0 - 2e0 * a1 * a1 - 2e0 * a2 * a2)))"},
        {"weighted": f"CASE WHEN size <= 3e0 THEN {number(math.sqrt(0.5))} * ends "
                     "WHEN size <= 5e0 THEN (cross_sum + m1 * ends) / inner1 + a1 * ends "
                     "ELSE (cross_sum + m1 * ends + m2 * next_ends) / inner2 + a1 * ends + a2 * next_ends END"},
        {"w": "weighted * weighted / ss"},
    ]
    for step in steps:
        sums = sums.selectExpr("*", *[f"{e} AS {n}" for n, e in step.items()])
    return sums


def with_p_value(tests: DataFrame) -> DataFrame:
    """Add ``p_value`` of ``w``: exact for 3 values, log-normal forms below and from 12 on."""
    exact = (f"CASE WHEN w <= 7.5e-1 THEN 0e0 ELSE {number(6 / math.pi)} * (asin(sqrt(w)) - {number(math.asin(math.sqrt(0.75)))}) END")
    steps = [
        {"gap": "ln(CASE WHEN w >= 1e0 THEN 1e-300 ELSE 1e0 - w END)", "ln_n": "ln(size)", "limit": polynomial("size", SMALL_GAMMA)},
        {"z": f"CASE WHEN size <= 3e0 THEN 0e0 "
              f"WHEN size <= 1.1e1 THEN CASE WHEN gap >= limit THEN 4e1 "
              f"ELSE (-ln(limit - gap) - {polynomial('size', SMALL_MEAN)}) / exp({polynomial('size', SMALL_LOG_SD)}) END "
              f"ELSE (gap - {polynomial('ln_n', LARGE_MEAN)}) / exp({polynomial('ln_n', LARGE_LOG_SD)}) END"},
        {"lower": "-z"},
        {"p_value": f"CASE WHEN size <= 3e0 THEN {exact} ELSE {cdf_sql('lower')} END"},
    ]
    for step in steps:
        tests = tests.selectExpr("*", *[f"{e} AS {n}" for n, e in step.items()])
    return tests


def shapiro(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, w, p_value) of every column whose number of values the test covers."""
    columns = list(columns)
    data = df.select(*[finite(col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    counts = data.agg(*[F.count(f"c{i}") for i in range(len(columns))]).first()
    covered = [i for i in range(len(columns)) if SMALLEST <= counts[i] <= LARGEST]
    if not covered:
        return df.sparkSession.createDataFrame([], "column string, n bigint, w double, p_value double")
    cells = [p for i in covered for p in (F.lit(i), F.col(f"c{i}"))]
    long = data.select(F.stack(F.lit(len(covered)), *cells).alias("ci", "x")).where("x IS NOT NULL")
    # At most LARGEST rows per column reach the window.
    ordered = W.partitionBy("ci").orderBy("x")
    ranked = long.select("ci", "x", F.row_number().over(ordered).alias("r"),
                         F.count("*").over(W.partitionBy("ci")).alias("n"))
    scored = with_ppf(ranked.withColumn("p", F.expr("(r - 3.75e-1) / (n + 2.5e-1)")), {"m": "p"})

    def at(value: str, rank: str):
        return F.max(F.when(F.expr(f"r = {rank}"), F.col(value)))

    sums = scored.groupBy("ci").agg(
        F.max("n").alias("n"), F.max("n").cast("double").alias("size"), F.sum(F.col("m") * F.col("x")).alias("cross_sum"),
        (F.var_pop("x") * F.count("*")).alias("ss"), F.sum(F.col("m") * F.col("m")).alias("squares"),
        at("m", "1").alias("m1"), at("m", "2").alias("m2"), (at("x", "n") - at("x", "1")).alias("ends"),
        (at("x", "n - 1") - at("x", "2")).alias("next_ends"))
    return with_p_value(with_statistic(sums.where("ss > 0"))).select(
        F.element_at(strings(columns), F.col("ci") + 1).alias("column"), "n", "w", "p_value")
