"""Decisions as CASE logic over the small statistics tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Action names, labels and thresholds of the rules below.
DO_NOT_POOL, POOL_WITH_CAUTION, POOL = "DO_NOT_POOL", "CAUTION", "POOLING_ACCEPTABLE"
SIGNIFICANT_HIGH, SIGNIFICANT_SOME, ALPHA = 30.0, 15.0, 0.05
SKEW_LIMIT, KURTOSIS_LIMIT, ZERO_LIMIT, CV_LIMIT = 1.0, 3.0, 0.1, 2.0
DROP_ABOVE, CATEGORY_ABOVE, MEDIAN_BELOW = 50.0, 30.0, 10.0
SCALE_SEVERE, SCALE_MODERATE = 100.0, 10.0


def pooling(tests: DataFrame) -> DataFrame:
    """One row from (p_value) tests: percent significant, pooling verdict and generation approach; none without tests."""
    pct = F.col("pct_significant")
    return (
        tests.agg(F.count("p_value").alias("n_tests"),
                  (F.avg((F.col("p_value") < ALPHA).cast("double")) * 100.0).alias("pct_significant"))
        .where("n_tests > 0")
        .select("n_tests", "pct_significant",
                F.when(pct > SIGNIFICANT_HIGH, DO_NOT_POOL).when(pct > SIGNIFICANT_SOME, POOL_WITH_CAUTION)
                .otherwise(POOL).alias("pooling"),
                F.when(pct > SIGNIFICANT_HIGH, "per_group").otherwise("pooled").alias("approach"))
    )


def flags(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda v: v.isNotNull())


def distribution_flags(profile: DataFrame, shapiro: DataFrame | None = None, basic: bool = False,
                       percent_marker: str = "%") -> DataFrame:
    """Add ``characteristics``, ``suitable`` and ``concerns``; ``basic`` keeps the first three flags only."""
    table = profile
    if shapiro is not None:
        table = table.join(F.broadcast(shapiro.select("column", "p_value")), "column", "left")
    skewed, heavy = F.abs(F.col("skewness")) > SKEW_LIMIT, F.col("kurtosis") > KURTOSIS_LIMIT
    pairs = [(skewed, "highly_skewed"), (heavy, "heavy_tailed"), (F.col("zero_share") > ZERO_LIMIT, "zero_inflated")]
    if not basic:
        bounded = (F.col("min") >= 0) & (F.col("max") <= 100) & F.contains(F.col("column"), F.lit(percent_marker))
        pairs.append((bounded, "bounded_percentage"))
        if shapiro is not None:
            pairs.append((F.col("p_value") < ALPHA, "non_normal"))
    concerns = flags((skewed, "extreme_skewness"), (heavy, "heavy_tails"), (F.col("cv") > CV_LIMIT, "high_relative_variance"))
    return table.select("*", flags(*pairs).alias("characteristics"), concerns.alias("concerns")).withColumn(
        "suitable", F.size("concerns") == 0)


def missing_strategy(summary: DataFrame, zero_token_columns: Sequence[str] = (), parse_counts: DataFrame | None = None,
                     by_name_only: bool = False) -> DataFrame:
    """(column, n_missing, pct_missing, action), the first matching rule wins.

    ``parse_counts`` (column, parsable) separates median from mode imputation; without it every low-missing column takes
    the median. A named column with special tokens but without the zero token gets no action; ``by_name_only`` zero-fills
    the named columns whatever they hold.
    """
    pct, zero_token = F.col("pct_missing"), F.col("has_zero_token")
    listed = summary.where((F.col("n_missing") > 0) | (zero_token if by_name_only else F.col("has_special")))
    if parse_counts is not None:
        listed = listed.join(F.broadcast(parse_counts.select("column", "parsable")), "column", "left")
        low = F.when(F.col("parsable") > F.col("n_rows") * 0.5, "IMPUTE_MEDIAN").otherwise("IMPUTE_MODE")
    else:
        low = F.lit("IMPUTE_MEDIAN")
    named = F.col("column").isin(*zero_token_columns) if zero_token_columns else F.lit(False)
    if not by_name_only:
        named = named & F.col("has_special")
    zero = F.lit("REPLACE_WITH_ZERO") if by_name_only else F.when(zero_token, "REPLACE_WITH_ZERO")
    action = (
        F.when(pct > DROP_ABOVE, "DROP_COLUMN").when(pct > CATEGORY_ABOVE, "RETAIN_AS_CATEGORY")
        .when(named, zero).when(pct < MEDIAN_BELOW, low).otherwise("IMPUTE_KNN")
    )
    return listed.select("column", "n_missing", "pct_missing", action.alias("action"))


def summary_with_strategy(summary: DataFrame, strategy: DataFrame) -> DataFrame:
    """Every column of the summary with its action, `N/A` where there is none."""
    return summary.join(F.broadcast(strategy.select("column", "action")), "column", "left").withColumn(
        "action", F.coalesce("action", F.lit("N/A")))


def columns_to_drop(strategy: DataFrame) -> list[str]:
    return [r["column"] for r in strategy.where(F.col("action") == "DROP_COLUMN").collect()]


def outlier_class(outliers: DataFrame, percent_columns: Sequence[str] = (), always: bool = False) -> DataFrame:
    """Add ``classification`` and ``treatment``.

    By default only columns with outliers are classified; with ``always`` every column gets a label and the percentage
    rule needs no outlier.
    """
    some = F.col("n_outliers") > 0
    usual_top = F.col("q3") + (F.col("q3") - F.col("q1")) * 3
    error = some & (F.col("max") > usual_top * 10)
    impossible = F.col("column").isin(*percent_columns) if percent_columns else F.lit(False)
    impossible = impossible & (F.col("max") > 100)
    if not always:
        impossible = impossible & some
    natural = F.lit(True) if always else some
    return outliers.select(
        "*",
        F.when(error, "MEASUREMENT_ERROR").when(impossible, "IMPOSSIBLE_VALUE").when(natural, "NATURAL_VARIATION")
        .alias("classification"),
        F.when(error, "INVESTIGATE").when(impossible, "REMOVE").otherwise("RETAIN").alias("treatment"),
        F.when(F.col("pct_outliers") > 10, "HIGH").when(some, "MODERATE").otherwise("LOW").alias("synthetic_impact"))


def scale_compatibility(ratio: DataFrame) -> DataFrame:
    r = F.col("scale_ratio")
    return ratio.withColumn("scale_compatibility", F.when(r > SCALE_SEVERE, "incompatible").when(
        r > SCALE_MODERATE, "moderate").otherwise("compatible"))


def validity(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, n_checked, n_broken) of named predicates; rows where a predicate is undefined are not checked."""
    wide = df.agg(*[e.alias(f"{t}{i}") for i, c in enumerate(checks.values()) for t, e in (
        ("n", F.count(c)), ("b", F.count_if(~c)))])
    cells = [p for i, name in enumerate(checks) for p in (F.lit(name), F.col(f"n{i}"), F.col(f"b{i}"))]
    return wide.select(F.stack(F.lit(len(checks)), *cells).alias("rule", "n_checked", "n_broken"))
