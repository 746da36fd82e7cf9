"""The analysis job: structure, groups, distributions, missing data, outliers, and their facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.names import col
from tabloom.functions.pvalues import with_p_value
from tabloom.operators import outliers as out
from tabloom.operators import profile as prof
from tabloom.operators import rules
from tabloom.operators.cdf import build_axis, two_sample
from tabloom.operators.cleaning import mark_missing, to_numeric
from tabloom.operators.duplicates import duplicate_count
from tabloom.operators.normality import shapiro
from tabloom.operators.schema import classify, drop_blank_columns, numeric_columns, parse_counts
from tabloom.sources.tables import facts_of

MIN_GROUP = 3


@dataclass
class Analysis:
    """Lazy section tables."""

    structure: DataFrame
    columns: DataFrame
    constants: DataFrame
    group_tests: DataFrame | None
    pooling: DataFrame | None
    distributions: DataFrame
    scale: DataFrame
    missing: DataFrame
    strategy: DataFrame
    outliers: DataFrame

    def sections(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self.__dict__.items() if v is not None}

    def facts(self) -> DataFrame:
        """(section, subject, fact, value): what a written report would state."""
        keys = ("column", "label_a", "label_b")
        parts = [facts_of(name, table, keys) for name, table in self.sections().items()]
        parts.append(facts_of("summary", executive_facts(self)))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole


def group_tests(df: DataFrame, columns: Sequence[str], group: str, min_size: int = MIN_GROUP, method: str = "auto", **options) -> DataFrame:
    """Two-sample tests between all groups of at least ``min_size`` values, with p-values."""
    return with_p_value(two_sample(build_axis(df, columns, group, **options), min_size=min_size), method)


def executive_facts(a: Analysis) -> DataFrame:
    """One row: how many columns raise concerns, hold severe outliers or miss values."""
    concerns = a.distributions.agg(F.count_if(~F.col("suitable")).alias("columns_with_concerns"))
    severe = a.outliers.agg(F.count_if(F.col("treatment") != "RETAIN").alias("columns_with_severe_outliers"))
    gaps = a.missing.agg(F.count_if(F.col("n_missing") > 0).alias("columns_with_missing"),
                         F.coalesce(F.sum("n_missing"), F.lit(0)).alias("missing_cells"))
    row = {**concerns.first().asDict(), **severe.first().asDict(), **gaps.first().asDict()}
    return a.distributions.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))


def analyze(df: DataFrame, ids: Sequence[str] = (), group: str | None = None, zero_token_columns: Sequence[str] = (),
            percent_columns: Sequence[str] = (), method: str = "auto") -> Analysis:
    """All sections of a raw (text) table; ``group`` defaults to the last column."""
    raw = drop_blank_columns(df)
    group = raw.columns[-1] if group is None else group
    marked = mark_missing(raw)
    numeric = [c for c in numeric_columns(marked, ids=ids, min_valid=0) if c != group and c not in ids]
    typed = to_numeric(marked, numeric)
    tests = verdict = None
    if typed.select(col(group)).where(col(group).isNotNull()).distinct().limit(2).count() == 2:
        tests = group_tests(typed, numeric, group, method=method)
        verdict = rules.pooling(tests)
    summary = prof.missing_summary(marked)
    profile = prof.numeric_profile(typed, numeric)
    return Analysis(
        structure=one_row(prof.shape(marked), duplicate_count(marked)),
        columns=classify(marked, ids=ids),
        constants=prof.constant_columns(marked),
        group_tests=tests,
        pooling=verdict,
        distributions=rules.distribution_flags(profile, shapiro(typed, numeric)),
        scale=rules.scale_compatibility(prof.scale_ratio(profile)),
        missing=summary,
        strategy=rules.missing_strategy(summary, zero_token_columns, parse_counts(marked)),
        outliers=rules.outlier_class(out.iqr_outliers(typed, numeric), percent_columns),
    )


def one_row(*tables: DataFrame) -> DataFrame:
    """Several one-row tables side by side."""
    row: dict = {}
    fields = []
    for t in tables:
        row |= t.first().asDict()
        fields += t.schema.fields
    spark = tables[0].sparkSession
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
