"""The preprocessing job: tokens, coercion, extremes, median, scaling, label code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tabloom.operators.cleaning import ZERO_TOKEN_MEANING, apply_tokens, mark_missing, null_above, null_outside, to_numeric
from tabloom.operators.encode import fit_scaler, label_encode
from tabloom.operators.impute import fill as fill_values
from tabloom.operators.impute import median_impute, mode_impute
from tabloom.operators.profile import columns_with_missing, missing_summary
from tabloom.operators.schema import drop_blank_columns, drop_ids


def clean(df: DataFrame, numeric: Sequence[str], zero_token_columns: Sequence[str] = (),
          meaning: Mapping[str, str | None] = ZERO_TOKEN_MEANING, trim: bool = True) -> DataFrame:
    """Blank headers dropped, tokens resolved, numeric columns as doubles; one lazy projection."""
    df = mark_missing(drop_blank_columns(df), trim=trim)
    return to_numeric(apply_tokens(df, zero_token_columns, meaning), numeric)


def preprocess(df: DataFrame, key: str, numeric: Sequence[str], label: str | None = None, zero_token_columns: Sequence[str] = (),
               extreme_columns: Sequence[str] = (), extreme_p: float = 0.99, impute_below: float = 10.0, trim: bool = True) -> DataFrame:
    """Clean, null the extremes, fill lightly missing columns by their median, scale, and encode the label."""
    df = clean(df, numeric, zero_token_columns, trim=trim)
    df = null_above(df, [c for c in extreme_columns if c in df.columns], extreme_p)
    light = [r["column"] for r in columns_with_missing(missing_summary(df, numeric), 0.0, impute_below).collect()]
    if light:
        df = median_impute(df, [c for c in numeric if c in light])
    df = fit_scaler(df, numeric).transform(df)
    return df if label is None else label_encode(df, label, key, f"{label} Encoded")


def apply_decisions(df: DataFrame, strategy: DataFrame, outliers: DataFrame | None = None, key: str | None = None,
                    knn=None) -> DataFrame:
    """Carry out the rule tables: columns dropped, extremes nulled, zeros, medians, modes; ``knn`` fills what is left to it."""
    actions = {r["column"]: r["action"] for r in strategy.collect()}

    def chosen(action: str) -> list[str]:
        return [c for c in df.columns if actions.get(c) == action]

    if outliers is not None:
        bad = outliers.where("treatment IN ('INVESTIGATE', 'REMOVE')").collect()
        df = null_outside(df, {r["column"]: (r["lower"], r["upper"]) for r in bad if r["column"] in df.columns})
    df = drop_ids(df, chosen("DROP_COLUMN"))
    kinds = dict(df.dtypes)
    df = fill_values(df, {c: "0" if kinds[c] == "string" else 0.0 for c in chosen("REPLACE_WITH_ZERO")})
    medians = [c for c in chosen("IMPUTE_MEDIAN") if kinds[c] != "string"]
    df = median_impute(df, medians) if medians else df
    modes = chosen("IMPUTE_MODE")
    df = mode_impute(df, modes) if modes else df
    left = [c for c in chosen("IMPUTE_KNN") if kinds[c] != "string"]
    return knn(df, key, left) if knn is not None and left else df
