"""Fitted models as Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import SparkSession

from tabloom.operators.copula import MixedModel
from tabloom.operators.encode import OneHot
from tabloom.operators.marginal import marginal_table, marginals_from


def save_model(spark: SparkSession, model: MixedModel, path: str) -> None:
    """Marginals, categories, correlation and column roles; an unfitted model is refused."""
    if not model.marginals or model.matrix is None:
        raise ValueError("fit the model before saving it")
    marginal_table(spark, model.marginals).write.mode("overwrite").parquet(f"{path}/marginals")
    if model.categorical:
        model.onehot.to_table(spark).write.mode("overwrite").parquet(f"{path}/categories")
    d = len(model.matrix)
    entries = [(i, j, float(model.matrix[i, j])) for i in range(d) for j in range(d)]
    spark.createDataFrame(entries, "i int, j int, corr double").write.mode("overwrite").parquet(f"{path}/correlation")
    roles = [(k, i, c) for k, names in (("numeric", model.numeric), ("categorical", model.categorical)) for i, c in enumerate(names)]
    roles.append(("tail", 0, repr(model.tail)))
    spark.createDataFrame(roles, "role string, position int, name string").write.mode("overwrite").parquet(f"{path}/roles")


def load_model(spark: SparkSession, path: str) -> MixedModel:
    roles = spark.read.parquet(f"{path}/roles").orderBy("role", "position").collect()

    def named(role: str) -> Sequence[str]:
        return [r["name"] for r in roles if r["role"] == role]

    entries = spark.read.parquet(f"{path}/correlation").collect()
    d = max(r["i"] for r in entries) + 1
    matrix = np.zeros((d, d))
    for r in entries:
        matrix[r["i"], r["j"]] = r["corr"]
    categorical = list(named("categorical"))
    onehot = OneHot.from_table(spark.read.parquet(f"{path}/categories"), categorical) if categorical else OneHot()
    return MixedModel(list(named("numeric")), categorical, marginals_from(spark.read.parquet(f"{path}/marginals")), onehot,
                      matrix, float(named("tail")[0]))
