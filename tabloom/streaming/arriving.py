"""Cleaning and scaling of files as they arrive, with statistics fitted beforehand on a batch.

The cleaning steps are plain column expressions, so the batch code runs on a stream unchanged; no state is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabloom.operators.encode import Scaler
from tabloom.plans.preprocess import clean


def read_arriving_csv(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.option("header", True).schema(schema).csv(folder)


def clean_arriving(stream: DataFrame, numeric: Sequence[str], zero_token_columns: Sequence[str] = (), scaler: Scaler | None = None) -> DataFrame:
    cleaned = clean(stream, numeric, zero_token_columns)
    return cleaned if scaler is None else scaler.transform(cleaned)


def write_arriving(stream: DataFrame, folder: str, progress: str) -> StreamingQuery:
    """Append to Parquet; everything present is processed, then the query ends."""
    return (
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", progress)
        .outputMode("append").trigger(availableNow=True).start()
    )
