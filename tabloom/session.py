"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tabloom") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one is made in local mode only."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tabloom-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    It survives the loss of executors, and unlike a checkpointed RDD it has a known size, so that joins with what has
    become small are planned as such.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tabloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def consecutive(df: DataFrame, name: str) -> DataFrame:
    """Add 0, 1, 2, ... in the order of the rows, fixed by writing the table out; only partition sizes come to the driver."""
    rows_at = 33  # Spark's growing ids hold the partition above 33 bits of row numbers
    marked = cut_lineage(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", rows_at)
    sizes = sorted(tuple(r) for r in marked.groupBy(part.alias("part")).count().collect())
    starts = [(p, end - n) for (p, n), end in zip(sizes, accumulate(n for _, n in sizes))]
    table = df.sparkSession.createDataFrame(starts, "__part bigint, __start bigint")
    row = F.col("__at").bitwiseAND(F.lit((1 << rows_at) - 1))
    return marked.join(F.broadcast(table), part == F.col("__part")).withColumn(name, F.col("__start") + row).drop("__at", "__part", "__start")
