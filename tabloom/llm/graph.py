"""Connected components by label propagation with pointer jumping over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): for every vertex of the edge table the smallest vertex it is connected with.

    Each round takes the smallest label among neighbours, then the label of that label; rounds grow with the logarithm
    of the longest path in practice. State is written out every round; nothing but a count comes to the driver.
    """
    both = stored(edges.select(F.col(a).alias("v"), F.col(b).alias("u")).unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("u"))).distinct())
    labels = stored(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("there")), "u").groupBy("v").agg(F.min("there").alias("there"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "there").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = stored(step.join(jump, "label", "left").select("v", "old", F.least(F.col("label"), F.coalesce("far", "label")).alias("label")))
        labels = step.select("v", "label")
        if not step.where("old <> label").head(1):
            return labels
