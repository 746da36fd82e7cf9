"""The comparison job: distances of every candidate to the original, winners, wins, ranking, plot tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import compare as cmp
from tabloom.operators.cdf import Axis
from tabloom.operators.histogram import box_statistics, density_histogram, qq_table
from tabloom.sources.tables import facts_of

ORIGINAL = "original"


@dataclass
class Comparison:
    axis: Axis
    candidates: list[str]
    distances: DataFrame

    def winners(self) -> DataFrame:
        return cmp.winners(self.distances, self.candidates)

    def wins(self) -> DataFrame:
        return cmp.wins(self.distances)

    def ranking(self) -> DataFrame:
        return cmp.ranking(self.distances)

    def densities(self) -> DataFrame:
        return density_histogram(self.axis)

    def boxes(self) -> DataFrame:
        return box_statistics(self.axis)

    def quantiles(self) -> DataFrame:
        return qq_table(self.axis, ORIGINAL)

    def facts(self) -> DataFrame:
        return (
            facts_of("distances", self.distances, ("column", "candidate"))
            .unionByName(facts_of("winners", self.winners(), ("column", "metric")))
            .unionByName(facts_of("wins", self.wins(), ("metric", "candidate")))
            .unionByName(facts_of("ranking", self.ranking(), ("candidate",)))
        )


def compare(original: DataFrame, candidates: Mapping[str, DataFrame], columns: Sequence[str] | None = None, **options) -> Comparison:
    """Score every candidate on every shared numeric column."""
    axis = cmp.source_axis(original, candidates, columns, ORIGINAL, **options)
    return Comparison(axis, list(candidates), cmp.distances(axis, ORIGINAL))


def wide_distances(table: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """One row per column: metric x candidate."""
    return table.groupBy("column").agg(*[
        F.max(F.when(F.col("candidate") == c, F.col(m))).alias(f"{m}_{c}") for m in cmp.METRICS for c in candidates])
