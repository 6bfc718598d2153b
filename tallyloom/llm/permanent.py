"""Samples that stay put as data grows (problem 7): permanent random numbers.

Every identifier gets a number in [0, 1) when it is first seen, and keeps it: new identifiers are found by an anti-join
against the registry and appended with their numbers. A sample is always "number below threshold", and a threshold
never falls. So a record once selected stays selected, whatever arrives later and however rows are laid out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import unit_hash
from ..storage import Batches


class NumberRegistry:
    """Permanent numbers and thresholds below one folder of a shared file system.

    Numbers come from a hash of seed and identifier rather than from a generator: a task that is run twice, after an
    executor was lost, writes the same number. They are persisted all the same, so a later change of the seed leaves
    identifiers that were seen before untouched. Every append is a numbered batch that is written once: an append that
    failed on its way is overwritten, of two writers that want the same number one takes the next, and an identifier
    that stands in several batches has the number of the first.
    """

    def __init__(self, spark: SparkSession, path: str, seed: str = "permanent") -> None:
        self.seed = seed
        self._numbers = Batches(spark, f"{path.rstrip('/')}/numbers", "id string, u double")
        self._thresholds = Batches(spark, f"{path.rstrip('/')}/thresholds", "sample_name string, rate double")

    def numbers(self) -> DataFrame:
        """(id, u) of all identifiers seen so far, one row each."""
        return self._numbers.read().groupBy("id").agg(F.min_by("u", "batch").alias("u"))

    def register(self, ids: DataFrame, column: str) -> DataFrame:
        """Add the identifiers not seen before; nulls are left out, repeats count once. Returns all numbers."""
        fresh = ids.select(F.col(column).cast("string").alias("id")).where("id is not null").distinct().join(self._numbers.read().select("id"), "id", "left_anti")
        self._numbers.append(fresh.select("id", unit_hash("id", seed=self.seed).alias("u")))
        return self.numbers()

    def thresholds(self, rates: DataFrame) -> DataFrame:
        """(sample_name, threshold): the largest rate ever asked for under each name, after adding what in ``rates`` is new or larger.

        A null rate counts as 0.
        """
        known = self._thresholds.read().groupBy("sample_name").agg(F.max("rate").alias("rate"))
        asked = rates.where("sample_name is not null").groupBy("sample_name").agg(F.coalesce(F.max("rate"), F.lit(0.0)).alias("rate"))
        more = asked.join(known.withColumnRenamed("rate", "before"), "sample_name", "left").where("before is null or rate > before").select("sample_name", "rate")
        if not more.isEmpty():
            self._thresholds.append(more.coalesce(1))
        return self._thresholds.read().groupBy("sample_name").agg(F.max("rate").alias("threshold"))


def permanent_sample(ids: DataFrame, column: str, rates: DataFrame, registry: NumberRegistry) -> DataFrame:
    """(sample_name, id): for each line of the small table ``rates``, the identifiers of ``ids`` below its threshold.

    Asks of earlier calls count: a rate lowered later changes nothing.
    """
    numbers = registry.register(ids, column)
    now = ids.select(F.col(column).cast("string").alias("id")).where("id is not null").distinct()
    wanted = rates.select("sample_name").distinct()
    chosen = registry.thresholds(rates).join(F.broadcast(wanted), "sample_name")
    return now.join(numbers, "id").join(F.broadcast(chosen), F.col("u") < F.col("threshold")).select("sample_name", F.col("id").alias(column))
