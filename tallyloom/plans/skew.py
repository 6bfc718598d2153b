"""Equi joins in which one key may hold a third of the rows of the left side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Inputs up to this number of rows are joined as they are; the result is the same either way.
SMALL = 100_000


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """The keys that hold at least ``share`` of the rows, so at most 1 / share of them; none of a small input. One pass."""
    seen = Observation()
    top = df.observe(seen, F.count(F.lit(1)).alias("n")).where(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count")).limit(int(1 / share) + 1).collect()
    total = seen.get.get("n", 0) if top else 0
    return [r[0] for r in top if r[1] >= total * share] if total > SMALL else []


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 32, share: float = 0.01) -> DataFrame:
    """Join on ``key`` with the left side's hot keys split over ``salts`` tasks.

    ``right`` should hold few rows per key. Right rows of hot keys are repeated once per salt. The salt is a hash of the
    row, so a repeated task sends it to the same place. Null keys never match; with ``how="left"`` their rows stay.
    """
    hot = hot_keys(left, key, share)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    left_salted = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right_salted = right.withColumn("__salt", F.explode(copies))
    return left_salted.join(right_salted, [key, "__salt"], how).drop("__salt")


def star_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Join on ``key`` where ``right`` has at most one row per key: the rows of the listed hot keys meet a broadcast of so many rows."""
    if not hot:
        return left.join(right, key, how)
    is_hot: Column = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))
