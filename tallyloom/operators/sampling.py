"""Deterministic sampling, quotas and mixes. Order is by hash of seed and id, never by position or random state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import order_key
from ..plans.ranking import ranked
from ..storage import written


#: Rows that one task may sort at the end of a top-n.
TOP = 10_000


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by the order columns; of more than TOP rows cut by distributed position."""
    if n <= TOP:
        return df.orderBy(*order).limit(n)
    return chunks(df, order, 1).where(F.col("chunk") < n).drop("chunk")


def hash_top_n(df: DataFrame, record_id: str, seed: int, n: int) -> DataFrame:
    """The n rows that come first in hash order: a partial top-n per partition and one merge, or, of more than TOP rows, a cut by distributed rank."""
    if n > TOP:
        return hash_ranked(df.withColumn("__all", F.lit(0)), record_id, seed, ["__all"]).where(F.col("hash_rank") < n).drop("hash_rank", "__all")
    return df.withColumn("__k", order_key(F.col(record_id), seed)).orderBy("__k", record_id).limit(n).drop("__k")


def _unit(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)


def hash_ranked(df: DataFrame, record_id: str, seed: int, keys: list[str], out: str = "hash_rank") -> DataFrame:
    """0-based ranks in hash order within the keys, for groups of any size."""
    keyed = df.withColumn("__k", order_key(F.col(record_id), seed)).withColumn("__u", _unit(F.col("__k"))).withColumn("__t", F.concat_ws(":", "__k", record_id))
    return ranked(keyed, keys, "__u", "__t", out).drop("__k", "__u", "__t")


def percent_subset(df: DataFrame, record_id: str, percent: float, seed: int = 17, limit: int | None = None) -> DataFrame:
    """Exactly max(1, floor(n * percent)) rows in hash order, of them the first ``limit`` by id; an empty input stays empty.

    ``percent`` outside (0, 1] is an error, as is a negative limit.
    """
    if not 0 < percent <= 1:
        raise ValueError("percent must lie in (0, 1]")
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    k = max(1, math.floor(df.count() * percent))
    out = df if percent == 1 else hash_ranked(df.withColumn("__all", F.lit(0)), record_id, seed, ["__all"]).where(F.col("hash_rank") < k).drop("hash_rank", "__all")
    return out if limit is None else first_n(out, [record_id], limit)


def quotas(counts: dict[str, int], target: int, weights: dict[str, float], max_share: float | None = None) -> dict[str, int]:
    """Rows per source: shares by weight (half to even, at least 1, at most what is there), filled up in name order,
    trimmed from the largest, and only then capped, so that a capped result may stay below the target."""
    names = sorted(counts)
    weight = {s: weights.get(s, 1.0) for s in names}
    whole = sum(weight.values()) or 1.0
    got = {s: min(counts[s], max(1, round(target * weight[s] / whole))) for s in names}
    spare = target - sum(got.values())
    for s in names:
        if spare > 0:
            add = min(spare, counts[s] - got[s])
            got[s], spare = got[s] + add, spare - add
    for s in sorted(names, key=lambda s: -got[s]):
        if spare < 0:
            cut = min(-spare, got[s])
            got[s], spare = got[s] - cut, spare + cut
    cap = None if max_share is None else max(1, math.floor(target * max_share))
    return {s: n if cap is None else min(n, cap) for s, n in got.items()}


def weighted_sample(df: DataFrame, source: str, record_id: str, target: int | None, weights: dict[str, float], max_share: float | None, seed: int) -> DataFrame:
    """A quota sample per source; all rows if ``target`` is None. Sources are few: only their counts are collected."""
    if target is None:
        return df
    chosen = quotas({r[0]: r[1] for r in df.where(F.col(source).isNotNull()).groupBy(source).count().collect()}, target, weights, max_share)
    plan = df.sparkSession.createDataFrame(sorted(chosen.items()), "__s string, __quota long")
    return hash_ranked(df, record_id, seed, [source]).join(F.broadcast(plan), F.col(source) == F.col("__s")).where("hash_rank < __quota").drop("__s", "__quota", "hash_rank")


def cap_synthetic(df: DataFrame, synthetic: str, record_id: str, share: float, seed: int) -> DataFrame:
    """All real rows and at most floor(real * share / max(1 - share, 0.01)) synthetic ones, in hash order."""
    real = df.where(~F.col(synthetic)).count()
    most = math.floor(real * share / max(1.0 - share, 0.01))
    kept = hash_ranked(df.where(F.col(synthetic)).withColumn("__all", F.lit(0)), record_id, seed, ["__all"]).where(F.col("hash_rank") < most)
    return df.where(~F.col(synthetic)).unionByName(kept.select(df.columns))


def mix_plan(name: str, total: int, seed: int) -> list[tuple[str, int, int | None]]:
    """(bucket, seed, rows) draws of a named workload mix; None: whatever is missing to the total. Unknown names are an error."""
    part, _, rest = name.partition("_mix_")
    if name == "smoke_stratified":
        each = max(1, total // 3)
        return [(b, seed + i * each, each) for i, b in enumerate(("short", "medium", "long"))]
    if name in ("natural_short_only", "natural_medium_only", "natural_long_only"):
        return [(name.split("_")[1], seed, total)]
    if name == "stress_long_only":
        return [("stress_long", seed, total)]
    if part in ("natural", "stress") and rest:
        a, b = (int(x) / 100 for x in rest.split("_")[:2])
        short = round(total * a)
        long = round(total * b) if short + round(total * b) <= total else max(0, total - short)
        draws = [("short", seed, short), ("long" if part == "natural" else "stress_long", seed + 1, long)]
        return [*draws, ("medium", seed + 2, None)] if part == "natural" else draws
    raise ValueError(f"unknown workload mix {name!r}")


def workload_mix(rows: DataFrame, bucket: str, record_id: str, name: str, total: int, seed: int) -> DataFrame:
    """The rows of a mix, with ``mix_name``. ``bucket`` is short, medium, long, or stress_long for generated rows."""
    out, have = None, 0
    for b, s, n in mix_plan(name, total, seed):
        take = max(0, total - have) if n is None else n
        drawn = hash_top_n(rows.where(F.col(bucket) == b), record_id, s, take)
        if n is not None:
            have += min(take, rows.where(F.col(bucket) == b).count())
        out = drawn if out is None else out.unionByName(drawn)
    return out.withColumn("mix_name", F.lit(name)).limit(total) if total else out.limit(0).withColumn("mix_name", F.lit(name))


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Number rows in order and cut them into chunks of ``size`` (at least 1): an ordinal by range-partitioned offsets."""
    w = Window.partitionBy("__p").orderBy(*order)
    parts = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ordered")  # ids must not change between the count and the numbering
    counts = parts.groupBy("__p").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return parts.withColumn("__i", F.row_number().over(w)).join(F.broadcast(counts), "__p").withColumn("chunk", F.floor((F.col("__i") + F.col("__before") - 1) / max(1, size)).cast("long")).drop("__p", "__i", "__before")
