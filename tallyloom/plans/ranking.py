"""Exact ranks within groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(*parts: Column | str, seed: str = "") -> Column:
    """A number in [0, 1) from the first 52 bits of a SHA-256; the same in every engine and layout."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def ranked(df: DataFrame, keys: list[str], unit: str, tie: str, out: str = "rank", buckets: int = 256, weight: str | None = None) -> DataFrame:
    """Add ``out``, the 0-based rank of each row within ``keys`` by (``unit``, ``tie``); with ``weight``, the sum of that column over the rows before it.

    ``unit`` is a double in [0, 1), about evenly spread. A group is cut into ``buckets`` ranges of ``unit``; a running
    sum of the bucket counts (at most groups x buckets rows) gives each bucket its offset, and rows are sorted only
    within a bucket. A group holding a third of all rows is thus spread over ``buckets`` sorts. Null keys form a group.
    """
    b = "__bucket"
    cut = df.withColumn(b, F.least(F.floor(F.col(unit) * buckets), F.lit(buckets - 1)).cast("int"))
    counts = cut.groupBy(*keys, b).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(b).alias("__b"), before.alias("__offset"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col(b) == F.col("__b")]
    w = Window.partitionBy(*keys, b).orderBy(unit, tie)
    inside = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(w) - 1
    return (
        cut.withColumn("__inside", inside)
        .join(offsets, on, "left")
        .withColumn(out, (F.col("__inside") + F.col("__offset")).cast("long"))
        .drop(b, "__b", "__inside", "__offset", *[f"__k{i}" for i in range(len(keys))])
    )
