"""Profiles of a dataset: counts, shares, composition, null rates, lengths, percentiles, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, rows) of several columns in one pass over GROUPING SETS; nulls are counted as null."""
    at = {c: f"__g{i}" for i, c in enumerate(columns)}
    flat = df.select(*[F.col(c).cast("string").alias(a) for c, a in at.items()])
    names = list(at.values())
    sets = flat.groupingSets([[F.col(a)] for a in names], *names).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("rows"))
    whole = (1 << len(names)) - 1
    field = value = None
    for i, (c, a) in enumerate(at.items()):
        here = F.col("gid") == whole - (1 << (len(names) - 1 - i))
        field = F.when(here, c) if field is None else field.when(here, c)
        value = F.when(here, F.col(a)) if value is None else value.when(here, F.col(a))
    return sets.select(field.alias("field"), value.alias("value"), "rows")


def composition(df: DataFrame, keys: list[str], synthetic: str, labels: dict[str, str]) -> DataFrame:
    """Rows, synthetic rows and their rate per key, and a map of value counts for every label column."""
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(synthetic)).alias("synthetic_row_count"))
    base = base.withColumn("synthetic_row_rate", F.round(F.col("synthetic_row_count") / F.col("row_count"), 4))
    for column, name in labels.items():
        counts = df.groupBy(*keys, F.col(column).alias("__v")).count().where("__v is not null")
        maps = counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "count")))).alias(name))
        base = base.join(maps, keys, "left")
    return base


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.withColumn("share", F.round(F.col("row_count") / F.sum("row_count").over(Window.partitionBy()), 4))  # one row per key


def null_rates(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, null_rate), 0 for an empty input; one pass."""
    one = df.agg(*[F.round(F.coalesce(F.avg(c.isNull().cast("int")), F.lit(0.0)), 4).alias(n) for n, c in fields.items()])
    return one.unpivot([], [F.col(f"`{n}`") for n in fields], "field", "null_rate")


def length_stats(df: DataFrame, keys: list[str], length: Column) -> DataFrame:
    x = length.cast("long")
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.coalesce(F.min(x), F.lit(0)).alias("least"), F.coalesce(F.max(x), F.lit(0)).alias("most"), F.coalesce(F.round(F.avg(x), 2), F.lit(0.0)).alias("mean"), F.coalesce(F.sum(x), F.lit(0)).alias("total"))


#: Ranges of values that a group is counted in before the range of a rank is looked into.
RANGES = 4_096


def ordered_values(df: DataFrame, keys: list[str], value: str, indexes: dict[str, Column]) -> DataFrame:
    """(keys, one column per index): the values at 0-based indexes of each group's sorted values; an index is an expression over ``n``, the group's size.

    A group is counted in ranges of its values first; only the distinct values of the ranges that hold a wanted index are
    sorted, so no task sees a whole group and nothing is approximate. Nulls are left out, null keys form a group; a
    group without a value gives no row.
    """
    x = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, (F.signum(x) * F.log1p(F.abs(x))).alias("__t"))
    as_ = lambda d, mark: d.withColumnsRenamed({k: f"{mark}{k}" for k in keys})
    same = lambda mark: [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys]
    ends = as_(rows.groupBy(*keys).agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi")), "__e")  # one row per key
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(RANGES - 1), F.floor((F.col("__t") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * RANGES))).otherwise(0)
    spread = (rows.join(ends, same("__e")) if keys else rows.crossJoin(F.broadcast(ends))).select(*keys, value, at.cast("int").alias("__r"))
    counts = spread.groupBy(*keys, "__r").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys)  # at most RANGES rows per key
    placed = counts.withColumn("n", F.sum("__c").over(w)).withColumn("__upto", F.sum("__c").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = placed.select(*keys, "__r", "__c", "__upto", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), i.cast("long").alias("i")) for o, i in indexes.items()])).alias("__w"))
    inside = as_(wanted.where((F.col("__upto") > F.col("__w.i")) & (F.col("__upto") - F.col("__c") <= F.col("__w.i"))).select(*keys, F.col("__r").alias("__q"), F.col("__w.o").alias("__o"), (F.col("__w.i") - F.col("__upto") + F.col("__c")).alias("__i")), "__p")
    on = [*same("__p"), F.col("__r") == F.col("__q")]
    near = spread.join(F.broadcast(inside) if not keys else inside, on, "left_semi").groupBy(*keys, "__r", value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = near.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys, "__r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    found = ranked.join(inside, on).where((F.col("__upto") > F.col("__i")) & (F.col("__upto") - F.col("__c") <= F.col("__i")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__o") == o, F.col(value))).alias(o) for o in indexes]) if keys else found.agg(*[F.max(F.when(F.col("__o") == o, F.col(value))).alias(o) for o in indexes])


def ordered_value(df: DataFrame, keys: list[str], value: str, index: Column, out: str) -> DataFrame:
    """:func:`ordered_values` for one index."""
    return ordered_values(df, keys, value, {out: index})


def rank_ceil(p: float) -> Column:
    """Nearest rank: index ceil(p n) - 1."""
    return F.greatest(F.lit(0), F.ceil(F.lit(p) * F.col("n")) - 1)


def rank_round(p: float) -> Column:
    """Index round((n - 1) p), halves to even."""
    return F.bround((F.col("n") - 1) * F.lit(p))


def rank_floor(p: float) -> Column:
    """Index floor((n - 1) p)."""
    return F.floor((F.col("n") - 1) * F.lit(p))


def bucket_label(length: Column, low: Column, high: Column) -> Column:
    return F.when(length <= low, "short").when(length <= high, "medium").otherwise("long")


def length_buckets(df: DataFrame, length: str) -> DataFrame:
    """Add ``bucket_label`` by the floored 33 % and 66 % cutoffs of the length; equal lengths share a bucket."""
    cuts = ordered_values(df, [], length, {"__low": rank_floor(0.33), "__high": rank_floor(0.66)})
    return df.crossJoin(F.broadcast(cuts)).withColumn("bucket_label", bucket_label(F.col(length), F.col("__low"), F.col("__high"))).drop("__low", "__high")  # one row


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, rows): min(40, max(10, floor(sqrt n))) bins of equal width; the greatest value falls into the last bin."""
    x = F.col(value).cast("double")
    s = df.where(F.col(value).isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.least(F.lit(40), F.greatest(F.lit(10), F.floor(F.sqrt(F.count(F.lit(1)))))).cast("int").alias("bins"))
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.col("bins"), F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")) + 1))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(s)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))  # s is one row


def heatmap(df: DataFrame, y: str, x: str, values: list, aggregate: Column) -> DataFrame:
    return df.groupBy(y).pivot(x, values).agg(aggregate).na.fill(0.0)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by the order columns, by a partially aggregated minimum; null keys form a group."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__r"))
    return best.select(*keys, *[F.col("__r")[c].alias(c) for c in [*order, *rest]])
