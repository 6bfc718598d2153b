"""Splits that keep related records together (problem 3).

Records are related when one names the other, or both name the same id, as lineage root or parent; connected components
of that relation are the groups. Groups are counted by size class and label profile (bundles), and only these counts go
to the driver. A min-cost flow sends the records of each bundle to the splits, with quotas on splits and convex costs
for splits whose share of a profile runs ahead; it is rounded to whole groups, largest sizes first, carrying what
rounding left over. Which groups of a bundle go where is decided by a seeded hash. The same table of groups tells which
of them today's marks tear apart.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import connected_components, ranked, salted_join
from ..plans.ranking import unit_hash
from ..storage import written
from .flow import INF, Network, apportion, slices
from .quota_sample import CATEGORIES, settled

#: Spellings of the two marks (fixed values).
TRAIN_MARKS = ("train", "training")
HELD_MARKS = ("eval", "evaluation", "validation", "test")
#: Groups up to this size are bundled by their exact size, larger ones by powers of 2 ** 0.25.
EXACT_SIZES = 64


def plain_id(c: Column | str) -> Column:
    """An identifier without blanks around it and in lower case; null if nothing is left."""
    x = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", ""))
    return F.when(x != "", x)


def _mark(split: Column, spellings: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(split, r"^\s+|\s+$", "")).isin(*spellings), F.lit(False))


def related(canonical: DataFrame) -> DataFrame:
    """(record_id, component, train, held, category): one row per distinct record id, written to the shared folder.

    Ids are compared without surrounding blanks and letter case, so spellings of one id are one node; named ids that
    are not in the table still tie. Records that name nothing but themselves are their own component. Null record ids
    are left out.
    """
    rows = canonical.select(
        "record_id",
        plain_id("record_id").alias("node"),
        plain_id("metadata.lineage_root_id").alias("root"),
        plain_id("metadata.parent_record_id").alias("parent"),
        _mark(F.col("split"), TRAIN_MARKS).alias("train"),
        _mark(F.col("split"), HELD_MARKS).alias("held"),
        settled(F.col("target.issue_category"), CATEGORIES).alias("category"),
    ).where("node is not null")
    edges = rows.select("node", F.explode(F.array("root", "parent")).alias("named")).where("named is not null and named <> node").distinct()
    of = connected_components(edges, "node", "named")
    records = rows.groupBy("record_id").agg(F.min("node").alias("node"), F.max("train").alias("train"), F.max("held").alias("held"), F.min("category").alias("category"))
    return written(records.join(of, "node", "left").select("record_id", "node", F.coalesce("component", "node").alias("component"), "train", "held", "category"), "related")


def with_seed_marks(records: DataFrame, tickets: DataFrame) -> DataFrame:
    """Add the marks that the seed table's non-blank split hints give to records of the same id."""
    hints = tickets.select(plain_id("record_id").alias("node"), _mark(F.col("split"), TRAIN_MARKS).alias("t"), _mark(F.col("split"), HELD_MARKS).alias("h"))
    hints = hints.where("node is not null and (t or h)").groupBy("node").agg(F.max("t").alias("t"), F.max("h").alias("h"))
    return records.join(hints, "node", "left").select("record_id", "component", "category", (F.col("train") | F.coalesce("t", F.lit(False))).alias("train"), (F.col("held") | F.coalesce("h", F.lit(False))).alias("held"))


def groups(records: DataFrame) -> DataFrame:
    """(component, group_id, size, train, held, category): one row per group; group_id is its smallest record id."""
    return records.groupBy("component").agg(
        F.min("record_id").alias("group_id"), F.count(F.lit(1)).alias("size"), F.max("train").alias("train"), F.max("held").alias("held"), F.min(F.struct("record_id", "category")).getField("category").alias("category")
    )


def _size_class(size: Column) -> Column:
    return F.when(size <= EXACT_SIZES, size).otherwise(EXACT_SIZES + F.ceil(4 * F.log2(size / EXACT_SIZES))).cast("int")


def allocate(bundles: list[tuple[int, str, int, int]], shares: dict[str, float]) -> list[tuple[int, str, str, int, int]]:
    """Split whole groups: (size class, profile, split, first rank, last rank) from (size class, profile, groups, records).

    Without shares every bundle goes whole to a null split.
    """
    if not shares:
        return [(size, profile, None, 0, n) for size, profile, n, _ in bundles]
    order = sorted(shares)
    whole = sum(shares.values()) or 1.0
    part = [shares[s] / whole for s in order]
    total = sum(b[3] for b in bundles)
    by_profile: dict[str, int] = defaultdict(int)
    for _, profile, _, records in bundles:
        by_profile[profile] += records
    net, arc = Network(), {}
    for size, profile, _, records in bundles:
        net.arc("S", ("b", size, profile), records)
        for s in order:
            arc[size, profile, s] = net.arc(("b", size, profile), ("p", profile, s), records)
    for profile, records in sorted(by_profile.items()):
        for s, n in zip(order, apportion(part, records), strict=True):
            net.arc(("p", profile, s), ("s", s), n)
            cost = 1
            for piece in slices(max(1, n)):
                net.arc(("p", profile, s), ("s", s), piece, cost)
                cost *= 2
            net.arc(("p", profile, s), ("s", s), INF, cost * 2)
    for s, n in zip(order, apportion(part, total), strict=True):
        net.arc(("s", s), "T", n)
        net.arc(("s", s), "T", INF, 1_000)
    net.send("S", "T", total)
    carry, out = dict.fromkeys(order, 0.0), []
    for size, profile, n, records in sorted(bundles, key=lambda b: (-b[0], b[1])):
        mean = records / n
        wish = {s: max(0.0, (net.flow(arc[size, profile, s]) + carry[s]) / mean) for s in order}
        scale = n / (sum(wish.values()) or 1.0)
        got = {s: math.floor(wish[s] * scale) for s in order}
        for s in sorted(order, key=lambda s: (got[s] - wish[s] * scale, s))[: n - sum(got.values())]:
            got[s] += 1
        first = 0
        for s in order:
            carry[s] += net.flow(arc[size, profile, s]) - got[s] * mean
            if got[s]:
                out.append((size, profile, s, first, first + got[s]))
                first += got[s]
    return out


def assign(records: DataFrame, targets: DataFrame, seed: str = "split") -> DataFrame:
    """(record_id, group_id, split_name, torn): every record, with all of its group in one split of ``targets`` (a small table).

    ``torn`` tells groups that carry both a train and a held-out mark today. Lines with a null name or share are ignored;
    with none left the split is null. Bundles are at most size classes x profiles, whatever the number of groups.
    """
    shares = {r[0]: float(r[1]) for r in targets.where("split_name is not null and target_share > 0").select("split_name", "target_share").collect()}
    of = written(groups(records).withColumn("size_class", _size_class(F.col("size"))).withColumn("profile", F.coalesce("category", F.lit("none"))), "groups")
    bundles = [tuple(r) for r in of.groupBy("size_class", "profile").agg(F.count(F.lit(1)), F.sum("size")).collect()]
    ranges = records.sparkSession.createDataFrame(allocate(bundles, shares), "size_class int, profile string, split_name string, first long, last long")
    dealt = ranked(of.withColumn("u", unit_hash("group_id", seed=seed)), ["size_class", "profile"], "u", "group_id")
    # Ranges of a bundle are disjoint, at most one per split, and cover all of its ranks.
    chosen = dealt.join(F.broadcast(ranges), ["size_class", "profile"]).where("rank >= first and rank < last").select("component", "group_id", "split_name", (F.col("train") & F.col("held")).alias("torn"))
    return salted_join(records.select("record_id", "component"), chosen, "component").select("record_id", "group_id", "split_name", "torn")


def shares(assigned: DataFrame, targets: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(split_name, target_share, records, actual_share, near_target, broken_groups): how near the splits came, and groups with records in more than one split."""
    counts = assigned.groupBy("split_name").agg(F.count(F.lit(1)).alias("records"))
    total = assigned.agg(F.count(F.lit(1)).alias("__all"))
    broken = assigned.groupBy("group_id").agg(F.min("split_name").alias("a"), F.max("split_name").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("broken_groups"))
    lines = targets.where("split_name is not null and target_share > 0").select("split_name", "target_share")
    out = F.broadcast(lines).join(counts, "split_name", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(broken))  # a row each
    share = F.coalesce(F.try_divide(F.coalesce("records", F.lit(0)), F.col("__all")), F.lit(0.0))
    return out.select("split_name", "target_share", F.coalesce("records", F.lit(0)).alias("records"), share.alias("actual_share"), (F.abs(share - F.col("target_share")) <= tolerance).alias("near_target"), "broken_groups")
