"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .skew import SMALL, hot_keys, star_join


def _contract(edges: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star step over (a, b), a > b; each group is reduced to its minimum, never listed.

    A node with a hundredth of the edges or more has its row of the two joins broadcast: there are at most 200 of them.
    """
    hot = sorted({*hot_keys(edges, "a"), *hot_keys(edges, "b")}) if rows > SMALL else []
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    # Large star: every neighbour above u is tied to the least of u's neighbourhood. A node that is its own minimum
    # leaves its edges as they are, so the centre of a large finished star costs no join.
    centres = least.where(F.col("m") < F.col("u"))
    large = (
        star_join(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), centres, "u", hot, "left")
        .select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b"))
        .unionByName(centres.select(F.col("u").alias("a"), F.col("m").alias("b")))
        .distinct()
    )
    # Small star: of the neighbours below u, all are tied to the least, and so is u.
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    return (
        star_join(large, low, "a", hot)
        .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .where("a > b")
        .distinct()
    )


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the least node of the component, for every node that has an edge to another node.

    Rounds go on until no edge changes; each is written to the shared folder, so lineage stays short and a lost executor
    costs one round. The number of rounds grows with the logarithm of the longest chain. Nulls and loops are ignored;
    an empty input gives an empty result.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()) if {a, b} != {"a", "b"} else edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(now.where("a > b").distinct(), "cc")
    signed = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    signature = signed(now)
    for _ in range(rounds):
        now = written(_contract(now, signature[0]), "cc")
        row = signed(now)
        if row == signature:
            break
        signature = row
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
