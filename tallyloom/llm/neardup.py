"""Near-duplicate records (problem 4): an exact set-similarity join with set-relation skipping.

Texts are compared as sets of words. Records with the same set form a class, and only one set per class is joined: the
answers of its copies are those of the class. Sets are written in one global order, rare words first. Three kinds of
inverted lists lose no pair that reaches the similarity:

* prefix lists of rare words: a pair that shares a rare word has its first common word in both prefixes;
* equality lists: a pair that shares no rare word has all of them against it, so little difference is left for the
  frequent words; cut by hash into more parts than that, some part is the same in both sets;
* prefix lists of frequent words, for pairs with a set that has so few rare words (or is so large) that the second
  argument does not hold for it.

Lists are sorted by size and sketch and skipped in blocks: by size, by position (too few words left behind the common
one), and by the relation of sets: what one set's comparison found too far away is skipped for the sets close to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import salted_join
from ..storage import written
from . import postings
from .postings import ANY, POSTING, Similarity, candidates, flat, hashed, mix, sketches, split_lists, words

#: A word is frequent from rows / 256 sets on, but at least and at most these; more if the list of frequent words grew over MOST_FREQUENT.
LEAST_FREQUENT, TOP_FREQUENT, MOST_FREQUENT = 512, 4_096, 1_000_000
#: Frequent words per part of an equality list.
PART_WORDS = 4.4
#: Sizes and rare-word counts from here on are put into classes of about 3 % in the plan's histogram.
FINE = 128


@dataclass
class Order:
    """The global order and what was planned from the histogram of (size, rare words)."""

    frequent: np.ndarray  # hashes of frequent words, sorted
    rank: np.ndarray  # their rank by rising count
    count: np.ndarray  # their counts
    parts: int  # parts of the equality lists; 0: not needed
    sim: Similarity


def classes(records: DataFrame, record_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members (record_id, hi, lo) names the class of each record, sets (hi, lo, toks) has one set per class.

    Null and blank texts, texts without a word and null ids belong to no class. A record with several texts is a member
    of several classes. The pair (hi, lo) is a 128-bit hash of the set.
    """
    toks = F.sort_array(F.array_distinct(hashed(words(F.col(text)))))
    hi, lo = F.xxhash64("toks"), F.xxhash64(F.lit("second"), F.reverse("toks"))
    sets = records.select(F.col(record_id).cast("string").alias("record_id"), toks.alias("toks")).where("record_id is not null and size(toks) > 0")
    # One row per class leaves the first shuffle; the copies of a class meet only as partial aggregates.
    one = written(sets.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.first("toks").alias("toks")), "sets")
    members = sets.select("record_id", hi.alias("hi"), lo.alias("lo")).distinct()
    return written(members, "members"), one


def plan(sets: DataFrame, sim: Similarity) -> tuple[Order, int, float]:
    """The order, the number of sets and the mean number of postings per set, from counts of words and of set shapes."""
    rows, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()
    floor = min(TOP_FREQUENT, max(LEAST_FREQUENT, rows // 256, 1))
    floor = max(floor, total // MOST_FREQUENT)  # words above it number at most total / floor
    counts = sets.select(F.explode("toks").alias("w")).groupBy("w").count().where(F.col("count") > floor).collect()
    counts.sort(key=lambda r: (r[1], r[0]))
    hashes = np.array([r[0] for r in counts], np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    order = Order(hashes[by_hash], np.arange(len(counts))[by_hash], np.array([r[1] for r in counts], np.int64)[by_hash], 0, sim)
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def shapes(batches):
        for b in batches:
            if len(b):
                values, row = flat(b["toks"])
                size = np.bincount(row, minlength=len(b))
                rare = np.bincount(row, weights=~_is_frequent(values, shared.value)[0], minlength=len(b)).astype(np.int64)
                step = np.maximum(1, 2 ** np.maximum(0, np.floor(np.log2(np.maximum(size, 1) / FINE)).astype(np.int64) - 2))
                cell, n = np.unique(np.stack([-(-size // step) * step, rare // step * step], axis=1), axis=0, return_counts=True)
                yield pd.DataFrame({"size": cell[:, 0], "rare": cell[:, 1], "n": n})

    cells = sets.select("toks").mapInPandas(shapes, "size long, rare long, n long").groupBy("size", "rare").agg(F.sum("n").alias("n")).collect()
    if not cells:
        return order, 0, 0.0
    size, rare, n = (np.array([r[i] for r in cells], np.float64) for i in range(3))
    budget = float((_slack(size, sim) - rare).max())
    if budget >= 0:
        even = max(1, round(float(((size - rare) * n).sum() / n.sum()) / PART_WORDS))
        order.parts = int(min(even, np.floor(2 * budget) + 1))
    prefix = np.minimum(sim.prefix(size.astype(np.int64)), size)
    return order, int(rows), float(((prefix + order.parts) * n).sum() / n.sum())


def _slack(size: np.ndarray, sim: Similarity) -> np.ndarray:
    """A set's share of the largest symmetric difference that the similarity allows: two shares add up to its bound."""
    return size * (sim.den - sim.num) / (sim.den + sim.num)


def _is_frequent(values: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    if not len(order.frequent):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(order.frequent, values), len(order.frequent) - 1)
    return order.frequent[at] == values, at


def emitted(batch: pd.DataFrame, order: Order) -> np.ndarray:
    """The postings of a batch of sets (hi, toks)."""
    values, row = flat(batch["toks"])
    n, sim = len(batch), order.sim
    size = np.bincount(row, minlength=n).astype(np.int64)
    frequent, at = _is_frequent(values, order)
    rank = np.where(frequent, order.rank[at] if len(order.rank) else 0, -1)
    b0, b1 = sketches(values, row, n)
    sort = np.lexsort((values, rank, row))
    values, row, frequent, at = values[sort], row[sort], frequent[sort], at[sort]
    position = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    rare = np.bincount(row, weights=~frequent, minlength=n).astype(np.int64)
    cid = batch["hi"].to_numpy(np.int64)
    hard = _slack(size, sim) - rare >= order.parts / 2

    def rows_of(rows: np.ndarray, key: np.ndarray, low, kind: int) -> np.ndarray:
        out = np.zeros(len(rows), POSTING)
        out["key"], out["cid"], out["b0"], out["b1"], out["size"], out["low"] = key, cid[rows], b0[rows], b1[rows], size[rows], low
        out["block"], out["kind"], out["mark"] = ANY, kind, hard[rows]
        return out

    in_prefix = position < sim.prefix(size)[row]
    pick = in_prefix & ~frequent
    out = [rows_of(row[pick], values[pick], position[pick], 0)]
    # Sets whose rare words alone exceed what a partner may lack can have no partner without a common rare word.
    open_ = size - (-((-sim.num * size) // sim.den)) - rare >= 0
    if order.parts:
        part = (mix(values, 7) % np.uint64(order.parts)).astype(np.int64)
        sums = np.zeros(n * order.parts, np.uint64)
        np.add.at(sums, (row * order.parts + part)[frequent], mix(values[frequent], 8))
        which, owner = np.tile(np.arange(order.parts), n), np.repeat(np.arange(n), order.parts)
        pick2 = (open_ & (rare < size))[owner]
        out.append(rows_of(owner[pick2], mix(sums[pick2] + which[pick2].astype(np.uint64), 9), 0, 1))
    pick = in_prefix & frequent & open_[row]
    lists = rows_of(row[pick], values[pick], position[pick], 2)
    out.append(split_lists(lists, -(-order.count[at[pick]] // postings.LIST_POSTINGS) if len(order.count) else np.ones(len(lists), np.int64)))
    return np.concatenate(out)


def _allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["kind"] != 2) | ((a["mark"] | b["mark"]) > 0)


def _lead(rows: np.ndarray) -> np.ndarray:
    """In a list of a frequent word only hard sets need comparing with all."""
    return (rows["kind"] != 2) | (rows["mark"] > 0)


def similar_classes(sets: DataFrame, sim: Similarity | None = None) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo, likeness): every pair of different classes that reaches the similarity, written to the shared folder."""
    sim = sim or Similarity()
    order, rows, per_set = plan(sets, sim)
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast(order)  # at most MOST_FREQUENT words
    close = candidates(sets.select("hi", "toks"), lambda b: emitted(b, shared.value), rows, rows * per_set, "hi", sim, _allowed, _lead)
    left = sets.select(F.col("hi").alias("a"), F.col("lo").alias("a_lo"), F.col("toks").alias("x"))
    right = sets.select(F.col("hi").alias("b"), F.col("lo").alias("b_lo"), F.col("toks").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    likeness = both / (F.size("x") + F.size("y") - both)
    checked = (
        close.join(left, "a")
        .join(right, "b")
        .where(both * (sim.num + sim.den) >= sim.num * (F.size("x") + F.size("y")))
        .select(F.col("a").alias("a_hi"), "a_lo", F.col("b").alias("b_hi"), "b_lo", likeness.alias("likeness"))
    )
    return written(checked, "similar")


def record_pairs(members: DataFrame, similar: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b): the classes' pairs and copies spelled out as pairs of different records, smaller id first.

    For classes with many copies the compact form (``members`` and ``similar``) is the one to use.
    """
    named = members.select(F.concat_ws(":", "hi", "lo").alias("c"), "record_id")
    pairs = similar.select(F.concat_ws(":", "a_hi", "a_lo").alias("c"), F.concat_ws(":", "b_hi", "b_lo").alias("d"))
    one = salted_join(named.withColumnRenamed("record_id", "x"), pairs, "c").select(F.col("d").alias("c"), "x")
    across = salted_join(named.withColumnRenamed("record_id", "y"), one, "c").select("x", "y")
    copied = named.join(named.groupBy("c").count().where("count > 1").select("c"), "c", "left_semi")
    within = salted_join(copied.withColumnRenamed("record_id", "x"), copied.withColumnRenamed("record_id", "y"), "c").where("x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")).distinct()


def linked_classes(members: DataFrame, similar: DataFrame) -> DataFrame:
    """(record_id, group_id, copies, links): one row per member that has a copy or a similar class.

    ``group_id`` is the smallest record id of the connected group, ``copies`` the number of records with the same set,
    ``links`` the number of similar classes.
    """
    from ..plans import connected_components

    name = lambda hi, lo: F.concat_ws(":", F.col(hi), F.col(lo))
    edges = similar.select(name("a_hi", "a_lo").alias("p"), name("b_hi", "b_lo").alias("q"))
    of = connected_components(edges, "p", "q")
    links = edges.select(F.explode(F.array("p", "q")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("links"))
    named = members.select(name("hi", "lo").alias("c"), "record_id")
    sizes = named.groupBy("c").agg(F.count(F.lit(1)).alias("copies"), F.min("record_id").alias("least"))
    per_class = sizes.join(links, "c", "left").join(of.withColumnRenamed("node", "c"), "c", "left").where("copies > 1 or links is not null").withColumn("component", F.coalesce("component", "c"))
    groups = per_class.groupBy("component").agg(F.min("least").alias("group_id"))
    shown = per_class.join(groups, "component").select("c", "group_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return salted_join(named, shown, "c").select("record_id", "group_id", "copies", "links")
