"""Same or near-same records across splits (problem 6): an exact join across the sides, then alignment.

Likeness of word sets implies no shared passage, and neither do short texts or passages that stand in very many texts, so
candidates come from the exact lists of the near-duplicate join (problem 4), joined across the splits: they lose no pair,
whatever else the tables hold. The sketch test of the posting engine throws out texts that cannot be alike. The rest are
aligned: the least rolling hashes of windows of five-word grams (winnowing) that both texts selected are the seeds, of
which the longest collinear chain is extended word by word, and the likeness is computed on the whole texts.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import salted_join
from ..storage import written
from . import neardup
from .postings import Similarity, candidates, flat, hashed, mix, words

#: Words per rolling hash (and seed of an alignment) and hashes per window.
GRAM, WINDOW = 5, 4
_WORD = re.compile(r"[^\W_]+")
HELD, TRAIN = 1, 2
#: Bit of a mark that the exact join sets on hard sets.
HARD = 4


def fingerprints(values: np.ndarray, row: np.ndarray, rows: int, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, row) in text order: the least rolling hash of every window. A shorter text gives the hash of all its words."""
    n = np.bincount(row, minlength=rows).astype(np.int64)
    starts = np.cumsum(n) - n
    rolled = np.zeros(len(values), np.uint64)
    for j in range(gram):  # texts shorter than a gram hash what they have
        at = np.arange(len(values)) + j
        inside = (at < len(values)) & (np.append(row, -1)[np.minimum(at, len(values))] == row)
        rolled = np.where(inside, rolled * np.uint64(0x100000001B3) + mix(values[np.minimum(at, max(0, len(values) - 1))], 31), rolled)
    grams = np.maximum(np.minimum(n, 1), n - gram + 1)
    padded = np.where(n > 0, np.maximum(grams, window), 0)
    owner = np.repeat(np.arange(rows), padded)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(padded) - padded, padded)
    real = offset < grams[owner]
    line = np.full(len(owner), np.uint64(2**64 - 1))
    line[real] = mix(rolled[starts[owner[real]] + offset[real]], 32)
    first = np.flatnonzero(offset <= (padded - window)[owner])
    least = line[first]
    for j in range(1, window):
        least = np.minimum(least, line[first + j])
    who = owner[first]
    new = np.append(True, (least[1:] != least[:-1]) | (who[1:] != who[:-1])) if len(least) else np.zeros(0, bool)
    return least[new], who[new]


def _once(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, by row."""
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.append(True, (values[1:] != values[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], values[new]


def texts(records: DataFrame, record_id: str, text: str, side: int) -> DataFrame:
    """(record_id, text, side) of the records with an id and a word in their text."""
    return records.select(F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("text"), F.lit(side).alias("side")).where("record_id is not null and text is not null")


def classes(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members (record_id, cid, lo, side); sets (cid, lo, toks, text, side), one per sequence of words.

    ``side`` of a set tells on which sides its records stand (1 held out, 2 training, 3 both).
    """
    toks = hashed(words(F.col("text")))
    named = both.select("record_id", "side", toks.alias("toks"), "text").where("size(toks) > 0")
    hi, lo = F.xxhash64("toks"), F.xxhash64(F.lit("second"), F.reverse("toks"))
    members = written(named.select("record_id", hi.alias("cid"), lo.alias("lo"), "side").distinct(), "overlap-members")
    sets = named.groupBy(hi.alias("cid"), lo.alias("lo")).agg(F.first("text").alias("text"), F.bit_or("side").alias("side"))
    return members, written(sets.withColumn("toks", hashed(words(F.col("text")))), "overlap-sets")


def _allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    across = (((a["mark"] & HELD) > 0) & ((b["mark"] & TRAIN) > 0)) | (((a["mark"] & TRAIN) > 0) & ((b["mark"] & HELD) > 0))
    return across & ((a["kind"] != 2) | (((a["mark"] | b["mark"]) & HARD) > 0))


def _lead(rows: np.ndarray) -> np.ndarray:
    return (rows["mark"] & HELD) > 0


def selected(w: list[str], gram: int = GRAM, window: int = WINDOW) -> dict[int, list[int]]:
    """Rolling hash -> positions of the grams of a text that are the least of a window of them (of equal ones the last)."""
    roll = [zlib.crc32(" ".join(w[i : i + gram]).encode()) for i in range(len(w) - gram + 1)]
    at = defaultdict(list)
    for i in sorted({min(range(a, min(a + window, len(roll))), key=lambda i: (roll[i], -i)) for a in range(max(1, len(roll) - window + 1) if roll else 0)}):
        at[roll[i]].append(i)
    return at


def aligned(a: list[str], b: list[str], gram: int = GRAM) -> tuple[int, int]:
    """(words of a, words of b) covered by the longest chain of collinear seeds, each extended while the words agree.

    Seeds are grams that both texts selected; a passage of gram + window - 1 common words holds at least one.
    """
    ours, theirs = selected(a, gram), selected(b, gram)
    seeds = sorted(((i, j) for h in ours.keys() & theirs.keys() for i in ours[h] for j in theirs[h] if a[i : i + gram] == b[j : j + gram]), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(seeds)
    for k, (_, j) in enumerate(seeds):
        p = bisect_left(tails, j)
        back[k] = ends[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[p], ends[p] = j, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(seeds[k])
        k = back[k]
    in_a, in_b, reach = set(), set(), (0, 0)
    for i, j in reversed(chain):
        x, y = i, j
        while x > reach[0] and y > reach[1] and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
        u, v = i, j
        while u < len(a) and v < len(b) and a[u] == b[v]:
            u, v = u + 1, v + 1
        in_a.update(range(x, u))
        in_b.update(range(y, v))
        reach = max(reach, (u, v))
    return len(in_a), len(in_b)


def similar_texts(sets: DataFrame, sim: Similarity | None = None) -> DataFrame:
    """(a, a_lo, b, b_lo, likeness, coverage_a, coverage_b) of pairs of different word sequences across the sides that reach the similarity."""
    sim = sim or Similarity()
    spark = sets.sparkSession
    bags = sets.select(F.col("cid").alias("hi"), F.sort_array(F.array_distinct("toks")).alias("toks"))
    order, count, per_set = neardup.plan(bags, sim)
    shared = spark.sparkContext.broadcast(order)  # at most neardup.MOST_FREQUENT words

    def emit(b: pd.DataFrame) -> np.ndarray:
        values, row = flat(b["toks"])
        owner, distinct = _once(row, values)
        cid = b["cid"].to_numpy(np.int64)
        ends = np.cumsum(np.bincount(owner, minlength=len(b)))
        out = neardup.emitted(pd.DataFrame({"hi": cid, "toks": np.split(distinct.view(np.int64), ends[:-1])}), shared.value)
        by_cid = np.argsort(cid)
        out["mark"] = out["mark"] * HARD + b["side"].to_numpy(np.uint8)[by_cid[np.searchsorted(cid[by_cid], out["cid"])]]
        return out

    close = candidates(sets.select("cid", "toks", "side"), emit, count, count * per_set, "cid", sim, _allowed, _lead)
    left = sets.select(F.col("cid").alias("a"), F.col("lo").alias("a_lo"), F.col("text").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("lo").alias("b_lo"), F.col("text").alias("y"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for a, a_lo, x, b, b_lo, y in zip(g["a"], g["a_lo"], g["x"], g["b"], g["b_lo"], g["y"], strict=True):
                v, w = _WORD.findall(x.lower()), _WORD.findall(y.lower())
                s, t = set(v), set(w)
                n = len(s & t)
                if n * (sim.num + sim.den) >= sim.num * (len(s) + len(t)):
                    p, q = aligned(v, w)
                    out.append((a, a_lo, b, b_lo, n / (len(s) + len(t) - n), p / len(v), q / len(w)))
            yield pd.DataFrame(out, columns=["a", "a_lo", "b", "b_lo", "likeness", "coverage_a", "coverage_b"])

    pairs = close.join(left, "a").join(right, "b")
    return written(pairs.mapInPandas(verify, "a long, a_lo long, b long, b_lo long, likeness double, coverage_a double, coverage_b double"), "overlaps")


def _ways(similar: DataFrame) -> DataFrame:
    """(c, d, likeness, coverage_c, coverage_d): every pair of classes in both directions."""
    c, d = F.concat_ws(":", "a", "a_lo"), F.concat_ws(":", "b", "b_lo")
    return similar.select(c.alias("c"), d.alias("d"), "likeness", F.col("coverage_a").alias("coverage_c"), F.col("coverage_b").alias("coverage_d")).unionByName(
        similar.select(d.alias("c"), c.alias("d"), "likeness", F.col("coverage_b").alias("coverage_c"), F.col("coverage_a").alias("coverage_d"))
    )


def record_overlaps(members: DataFrame, similar: DataFrame) -> DataFrame:
    """(held_id, train_id, likeness, held_coverage, train_coverage): pairs of different records across the sides, copies included.

    For classes with many copies the compact form (``linked_records``) is the one to use.
    """
    named = members.select(F.concat_ws(":", "cid", "lo").alias("c"), "record_id", "side")
    held = named.where(F.col("side") == HELD).select("c", F.col("record_id").alias("held_id"))
    train = named.where(F.col("side") == TRAIN).select("c", F.col("record_id").alias("train_id"))
    one = salted_join(held, _ways(similar), "c").select(F.col("d").alias("c"), "held_id", "likeness", F.col("coverage_c").alias("held_coverage"), F.col("coverage_d").alias("train_coverage"))
    near = salted_join(train, one, "c").select("held_id", "train_id", "likeness", "held_coverage", "train_coverage")
    whole = F.lit(1.0)
    same = salted_join(train, held, "c").select("held_id", "train_id", whole.alias("likeness"), whole.alias("held_coverage"), whole.alias("train_coverage"))
    return near.unionByName(same).where("held_id <> train_id").groupBy("held_id", "train_id").agg(F.max("likeness").alias("likeness"), F.max("held_coverage").alias("held_coverage"), F.max("train_coverage").alias("train_coverage"))


def linked_records(members: DataFrame, similar: DataFrame) -> DataFrame:
    """(record_id, side, same, near, coverage): one row per record and side that has a partner on the other side.

    ``same`` is the number of other records there with the same words in a row, ``near`` that of similar texts there,
    ``coverage`` the largest part of the record's text that stands in a partner. No copies are paired: classes are
    counted, and the counts come back to their members.
    """
    named = members.select(F.concat_ws(":", "cid", "lo").alias("c"), "record_id", "side")
    counts = named.groupBy("c").agg(F.count_if(F.col("side") == HELD).alias("held"), F.count_if(F.col("side") == TRAIN).alias("train"))
    # A record whose only partner of the same words is itself on the other side has none.
    twice = named.groupBy("c", "record_id").agg(F.count(F.lit(1)).alias("sides"))
    near = _ways(similar).join(counts.select(F.col("c").alias("d"), "held", "train"), "d").groupBy("c").agg(
        *[F.count_if(F.col(s) > 0).alias(f"near_{s}") for s in ("held", "train")], *[F.max(F.when(F.col(s) > 0, F.col("coverage_c"))).alias(f"coverage_{s}") for s in ("held", "train")]
    )
    per_class = counts.join(near, "c", "left").where("held > 0 and train > 0 or near_held > 0 or near_train > 0")
    rows = salted_join(named.join(twice, ["c", "record_id"]), per_class, "c")
    there = F.when(F.col("side") == HELD, F.col("train")).otherwise(F.col("held")) - (F.col("sides") - 1)
    close = F.coalesce(F.when(F.col("side") == HELD, F.col("near_train")).otherwise(F.col("near_held")), F.lit(0))
    covered = F.when(F.col("same") > 0, 1.0).otherwise(F.when(F.col("side") == HELD, F.col("coverage_train")).otherwise(F.col("coverage_held")))
    found = rows.withColumns({"same": there, "near": close}).where("same > 0 or near > 0").withColumn("coverage", covered)
    # A record with several texts is told once, by all of them.
    return found.groupBy("record_id", F.when(F.col("side") == HELD, "held_out").otherwise("train").alias("side")).agg(F.sum("same").alias("same"), F.sum("near").alias("near"), F.max("coverage").alias("coverage"))
