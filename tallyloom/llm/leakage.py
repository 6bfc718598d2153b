"""Evaluation texts leaking into training text (problem 9): a distributed positional inverted index.

The index holds a posting (term, document, position) for every word of the training texts. It is cut by documents, not by
terms: a task indexes the texts it reads, sorted by term, so that nothing is shuffled, no frequent term makes a long list
in one place, and a query reads the few row groups of its terms. New documents are appended as a batch.

A query counts how often the held-out words stand in the index. For every run of ``run`` words of an item its two rarest
terms become anchors; a run with a term that no document has cannot occur and gets none. Offset-adjusted postings
(document position minus item position) of the two anchors of a run must meet in one document; there the run is compared
word by word. Passages that are not copied letter by letter are found by proximity: of a window of words all but a few
must stand near their place, so of that many anchors and six more at least six do, at offsets that are close.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Batches, scratch
from .postings import words

#: The held-out table is of fixed size; more rows or characters than this are refused rather than collected.
MOST_ITEMS, MOST_CHARACTERS = 200_000, 64_000_000
#: Positions by which a word may be off its place and still count as near.
NEAR = 3
#: Words of a proximity window, and the least length of an item that is looked for as a whole.
WINDOW, SHORT = 26, 5
#: Pins of an item that must meet before a window is looked at.
PINS = 6


class PositionalIndex:
    """Postings of documents below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str, doc_type: str = "bigint") -> None:
        self.postings_ = Batches(spark, f"{path.rstrip('/')}/postings", f"term string, doc_id {doc_type}, pos int")
        self.documents_ = Batches(spark, f"{path.rstrip('/')}/documents", f"doc_id {doc_type}")

    def append(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> PositionalIndex:
        """Index the documents whose id is not in yet; null ids and null texts are left out.

        An index for one set of items may hold ``only`` their terms (a small table); it is then not sorted.
        """
        rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
        if self.documents_.count():
            rows = rows.join(self.documents_.read().select("doc_id"), "doc_id", "left_anti")
        exploded = rows.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
        self.postings_.append((exploded.sortWithinPartitions("term") if only is None else exploded.join(F.broadcast(only), "term", "left_semi")).select("term", "doc_id", "pos"))
        self.documents_.append(rows.select("doc_id").distinct())
        return self

    def postings(self, terms: DataFrame) -> DataFrame:
        """(term, doc_id, pos, ...) of the terms of a small table, with its other columns."""
        return self.postings_.read().drop("batch").join(F.broadcast(terms), "term")


def held_out(items: DataFrame, item_id: str = "item_id", text: str = "text") -> dict:
    """Item -> words, of a table of fixed size."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    if n > MOST_ITEMS or size > MOST_CHARACTERS:
        raise ValueError(f"more than {MOST_ITEMS} held-out items or {MOST_CHARACTERS} characters; look for them in blocks")
    return {r[0]: list(r[1]) for r in sorted(rows.select("i", words(F.col("t"))).collect(), key=str)}


def anchors(items: dict, counts: dict[str, int], run: int) -> set[tuple]:
    """(item, position) of the two rarest words of every run that can occur; an item shorter than a run is a run of its own."""
    out = set()
    for item, w in items.items():
        size = min(run, len(w))
        for a in range(len(w) - size + 1) if size >= min(run, SHORT) else ():
            span = range(a, a + size)
            if all(w[i] in counts for i in span):
                out.update((item, i) for i in sorted(span, key=lambda i: (counts[w[i]], i))[:2])
    return out


def near_anchors(items: dict, counts: dict[str, int], run: int, share: float) -> set[tuple]:
    """(item, position) of the rarest words of every window, as many as it may lack and those that must meet; words that no document has are lacking anyhow."""
    out, meet = set(), _meet(run, share)
    for item, w in items.items():
        size = min(WINDOW, len(w))
        for a in range(len(w) - size + 1) if size >= run else ():
            there = sorted((i for i in range(a, a + size) if w[i] in counts), key=lambda i: (counts[w[i]], i))
            spare = len(there) - _least(size, share)  # of these so many may be lacking
            if spare >= 0:
                out.update((item, i) for i in there[: spare + meet])
    return out


def _meet(run: int, share: float) -> int:
    return min(PINS, _least(run, share))


def _least(size: int, share: float) -> int:
    return -int(-size * share // 1)


def longest_run(v: list, w: list, shift: int, run: int) -> tuple[int, int]:
    """(words, item position) of the longest run of at least ``run`` words that item ``v`` and text ``w`` share at a shift."""
    best, length, end = (0, 0), 0, min(len(v), len(w) - shift)
    for i in range(max(0, -shift), end + 1):
        if i < end and v[i] == w[i + shift]:
            length += 1
            continue
        if length >= run and length > best[0]:
            best = (length, i - length)
        length = 0
    return best


def nearest(v: list, w: list, shifts: range, share: float) -> tuple[int, int, int]:
    """(words near, item position, shift) of the window of ``v`` of which most words stand near their place in ``w`` at one of the shifts; (0, 0, 0) if less than ``share`` do."""
    size = min(WINDOW, len(v))
    offsets = []  # of each word of the item, where it stands against its place
    lo, hi = max(0, shifts[0] - NEAR), min(len(w), len(v) + shifts[-1] + NEAR + 1)
    at: dict[str, list[int]] = defaultdict(list)
    for p in range(lo, hi):
        at[w[p]].append(p)
    for i, x in enumerate(v):
        offsets.append([p - i for p in at.get(x, ()) if shifts[0] - NEAR <= p - i <= shifts[-1] + NEAR])
    best = (0, 0, 0)
    for s in shifts:
        near = [any(abs(d - s) <= NEAR for d in ds) for ds in offsets]
        n = sum(near[:size])
        for a in range(len(v) - size + 1):
            if a:
                n += near[a + size - 1] - near[a - 1]
            if n > best[0]:
                best = (n, a, s)
    return best if best[0] >= _least(size, share) else (0, 0, 0)


def leaks(documents: DataFrame, items_table: DataFrame, run: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", near_share: float | None = None, index: PositionalIndex | None = None) -> DataFrame:
    """(doc_id, item_id, kind, doc_position, item_position, run_words, near_words): where an item stands in a document, one row per pair.

    ``kind`` is ``run`` for at least ``run`` words in a row on both sides (the longest is told), ``whole`` for an item of
    fewer but at least SHORT words that stands there whole, and, if ``near_share`` is given, ``near`` where so large a
    share of a window of WINDOW words of the item (or of all, if it has fewer, but at least ``run``) stands in the
    document within NEAR positions of their place. ``near_words`` counts the item's words near their place along the
    match. ``index`` is an index that holds the documents; without one it is built. Null texts and ids never match;
    copies of a document are reported each under its own id.
    """
    spark = documents.sparkSession
    items = held_out(items_table, item_id, item_text)
    kind, ikind = documents.schema[doc_id].dataType.simpleString(), items_table.schema[item_id].dataType.simpleString()
    vocabulary = spark.createDataFrame(sorted({(x,) for w in items.values() for x in w}), "term string")
    index = index or PositionalIndex(spark, scratch(spark, "index"), kind).append(documents, doc_id, text, vocabulary)
    counts = {r[0]: r[1] for r in index.postings(vocabulary).groupBy("term").count().collect()}  # one row per held-out word

    def pins(chosen: set[tuple]) -> DataFrame:
        return spark.createDataFrame(sorted(((items[i][p], i, p) for i, p in chosen), key=str), f"term string, item {ikind}, pin int")

    # A hit of an exact run is a shift at which two pins meet, that of a window a stretch of shifts.
    met = index.postings(pins(anchors(items, counts, run))).groupBy("doc_id", "item", (F.col("pos") - F.col("pin")).alias("hit")).agg(F.count_distinct("pin").alias("pins")).where("pins >= 2").withColumn("close", F.lit(False))
    if near_share is not None:
        stretch = F.floor((F.col("pos") - F.col("pin")) / (2 * NEAR)).cast("int")
        close = index.postings(pins(near_anchors(items, counts, run, near_share))).select("doc_id", "item", "pin", F.explode(F.array(stretch, stretch + 1)).alias("hit"))
        met = met.unionByName(close.groupBy("doc_id", "item", "hit").agg(F.count_distinct("pin").alias("pins")).where(F.col("pins") >= _meet(run, near_share)).withColumn("close", F.lit(True)))
    # The hits of one item in one document are at most as many as the two have words.
    of = met.groupBy("doc_id", "item").agg(F.collect_list(F.when(~F.col("close"), F.col("hit"))).alias("shifts"), F.collect_list(F.when(F.col("close"), F.col("hit"))).alias("stretches"))
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    known = spark.sparkContext.broadcast(items)  # at most MOST_CHARACTERS

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for d, item, tokens, shifts, stretches in zip(b["doc_id"], b["item"], b["words"], b["shifts"], b["stretches"], strict=True):
                v, w = known.value[item], list(tokens)
                n, at, shift = max(((*longest_run(v, w, s, min(run, len(v))), s) for s in sorted(shifts)), key=lambda x: x[0], default=(0, 0, 0))
                if n:
                    near = sum(x in w[max(0, i + shift - NEAR) : max(0, i + shift + NEAR + 1)] for i, x in enumerate(v))
                    out.append((d, item, "run" if len(v) >= run else "whole", at + shift, at, n, near))
                elif len(stretches):
                    near, at, shift = max((nearest(v, w, range(2 * NEAR * (s - 1) - NEAR, 2 * NEAR * (s + 1) + NEAR), near_share) for s in sorted(stretches)), key=lambda x: x[0])
                    if near:
                        out.append((d, item, "near", max(0, at + shift), at, longest_run(v, w, shift, 1)[0], near))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "doc_position", "item_position", "run_words", "near_words"])

    full = of.join(texts, "doc_id").select("doc_id", "item", words(F.col("text")).alias("words"), "shifts", "stretches")
    # A document id that stands on several rows is compared with each of its texts.
    best = full.mapInPandas(compare, f"doc_id {kind}, item_id {ikind}, kind string, doc_position int, item_position int, run_words int, near_words int")
    if doc_id != "doc_id":
        best = best.withColumnRenamed("doc_id", doc_id)
    return best.withColumnRenamed("item_id", item_id) if item_id not in ("item_id", doc_id) else best
