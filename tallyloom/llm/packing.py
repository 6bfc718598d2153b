"""Filling context windows with documents (problem 8): large-item matching on size counts.

Packing looks only at how many documents have each token count, a table of at most `capacity` rows. Documents above a
third of the capacity stand at most two to a window and are paired greedily, the largest with the largest that still
fits; smaller ones then go, in falling size, into the fullest window that still takes them. The result is a list of
segments "the documents of this size with these ranks go to these windows at this offset", which is joined back to the
documents by size and block of ranks: the ranks of a size are cut into as many blocks as the size has segments, so a
document meets two segments on average, however many a size has. Only texts longer than a window are cut: into full windows and one rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import ranked, unit_hash

#: Segments up to this number are broadcast (about 60 bytes each); more are joined by shuffle.
BROADCAST_SEGMENTS = 400_000
#: Documents of one size in a bucket of the ranking.
BUCKET_ROWS = 100_000

_encodings: dict[str, object] = {}


def default_vocabulary() -> str:
    """The byte-level vocabulary that token counts refer to unless another file is named."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("windows", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document with a non-empty text; whole texts are encoded, null and empty ones left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            yield pd.DataFrame({doc_id: b[doc_id], "n_tokens": [len(enc.encode_ordinary(t)) for t in b[text]]})

    rows = documents.select(F.col(doc_id), F.col(text)).where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(doc_id).isNotNull())
    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(count, f"{doc_id} {kind}, n_tokens long")


def pack(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(segments, windows): segments are (size, first rank, last rank, first window, offset), for sizes up to capacity."""
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    next_rank: dict[int, int] = defaultdict(int)
    segments: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted distinct gaps of open windows
    open_: dict[int, deque] = {}  # gap -> ranges of windows
    windows = 0

    def put(size: int, n: int, window: int, offset: int) -> None:
        segments.append((size, next_rank[size], next_rank[size] + n, window, offset))
        next_rank[size] += n
        left[size] -= n

    def keep(gap: int, first: int, last: int) -> None:
        if gap > 0 and last > first:
            if gap not in open_:
                open_[gap] = deque()
                insort(gaps, gap)
            open_[gap].append((first, last))

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect_left(large, min(a, capacity - a) + 1) - 1
            while k >= 0 and (left[large[k]] == 0 or (large[k] == a and left[a] < 2)):
                k -= 1
            b = large[k] if k >= 0 else 0
            n = left[a] if not b else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, windows, 0)
            if b:
                put(b, n, windows, a)
            keep(capacity - a - b, windows, windows + n)
            windows += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(gaps, s)
            if k == len(gaps):  # nothing open takes it: whole new windows of this size, and one that stays open
                per = capacity // s
                n = left[s] // per
                fill, rows = (per, n) if n else (left[s], 1)
                for j in range(fill):
                    put(s, rows, windows, j * s)
                keep(capacity - fill * s, windows, windows + rows)
                windows += rows
                continue
            gap = gaps[k]
            first, last = open_[gap].popleft()
            n = min(left[s], last - first)
            if first + n < last:
                open_[gap].appendleft((first + n, last))
            elif not open_[gap]:
                del open_[gap]
                gaps.pop(k)
            put(s, n, first, capacity - gap)
            keep(gap - s, first, first + n)
    return segments, windows


def blocks(segments: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple[int, int, int, int, int, int]], dict[int, int]]:
    """Segments as (size, block, first rank, last rank, first window, offset), repeated for every block of ranks that they reach into, and the width of a block by size."""
    of: dict[int, list] = defaultdict(list)
    for s in segments:
        of[s[0]].append(s)
    width = {size: -(-max(last for _, _, last, _, _ in parts) // len(parts)) for size, parts in of.items()}
    return [(s[0], b, *s[1:]) for s in segments for b in range(s[1] // width[s[0]], (s[2] - 1) // width[s[0]] + 1)], width


def windows_of(sizes: DataFrame, windows: DataFrame, doc_id: str = "doc_id", seed: str = "window") -> DataFrame:
    """(window_name, doc_id, piece, first_token, n_tokens, bin_id, bin_offset) for each line of the small table ``windows``.

    Bins of full pieces come first, numbered by document; piece counts up from 0 within a document. Lines with a null
    name or a capacity below 1 are ignored; documents with 0 tokens do not occur.
    """
    spark = sizes.sparkSession
    kinds = {r[0]: int(r[1]) for r in windows.where("window_name is not null and capacity_tokens > 0").select("window_name", "capacity_tokens").collect()}
    caps = spark.createDataFrame(sorted(kinds.items()), "window_name string, capacity int")
    items = (
        sizes.where("n_tokens > 0")
        .crossJoin(F.broadcast(caps))
        .select("window_name", "capacity", doc_id, F.col("n_tokens").alias("size_all"), F.floor(F.col("n_tokens") / F.col("capacity")).alias("full"))
        .withColumn("rest", F.col("size_all") - F.col("full") * F.col("capacity"))
    )
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for r in items.where("rest > 0").groupBy("window_name", "rest").count().collect():
        counts[r[0]][int(r[1])] = r[2]
    segments, widths = [], []
    for name, cap in sorted(kinds.items()):
        more, of = blocks(pack(counts[name], cap)[0])
        segments += [(name, *s) for s in more]
        widths += [(name, size, width) for size, width in of.items()]
    where = spark.createDataFrame(segments, "window_name string, rest long, block long, first long, last long, bin_first long, bin_offset long")
    if len(segments) <= BROADCAST_SEGMENTS:
        where = F.broadcast(where)
    width = F.broadcast(spark.createDataFrame(widths, "window_name string, rest long, width long"))  # one row per window and size
    most = max((n for of in counts.values() for n in of.values()), default=0)
    whole = ranked(items.where("rest > 0").withColumn("u", unit_hash(F.col("window_name"), F.col(doc_id).cast("string"), seed=seed)), ["window_name", "rest"], "u", doc_id, buckets=most // BUCKET_ROWS + 1)
    rests = (
        whole.join(width, ["window_name", "rest"])
        .withColumn("block", F.floor(F.col("rank") / F.col("width")))
        .join(where, ["window_name", "rest", "block"])
        .where("rank >= first and rank < last")
        .select("window_name", doc_id, F.col("full").cast("long").alias("piece"), (F.col("full") * F.col("capacity")).cast("long").alias("first_token"), F.col("rest").cast("long").alias("n_tokens"), F.concat(F.lit("r"), (F.col("bin_first") + F.col("rank") - F.col("first")).cast("string")).alias("bin_id"), "bin_offset")
    )
    cut = (
        items.where("full > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
        .select("window_name", doc_id, F.col("piece").cast("long").alias("piece"), (F.col("piece") * F.col("capacity")).cast("long").alias("first_token"), F.col("capacity").cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("f"), F.col(doc_id).cast("string"), F.col("piece").cast("string")).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    )
    return rests.unionByName(cut)


def usage(bins: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, bins, tokens, fill, least_bins): how full the used windows are, and a number below which no packing can go.

    ``least_bins`` is the larger of the tokens over the capacity and the number of pieces of more than half a window.
    """
    caps = F.broadcast(windows.select("window_name", "capacity_tokens").distinct())
    of = bins.join(caps, "window_name")
    used = of.groupBy("window_name", "capacity_tokens").agg(F.countDistinct("bin_id").alias("bins"), F.sum("n_tokens").alias("tokens"), F.count_if(2 * F.col("n_tokens") > F.col("capacity_tokens")).alias("__large"))
    fill = F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))
    return used.select("window_name", "bins", "tokens", fill.alias("fill"), F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")), "__large").alias("least_bins"))


def wholeness(bins: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, documents, cut_needlessly, overfull, overlapping): every document stands in every window kind; the other counts are 0 if no
    text was cut that fits, and no window holds more than it can or two texts at one place."""
    caps = F.broadcast(windows.where("window_name is not null and capacity_tokens > 0").select("window_name", "capacity_tokens").distinct())
    docs = bins.groupBy("window_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n")).join(caps, "window_name")
    whole = docs.groupBy("window_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("pieces") != F.ceil(F.col("n") / F.col("capacity_tokens"))).alias("cut_needlessly"))
    full = bins.groupBy("window_name", "bin_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("bin_offset") + F.col("n_tokens")).alias("end"), F.min("bin_offset").alias("begin")).join(caps, "window_name")
    # Texts that leave no gap from offset 0 on cannot overlap.
    tight = full.groupBy("window_name").agg(F.count_if(F.col("end") > F.col("capacity_tokens")).alias("overfull"), F.count_if((F.col("begin") != 0) | (F.col("end") != F.col("n"))).alias("overlapping"))
    return whole.join(tight, "window_name")
