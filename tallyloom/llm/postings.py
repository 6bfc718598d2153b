"""Inverted lists that are joined inside numpy: the engine below the similarity joins.

Postings of a batch are packed into one binary row per target bucket, so the shuffle moves few rows that compress well, and a bucket is
sorted and joined by array operations. A posting carries the size of its set and a 128-bit sketch; two sets of sizes s
and t that reach the similarity share at least o = ceil(T (s + t) / (1 + T)) elements, so their sketches differ in at
most s + t - 2 o bits (a bit is the parity of a bin, so common elements cancel). That test never loses a pair; what it lets through is verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One posting. ``low`` is the number of elements before the list's element in the set's global order (prefix lists),
#: ``block`` the part of a split list (ANY: not split), ``mark`` a bit set whose meaning the caller gives.
POSTING = np.dtype([("key", "<u8"), ("cid", "<i8"), ("b0", "<u8"), ("b1", "<u8"), ("size", "<u4"), ("low", "<u4"), ("block", "<u2"), ("kind", "u1"), ("mark", "u1")])
ANY = 65_535
#: Lists up to this length are joined together, offset by offset; longer ones block by block.
SHORT = 48
#: Cells of one comparison block.
CELLS = 1 << 20
#: Postings of a bucket, and of a part of a long list; tasks that join buckets; long lists that are known beforehand.
BUCKET_POSTINGS, LIST_POSTINGS, MOST_TASKS, MOST_LISTS = 131_072, 65_536, 20_000, 1_000_000
#: One set of so many is looked at to tell which lists are long. It decides how lists are cut, not what is found.
LOOK = 64


@dataclass(frozen=True)
class Similarity:
    """A Jaccard threshold as a fraction, so that bounds are exact integers."""

    num: int = 7
    den: int = 10

    def overlap(self, total: np.ndarray) -> np.ndarray:
        """Least overlap of two sets with ``total`` elements together."""
        return -((-self.num * total) // (self.num + self.den))

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """Elements of a set, in global order, of which any partner must hold at least one."""
        return size + ((-self.num * size) // self.den) + 1

    def reach(self, size: np.ndarray) -> np.ndarray:
        """The largest size of a partner."""
        return (size * self.den) // self.num


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: Column) -> Column:
    """Maximal runs of letters or digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hashed(tokens: Column) -> Column:
    """64-bit hashes of tokens, in their order."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(all values as uint64, the row of each) of a column of integer arrays."""
    lengths = np.fromiter((len(x) for x in column), np.int64, len(column))
    values = np.concatenate(list(column)).astype(np.int64).view(np.uint64) if lengths.sum() else np.zeros(0, np.uint64)
    return values, np.repeat(np.arange(len(column)), lengths)


def sketches(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words per row: of 128 bins of distinct values, whether an odd number of values fell in."""
    bit = (mix(values, 99) & np.uint64(127)).astype(np.int64)
    odd = (np.bincount(row * 128 + bit, minlength=rows * 128) & 1).astype(bool).reshape(rows, 128)
    packed = np.packbits(odd, axis=1, bitorder="little").view("<u8")
    return packed[:, 0].copy(), packed[:, 1].copy()


def packed(postings: np.ndarray, buckets: int) -> pd.DataFrame:
    """One binary row per bucket: the postings in order of their lists, field by field, so that the shuffle's compression finds what repeats."""
    target = (mix(postings["key"], 5) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((postings["size"], postings["key"], target))
    postings, target = postings[order], target[order]
    names, starts = np.unique(target, return_index=True)
    ends = np.append(starts[1:], len(target))
    fields = [np.ascontiguousarray(postings[f]) for f in POSTING.names]
    return pd.DataFrame({"bucket": names, "rows": ends - starts, "blob": [b"".join(f[a:b].tobytes() for f in fields) for a, b in zip(starts, ends, strict=True)]})


def unpacked(blobs: list[bytes]) -> np.ndarray:
    """The postings of the blobs of a bucket."""
    parts = []
    for blob in blobs:
        n, at = len(blob) // POSTING.itemsize, 0
        part = np.empty(n, POSTING)
        for f in POSTING.names:
            part[f] = np.frombuffer(blob, POSTING[f], n, at)
            at += n * POSTING[f].itemsize
        parts.append(part)
    return np.concatenate(parts)


def split_lists(postings: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Repeat postings of long lists over the pairs of their parts, so that no task joins a whole long list.

    ``parts`` is the number of parts of each posting's list. Part b of n goes to the n lists {b, c}, c = 0..n-1; in a
    list of two different parts only postings of different parts are compared.
    """
    if not len(parts) or parts.max() <= 1:
        return postings
    again = np.repeat(np.arange(len(postings)), parts)
    other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
    out, n = postings[again], parts[again]
    mine = (mix(out["cid"].view(np.uint64), 17) % n.astype(np.uint64)).astype(np.int64)
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    split = n > 1
    out["key"][split] = mix(out["key"][split] + mix((low * 65_536 + high)[split].astype(np.uint64), 3), 4)
    out["block"][split] = np.where(low == high, ANY, mine)[split]
    return out


Allowed = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Which postings of a list lead: every allowed pair has at least one, so the others are never compared with each other.
Lead = Callable[[np.ndarray], np.ndarray]


def _close(a: np.ndarray, b: np.ndarray, sim: Similarity, allowed: Allowed) -> np.ndarray:
    """Which pairs of postings (broadcast against each other) may reach the similarity."""
    total = a["size"].astype(np.int64) + b["size"]
    need = sim.overlap(total)
    apart = np.bitwise_count(a["b0"] ^ b["b0"]).astype(np.int64) + np.bitwise_count(a["b1"] ^ b["b1"])
    left = np.minimum(a["size"].astype(np.int64) - a["low"], b["size"].astype(np.int64) - b["low"])
    return (apart <= total - 2 * need) & (left >= need) & (a["cid"] != b["cid"]) & ((a["block"] != b["block"]) | (a["block"] == ANY)) & allowed(a, b)


def _by_size(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["b1"], rows["b0"], rows["size"]))]


def _block(block: np.ndarray, cols: np.ndarray, sim: Similarity, allowed: Allowed, first: int | None) -> np.ndarray:
    """Pairs of a block of rows, sorted by size, with columns; with ``first`` only columns behind a row count, column 0 being row ``first``.

    Columns are skipped in whole when their positions leave too few elements, and when the block's first set already
    tells that they are too far: a set at distance r from it can only be close to columns within r more bits.
    """
    least, most = int(block["size"][0]), int(block["size"][-1])
    size = cols["size"].astype(np.int64)
    keep = size - cols["low"] >= sim.overlap(least + size)
    top = most + size
    limit = top - 2 * sim.overlap(top) + 2
    lead = np.bitwise_count(block["b0"][0] ^ cols["b0"]).astype(np.int64) + np.bitwise_count(block["b1"][0] ^ cols["b1"])
    radius = int((np.bitwise_count(block["b0"][0] ^ block["b0"]).astype(np.int64) + np.bitwise_count(block["b1"][0] ^ block["b1"])).max())
    keep &= lead <= limit + radius
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    cols = cols[at]
    apart = np.bitwise_count(block["b0"][:, None] ^ cols["b0"][None, :])
    apart += np.bitwise_count(block["b1"][:, None] ^ cols["b1"][None, :])
    i, j = np.nonzero(apart <= np.minimum(limit[at], 255).astype(np.uint8)[None, :])
    if first is not None:
        behind = at[j] + first > i
        i, j = i[behind], j[behind]
    good = _close(block[i], cols[j], sim, allowed)
    return np.stack([block["cid"][i[good]], cols["cid"][j[good]]], axis=1)


def _long(rows: np.ndarray, sim: Similarity, allowed: Allowed, lead: Lead) -> Iterator[np.ndarray]:
    """Pairs of one long list: blocks of leading rows against the stretch of columns that size allows."""
    leading = lead(rows)
    heads, rest = _by_size(rows[leading]), _by_size(rows[~leading])
    for cols, within in ((heads, True), (rest, False)):
        size = cols["size"].astype(np.int64)
        own = heads["size"].astype(np.int64)
        at = 0
        while at < len(heads) and len(cols):
            begin = at + 1 if within else int(np.searchsorted(size, -(-sim.num * own[at] // sim.den)))
            stop = int(np.searchsorted(size, sim.reach(own[at]), "right"))
            step = max(1, min(256, CELLS // max(1, stop - begin), len(heads) - at))
            stop = int(np.searchsorted(size, sim.reach(own[at + step - 1]), "right"))
            if stop > begin:
                yield _block(heads[at : at + step], cols[begin:stop], sim, allowed, 1 if within else None)
            at += step


def joined(postings: np.ndarray, sim: Similarity, allowed: Allowed, lead: Lead) -> np.ndarray:
    """Distinct candidate pairs (smaller cid, larger cid) of a bucket of whole lists."""
    order = np.lexsort((postings["size"], postings["key"], postings["kind"]))
    postings = postings[order]
    same = (postings["key"][1:] == postings["key"][:-1]) & (postings["kind"][1:] == postings["kind"][:-1])
    starts = np.flatnonzero(np.append(True, ~same))
    lengths = np.diff(np.append(starts, len(postings)))
    out = [np.zeros((0, 2), np.int64)]
    short = np.repeat((lengths > 1) & (lengths <= SHORT), lengths)
    few = postings[short]
    groups = np.repeat(np.arange(len(lengths)), lengths)[short]
    here = np.arange(len(few))
    for d in range(1, SHORT):
        here = here[here + d < len(few)]
        here = here[groups[here] == groups[here + d]]
        if not len(here):
            break
        for part in np.array_split(here, max(1, len(here) // CELLS)):
            a, b = few[part], few[part + d]
            good = _close(a, b, sim, allowed)
            out.append(np.stack([a["cid"][good], b["cid"][good]], axis=1))
    for k in np.flatnonzero(lengths > SHORT):
        out += list(_long(postings[starts[k] : starts[k] + lengths[k]], sim, allowed, lead))
        if sum(map(len, out)) > 4 * CELLS:
            out = [_distinct(np.concatenate(out))]
    return _distinct(np.concatenate(out))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = np.stack([pairs.min(axis=1), pairs.max(axis=1)], axis=1) if len(pairs) else pairs
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))] if len(pairs) else pairs


def long_lists(sets: DataFrame, emit: Callable[[pd.DataFrame], np.ndarray], rows: int, by: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, parts) of the lists that are longer than a part, as told by the sets whose hash of ``by`` is divisible by LOOK. A list is at most as long as there are sets."""
    if rows <= LIST_POSTINGS:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = emit(b)
                key, n = np.unique(out["key"][out["block"] == ANY], return_counts=True)
                yield pd.DataFrame({"k": key.view(np.int64), "n": n})

    some = sets.where(F.pmod(F.xxhash64(F.lit("look"), by), F.lit(LOOK)) == 0)
    found = some.mapInPandas(keys, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") * LOOK > LIST_POSTINGS).orderBy(F.desc("n")).limit(MOST_LISTS).collect()
    key, n = np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[1] for r in found], np.int64)
    order = np.argsort(key)
    return key[order], -(-n[order] * LOOK // LIST_POSTINGS)


def cut_long(postings: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The postings, those of long lists repeated over the pairs of the list's parts."""
    keys, parts = lists
    if not len(keys) or not len(postings):
        return postings
    at = np.minimum(np.searchsorted(keys, postings["key"]), len(keys) - 1)
    return split_lists(postings, np.where((keys[at] == postings["key"]) & (postings["block"] == ANY), parts[at], 1))


def candidates(sets: DataFrame, emit: Callable[[pd.DataFrame], np.ndarray], rows: int, postings: float, by: str, sim: Similarity, allowed: Allowed, lead: Lead) -> DataFrame:
    """(a, b): distinct candidate pairs of the sets whose postings meet in a list.

    The number of buckets follows that of the postings, and tasks that of the buckets, so neither grows with the data.
    """
    spark = sets.sparkSession
    buckets = int(postings / BUCKET_POSTINGS) + spark.sparkContext.defaultParallelism
    lists = spark.sparkContext.broadcast(long_lists(sets, emit, rows, by))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield packed(cut_long(emit(b), lists.value), buckets)

    def read(group: pd.DataFrame) -> pd.DataFrame:
        pairs = joined(unpacked(list(group["blob"])), sim, allowed, lead)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    blobs = sets.mapInPandas(write, "bucket int, rows long, blob binary")
    # A task per bucket; of more buckets than tasks several meet in one, one after the other.
    spread = blobs.repartitionById(buckets, "bucket") if buckets <= MOST_TASKS else blobs.repartition(MOST_TASKS, "bucket")
    return spread.groupBy("bucket").applyInPandas(read, "a long, b long").distinct()
