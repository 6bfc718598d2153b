"""Garbled text from wrong character encodings (problem 10): noisy-channel decoding.

The channel: text was encoded in one way and read in another, perhaps twice, or bytes were lost and stand as U+FFFD. The
language model is the corpus itself: counts of its words with letters beyond ASCII over all documents, backed by counts
of neighbouring characters. Runs that look like the image of a channel do not count as language, copies of a text count
once, and no source outweighs all others together, so damage does not become usual by being frequent, and a corpus that
is repeated is the same corpus. For each stretch of such characters the byte lattice of every reading is searched by a
Viterbi pass, in which a character stays as it is or a valid byte sequence becomes the character it stands for; lost
bytes are wildcards of the lattice, and of the likeliest paths the commonest corpus word is taken. A stretch is damaged if the best restored form is far likelier than what
is written, and not merely quoted: a sign by itself next to words that speak of signs, letters or printing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Encodings that UTF-8 bytes may have been read in (fixed list).
READINGS = ("cp1252", "latin1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "cp852", "iso8859_2", "iso8859_5", "iso8859_15", "cp1253", "cp1254")
#: (read as, written in) for single-byte text (fixed list).
SWAPS = tuple((a, b) for a, b in (
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("cp1252", "cp1251"),
    ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp1254"), ("cp1253", "cp1252"),
    ("cp852", "cp1250"), ("cp437", "cp1250"), ("cp850", "cp1250"), ("cp1252", "iso8859_2"), ("mac_roman", "cp1250"), ("cp1252", "shift_jis"), ("cp1252", "cp932"), ("latin1", "cp932"), ("latin1", "euc_jp"), ("latin1", "cp1251"), ("latin1", "koi8_r"),
))
LOST = "�"
#: Least rates of what the model that is broadcast knows: shares of all words, character pairs and signs with the word
#: before them, and so 500,000, 500,000 and 50,000 entries at most, of a corpus of any size. What is rarer counts as unseen.
WORD_RATE, PAIR_RATE, CONTEXT_RATE = 2e-6, 2e-6, 2e-5
#: Least rates at which a word, and a sign behind a word, is so usual that a swapped table may be read as it.
KNOWN_RATE, USUAL_RATE = 1.2e-4, 3.8e-4
#: Rates of fewer occurrences than these are not told from chance: to be in the model, to be known, to be usual.
LEAST, LEAST_KNOWN, LEAST_USUAL = 3, 20, 5
#: Rates that an unseen pair, and an unseen first character, count as.
UNSEEN_PAIR, UNSEEN_FIRST = 2e-8, 7.5e-5
#: Groups that sources are put into by hash, of which the largest gives no more to a count than all others together.
SOURCES = 256
#: Paths that are kept at every place of a lattice with wildcards.
BEAM = 200
#: Log-likelihood gain from which a restored form is believed: for byte sequences, for swapped single-byte tables.
GAIN, SWAP_GAIN = 1.0, 4.0

#: A stretch of letters and characters beyond ASCII with at least one of the latter; only its beginning is tried.
_RUN = re.compile(r"(?<![A-Za-z\u0080-\U0010ffff])[A-Za-z]*+[\u0080-\U0010ffff][A-Za-z\u0080-\U0010ffff]*")
_CUES = frozenset("sign signs letter letters character characters symbol symbols glyph apostrophe accent umlaut instead belongs mojibake garbled encoding".split())
#: Verbs that make a sign behind them a quotation.
_SHOWS = frozenset("show shows showed displays reads prints writes".split())
_ASCII = re.compile(r"[A-Za-z]+")
#: Runs up to this length are signs rather than words.
SIGN = 2


def before(text: str, at: int) -> str:
    """The last ASCII word in the 20 characters before a position, in lower case; empty if there is none."""
    words = _ASCII.findall(text[max(0, at - 20) : at])
    return words[-1].lower() if words else ""


@lru_cache(maxsize=None)
def byte_table(name: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding from 0x80 up; bytes it leaves open are read as control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


_HIGH = re.compile(r"[\u0080-\U0010ffff]+")
#: What garbled bytes usually stand for: letters of living scripts, punctuation, signs, emoji.
_LIKELY = re.compile(r"[\u00a0-\u017f\u0192\u0218-\u021b\u02c6\u02dc\u0386-\u03ce\u0400-\u045f\u0490\u0491\u05d0-\u05ea\u0600-\u06ff\u0e01-\u0e5b\u1e00-\u1eff\u2010-\u2044\u20ac\u2116\u2122\u2190-\u22ff\u2500-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\ufe0f\uff00-\uffef\U0001f300-\U0001faff]+")
_WIDE = re.compile(r"[\u3000-\u9fff\uac00-\ud7a3\uff00-\uffef]+")
#: Signs that stand between the letters of clean words.
_INNER = frozenset("’‘ʼ·‐‑–—…•→←×°«»“”„€™®©§\u00a0\u00ad\u200b\u200c\u200d")


def _odd(run: str) -> int:
    """Breaks inside a word that clean text does not have: signs between letters, a change of script, a capital after a small letter."""
    n = 0
    for i in range(1, len(run)):
        a, b = run[i - 1], run[i]
        if a.isalpha() and b.isalpha():
            n += _alphabet(a) != _alphabet(b) or (a.islower() and b.isupper() and b >= "\x80")
        elif not b.isalpha() and b >= "\x80" and b not in _INNER and not unicodedata.combining(b):
            n += a.isalpha() and i + 1 < len(run) and run[i + 1].isalpha()
    return n


def _alphabet(c: str) -> int:
    return 1 if "\u0370" <= c < "\u0400" else 2 if "\u0400" <= c < "\u0530" else 0 if c < "\u0250" else 3


@lru_cache(maxsize=200_000)
def image(run: str) -> bool:
    """Whether a run looks like the image of a channel, however frequent it is.

    It does if a stretch of its characters beyond ASCII spells, from end to end, valid byte sequences of likely
    characters (of ideographs at least two), or if a swapped table turns a word with breaks into one without.
    """
    for m in _HIGH.finditer(run):
        part = m.group()
        for e in READINGS if len(part) > 1 else ():
            table = byte_table(e)
            if not 0xC2 <= table.get(part[0], 0) <= 0xF4:
                continue
            try:
                back = bytes(table.get(c, 0) for c in part).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if _LIKELY.fullmatch(back) and (len(back) > 1 or not _WIDE.fullmatch(back)):
                return True
    if len(run) > SIGN and (breaks := _odd(run)):
        for read, true in SWAPS:
            try:
                back = run.encode(read).decode(true)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if back != run and back.isalpha() and not _odd(back) and (breaks > 1 or len(back) > 3):
                return True
    return False


class Model:
    """Word and character-pair counts of the corpus; ``totals`` are those of all words, pairs and contexts, the rare ones included."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], contexts: dict[str, int] | None = None, totals: tuple[int, int, int] | None = None) -> None:
        self.words, self.pairs, self.contexts = words, pairs, contexts or {}
        of_words, self.of_pairs, of_contexts = totals or (sum(words.values()), sum(pairs.values()), sum(self.contexts.values()))
        self.total = math.log(of_words + 1)
        self.known, self.usual = max(LEAST_KNOWN, KNOWN_RATE * of_words), max(LEAST_USUAL, USUAL_RATE * of_contexts)
        self.after: Counter = Counter()
        self.followers: dict[str, list[str]] = defaultdict(list)
        for p, n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            self.after[p[0]] += n
            if p[1] >= "\x80" and p[1] != LOST:
                self.followers[p[0]].append(p[1])
        self.letters = sorted({c for cs in self.followers.values() for c in cs})
        self.known_pairs: dict[str, float] = {}

    def pair(self, a: str, b: str) -> float:
        if a < "\x80" and b < "\x80":
            return -3.0
        p = a + b
        if p not in self.known_pairs:
            if len(self.known_pairs) > 500_000:
                self.known_pairs.clear()
            n = self.of_pairs or 1
            self.known_pairs[p] = math.log((self.pairs.get(p, 0) / n + UNSEEN_PAIR) / (self.after.get(a, 0) / n + UNSEEN_FIRST))
        return self.known_pairs[p]

    def score(self, run: str) -> float:
        """Log-likelihood of a run: as a known word or, if likelier, character by character."""
        known = self.words.get(run)
        chars = sum(self.pair(a, b) for a, b in zip(" " + run, run + " ", strict=True)) - 6.0
        return max(math.log(known) - self.total, chars) if known else chars


def _sequences(run: str, table: dict[str, int]) -> dict[int, tuple[int, str]]:
    """Position -> (length, character) of every valid multi-byte UTF-8 sequence that the run spells under a table."""
    out = {}
    for i, c in enumerate(run):
        b = table.get(c, 0)
        n = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if n and i + n <= len(run):
            rest = [table.get(x, 0) for x in run[i + 1 : i + n]]
            if all(0x80 <= x <= 0xBF for x in rest):
                try:
                    out[i] = (n, bytes([b, *rest]).decode("utf-8"))
                except UnicodeDecodeError:
                    pass
    return out


def viterbi(run: str, table: dict[str, int], model: Model) -> str | None:
    """The likeliest reading of a run: each position keeps its character or takes a byte sequence; None if there is no sequence."""
    steps = _sequences(run, table)
    if not steps:
        return None
    best: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(run) + 1)]
    best[0][" "] = (0.0, "")
    for i in range(len(run)):
        moves = [(1, run[i], 0.0)]
        if i in steps:
            moves.append((*steps[i], 0.5))
        for last, (score, text) in best[i].items():
            for n, c, bonus in moves:
                new = score + model.pair(last, c) + bonus
                if new > best[i + n].get(c, (-math.inf, ""))[0]:
                    best[i + n][c] = (new, text + c)
    return max(best[-1].values())[1]


def straight(run: str, table: dict[str, int]) -> str | None:
    """The reading that takes every byte sequence, left to right; None if there is none."""
    steps, out, i = _sequences(run, table), [], 0
    while i < len(run):
        n, c = steps.get(i, (1, run[i]))
        out.append(c)
        i += n
    return "".join(out) if steps else None


class Decoder:
    """Restores runs under a model; what it finds for a run is remembered, since words repeat."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.tables = {e: byte_table(e) for e in READINGS}
        self.leads = {e: frozenset(c for c, b in t.items() if 0xC2 <= b <= 0xF4) for e, t in self.tables.items()}
        self.seen: dict[str, list[tuple[float, str, str, bool]]] = {}

    def options(self, run: str, before: str = "") -> list[tuple[float, str, str, bool]]:
        """(gain, channel, restored, sure) of the readings that make a run likelier, best first. Signs are judged by the word before them."""
        key = f"{before} {run}" if len(run) <= SIGN else run
        if key not in self.seen:
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[key] = self._options(run, before)
        return self.seen[key]

    def _options(self, run: str, before: str) -> list[tuple[float, str, str, bool]]:
        chars, base, out = set(run), self.model.score(run), []
        for e in READINGS:
            if chars.isdisjoint(self.leads[e]):
                continue
            reached, edge = set(), {run}
            for _ in range(3):  # text may have been read wrongly more than once
                edge = {x for now in edge for x in (viterbi(now, self.tables[e], self.model), straight(now, self.tables[e])) if x} - reached - {run}
                reached |= edge
            gain, best = max(((self.model.score(x) - base, x) for x in reached), default=(0.0, ""))
            if gain > GAIN:
                out.append((gain, e, best, True))
        for read, true in SWAPS:
            try:
                back = run.encode(read).decode(true)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            known, here = self.model.words.get(back, 0), self.model.words.get(run, 0)
            gain = self.model.score(back) - base
            if back == run or known < self.model.known or known < 5 * here or gain <= 0:
                continue
            if len(run) > SIGN:
                sure = known > 30 * here and gain > SWAP_GAIN
            else:  # the restored sign must be usual behind this very word, and the written one must not
                usual, odd = self.model.contexts.get(f"{before} {back}", 0), self.model.contexts.get(f"{before} {run}", 0)
                sure = bool(before) and usual >= self.model.usual and usual > 30 * odd and known > 30 * here
            out.append((gain, f"{read}<{true}", back, sure))
        return sorted(out, key=lambda o: -o[0])  # of equal gains the reading listed first

    def fill(self, run: str) -> str | None:
        """The commonest corpus word among the likeliest paths of the run's lattice; None if there is none.

        A stretch of lost bytes is a wildcard of one character beyond ASCII to as many as it has marks; what stands
        between the wildcards is kept. Paths are scored by the neighbouring characters of the corpus.
        """
        pair, paths = self.model.pair, {"": 0.0}
        for part in re.findall(f"{LOST}+|[^{LOST}]+", run):
            if part[0] != LOST:
                step = sum(pair(a, b) for a, b in zip(part, part[1:], strict=False))
                paths = {t + part: x + step + pair(t[-1:] or " ", part[0]) for t, x in paths.items()}
                continue
            done, edge = {}, paths
            for _ in part:
                more = {t + c: x + pair(t[-1:] or " ", c) for t, x in edge.items() for c in (self.model.followers.get(t[-1:] or " ") or self.model.letters)}
                edge = dict(sorted(more.items(), key=lambda o: (-o[1], o[0]))[:BEAM])
                done |= edge
            paths = done
        known = [(self.model.words[t], x, t) for t, x in paths.items() if t in self.model.words]
        return max(known)[2] if known else None

    def restore(self, text: str) -> tuple[str, int, int, str | None]:
        """(restored text, damaged runs, runs that could not be restored, channel). A clean text comes back as it is."""
        found, doubtful, channels = [], [], Counter()
        for m in _RUN.finditer(text):
            run = m.group()
            lost = LOST in run
            options = [] if lost else self.options(run, before(text, m.start()) if len(run) <= SIGN else "")
            if (lost or options) and not self._quoted(text, m.start(), m.end(), run if lost else options[0][2]):
                sure = [o for o in options if o[3]]
                (found if lost or sure else doubtful).append((m, run, lost, sure or options))
                for e in dict.fromkeys(o[1] for o in sure):
                    channels[e] += max(o[0] for o in sure if o[1] == e)
        if not found:
            return text, 0, 0, None
        top = max(channels, key=lambda e: round(channels[e], 6)) if channels else "lost"
        # What is doubtful by itself is believed in the channel that the rest of the text has gone through.
        found += [(m, run, False, same) for m, run, _, options in doubtful if (same := [o for o in options if o[1] == top])]
        out, at, open_ = [], 0, 0
        for m, run, lost, options in sorted(found, key=lambda f: f[0].start()):
            if lost:
                new = self.fill(run)
                open_ += new is None
            else:
                new = max(options, key=lambda o: o[0] + (0.5 if o[1] == top else 0.0))[2]
            out += [text[at : m.start()], run if new is None else new]
            at = m.end()
        return "".join([*out, text[at:]]), len(found), open_, top

    @staticmethod
    def _quoted(text: str, a: int, b: int, restored: str) -> bool:
        """Whether a short sign without a word around it stands among words that speak of signs."""
        if len(_ASCII.sub("", restored)) > 4 or _ASCII.search(restored):
            return False
        near = _ASCII.findall(text[max(0, a - 40) : a].lower())[-5:] + _ASCII.findall(text[b : b + 60].lower())[:6]
        before = _ASCII.findall(text[max(0, a - 20) : a].lower())[-1:]
        return not _CUES.isdisjoint(near) or not _SHOWS.isdisjoint(before)


def fit(documents: DataFrame, text: str = "text", source: str = "source") -> Model:
    """Count words and character pairs beyond ASCII over all documents and keep what has at least the rates above.

    Images of a channel are left out, a text counts once however often it stands there, and of each count the largest
    of SOURCES groups of sources gives no more than all others together (if there are several groups). Pairs of two ASCII characters
    are left out; of signs the word before them is counted as well.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            runs: Counter = Counter()
            for t, s in zip(b["text"], b["source"], strict=True):
                for m in _RUN.finditer(t):
                    r = m.group()
                    runs[r, s] += 1
                    if len(r) <= SIGN and not image(r):
                        counts["s", f"{before(t, m.start())} {r}", s] += 1
            for (r, s), n in runs.items():
                if image(r):
                    continue
                counts["w", r, s] += n
                for i in range(len(r) + 1):
                    p = (r[i - 1] if i else " ") + (r[i] if i < len(r) else " ")
                    if p[0] >= "\x80" or p[1] >= "\x80":
                        counts["p", p, s] += n
            if len(counts) > 200_000:
                yield rows_of(counts)
                counts.clear()
        if counts:
            yield rows_of(counts)

    def rows_of(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "item", "source", "n"])

    named = F.pmod(F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit(""))), F.lit(SOURCES)).cast("string") if source in documents.columns else F.lit("")
    texts = documents.select(F.col(text).alias("text"), named.alias("source")).where(F.col(text).isNotNull() & F.col(text).rlike(r"[^\x00-\x7f]"))
    once = texts.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), F.reverse("text")).alias("lo")).agg(F.min("text").alias("text"), F.min("source").alias("source"))
    rows = once.select("text", "source").mapInPandas(count, "kind string, item string, source string, n long")
    parts = rows.groupBy("kind", "item", "source").agg(F.sum("n").alias("n")).groupBy("kind", "item").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    parts = written(parts, "counts")  # the documents are counted once
    of = {r[0]: int(r[1]) for r in parts.groupBy("kind").agg(F.sum("n")).collect()}
    several = texts.select("source").distinct().limit(2).count() > 1

    def kept(kind: str, rate: float, least: int) -> dict[str, int]:
        floor = max(least, rate * of.get(kind, 0))
        rest = F.col("n") - F.col("top")
        n = rest + F.least("top", F.greatest(rest, F.ceil(F.lit(floor)))) if several else F.col("n")
        return {r[0]: int(r[1]) for r in parts.where(F.col("kind") == kind).select("item", n.alias("n")).where(F.col("n") >= floor).collect()}

    return Model(kept("w", WORD_RATE, LEAST), kept("p", PAIR_RATE, 1), kept("s", CONTEXT_RATE, LEAST), tuple(of.get(k, 0) for k in "wps"))


def repaired(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, restored, damaged_runs, open_runs, channel) of the damaged documents.

    ``restored`` is the whole text with every restorable run replaced; ``open_runs`` counts runs whose lost bytes no
    corpus word explains. Null and clean texts give no row; nothing is shuffled.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = documents.schema[doc_id].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(shared.value)
        for b in batches:
            done = [(d, *decoder.restore(t)) for d, t in zip(b["id"], b["text"], strict=True)]
            out = [(d, r if keep_text else None, n, o, c) for d, r, n, o, c in done if n]
            yield pd.DataFrame(out, columns=[doc_id, "restored", "damaged_runs", "open_runs", "channel"])

    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col(text).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).rlike(r"[^\x00-\x7f]"))
    return rows.mapInPandas(work, f"{doc_id} {kind}, restored string, damaged_runs long, open_runs long, channel string")
