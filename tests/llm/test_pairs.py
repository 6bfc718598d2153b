import random
import re

import numpy as np
import pytest

from tallyloom.llm import neardup, overlap
from tallyloom.llm import postings as P

WORD = re.compile(r"[^\W_]+")


def alike(a, b):
    s, t = set(WORD.findall((a or "").lower())), set(WORD.findall((b or "").lower()))
    return bool(s and t) and len(s & t) * 10 >= 7 * len(s | t)


def corpus(seed, n, vocab=300, hot=12, size=(1, 40)):
    """Texts of few frequent and many rare words, with edited copies, exact copies and empty ones."""
    rnd = random.Random(seed)
    word = lambda: f"h{rnd.randrange(hot)}" if rnd.random() < 0.6 else f"v{rnd.randrange(vocab)}"
    out = []
    for i in range(n):
        if out and rnd.random() < 0.45:
            w = WORD.findall(rnd.choice(out)[1] or "") or ["x"]
            for _ in range(rnd.randrange(0, 4)):
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice([[], [word()], [w[k], word()]])
                w = w or ["x"]
            if rnd.random() < 0.3:
                rnd.shuffle(w)
        else:
            w = [word() for _ in range(rnd.randrange(*size))]
        out.append((f"r{i:04d}", rnd.choice([" ", ", ", "\n"]).join(w)))
    return out + [("null", None), ("blank", "  "), ("marks", "!!"), (None, out[0][1]), out[1], out[2]]


def brute(rows):
    t = {i: x for i, x in rows if i is not None}
    ids = sorted(t)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(t[a], t[b])}


@pytest.mark.parametrize("seed,frequent", [(1, 2), (2, 8), (3, 1_000), (4, 1)])
def test_join_loses_no_pair(spark, monkeypatch, seed, frequent):
    """Thresholds are lowered so that small data goes through all three kinds of lists, and long ones are split."""
    monkeypatch.setattr(neardup, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(neardup, "TOP_FREQUENT", frequent)
    monkeypatch.setattr(P, "LIST_POSTINGS", 40)
    monkeypatch.setattr(P, "LOOK", 2)
    monkeypatch.setattr(P, "BUCKET_POSTINGS", 500)
    monkeypatch.setattr(P, "SHORT", 6)
    rows = corpus(seed, 220)
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "record_id string, text string, toks int")
    members, sets = neardup.classes(df, "record_id", "text")
    similar = neardup.similar_classes(sets)
    assert {tuple(r) for r in neardup.record_pairs(members, similar).collect()} == brute(rows)


def test_groups_and_copies(spark):
    rows = [("a", "one two three four"), ("b", "Four three two ONE"), ("c", "one two three four five"), ("d", "six seven"), ("e", None), ("f", "one two three four five zero nine")]
    members, sets = neardup.classes(spark.createDataFrame(rows, "record_id string, text string"), "record_id", "text")
    got = {r["record_id"]: tuple(r)[1:] for r in neardup.linked_classes(members, neardup.similar_classes(sets)).collect()}
    assert got == {"a": ("a", 2, 1), "b": ("a", 2, 1), "c": ("a", 1, 2), "f": ("a", 1, 1)}


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "record_id string, text string")
    members, sets = neardup.classes(df, "record_id", "text")
    similar = neardup.similar_classes(sets)
    assert neardup.record_pairs(members, similar).count() == 0 and neardup.linked_classes(members, similar).count() == 0
    m, s = overlap.classes(overlap.texts(df, "record_id", "text", 1))
    assert overlap.record_overlaps(m, overlap.similar_texts(s)).count() == 0


def test_bounds_of_the_similarity():
    s = P.Similarity()
    for a in range(1, 60):
        for b in range(a, 60):
            need = next((o for o in range(a + 1) if o * 10 >= 7 * (a + b - o)), None)
            if need is not None:
                assert need == s.overlap(np.array([a + b]))[0] and b <= s.reach(np.array([a]))[0] and a - need < s.prefix(np.array([a]))[0] and b - need < s.prefix(np.array([b]))[0]


def test_sketches_never_overstate():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rnd.integers(0, 200, rnd.integers(1, 120)).astype(np.uint64)) for _ in "ab")
        x, y = P.sketches(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert np.bitwise_count(x[0] ^ x[1]) + np.bitwise_count(y[0] ^ y[1]) <= len(np.setxor1d(a, b))


def test_postings_survive_packing():
    rnd = np.random.default_rng(3)
    rows = np.frombuffer(rnd.bytes(500 * P.POSTING.itemsize), P.POSTING).copy()
    boxes = P.packed(rows, 7)
    back = np.concatenate([P.unpacked([b]) for b in boxes["blob"]])
    assert sorted(back.tolist()) == sorted(rows.tolist()) and boxes["rows"].sum() == 500 and len(P.unpacked(list(boxes["blob"]))) == 500


def test_winnowing_finds_shared_passages():
    rnd = np.random.default_rng(2)
    passage = rnd.integers(0, 1 << 60, overlap.GRAM + overlap.WINDOW - 1).astype(np.uint64)
    for _ in range(20):
        a, b = (np.concatenate([rnd.integers(0, 1 << 60, k).astype(np.uint64), passage, rnd.integers(0, 1 << 60, 7).astype(np.uint64)]) for k in rnd.integers(0, 30, 2))
        keys, row = overlap.fingerprints(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert set(keys[row == 0]) & set(keys[row == 1])
    keys, row = overlap.fingerprints(np.array([1, 2, 1, 2], np.uint64), np.array([0, 0, 2, 2]), 3)
    assert list(row) == [0, 2] and keys[0] == keys[1]


def test_overlaps_match_brute_force(spark):
    rnd = random.Random(7)
    train = [(f"t{i}", " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(20, 60)))) for i in range(60)]
    held = []
    for i in range(40):
        w = rnd.choice(train)[1].split()
        w[rnd.randrange(len(w))] = "edit"
        held.append((f"h{i}", ". ".join(w).upper()))
    held += [("t5", train[5][1]), ("h0", held[0][1]), ("n", None), ("b", " ")]
    both = overlap.texts(spark.createDataFrame(held, "i string, x string"), "i", "x", 1).unionByName(overlap.texts(spark.createDataFrame(train, "i string, x string"), "i", "x", 2))
    members, sets = overlap.classes(both)
    rows = overlap.record_overlaps(members, overlap.similar_texts(sets)).collect()
    assert {(r["held_id"], r["train_id"]) for r in rows} == {(a, b) for a, x in held for b, y in train if a != b and alike(x, y)}
    assert all(0 < r["held_coverage"] <= 1 and r["likeness"] >= 0.7 for r in rows)
    told = {(r["record_id"], r["side"]): r for r in overlap.linked_records(members, overlap.similar_texts(sets)).collect()}
    assert set(told) == {(r["held_id"], "held_out") for r in rows} | {(r["train_id"], "train") for r in rows} and all(0 < r["coverage"] <= 1 for r in told.values())


def test_alignment():
    a = "the quick brown fox jumps over the lazy dog today while nine small grey cats sleep under an old oak".split()
    assert overlap.aligned(a, a) == (20, 20) and overlap.aligned(a, a[10:] + a[:10]) == (10, 10) and overlap.aligned([], a) == (0, 0)
    assert overlap.aligned(a, a[:9] + ["x"] + a[9:]) == (20, 20) and overlap.aligned(a, a[:9] + a[12:])[1] == 17


def _found_across(spark, held, train):
    both = overlap.texts(spark.createDataFrame(held, "i string, x string"), "i", "x", 1).unionByName(overlap.texts(spark.createDataFrame(train, "i string, x string"), "i", "x", 2))
    members, sets = overlap.classes(both)
    return {(r["held_id"], r["train_id"]) for r in overlap.record_overlaps(members, overlap.similar_texts(sets)).collect()}


@pytest.mark.parametrize("frequent", [4, 60, 1_000])
def test_overlaps_inside_a_hot_family(spark, monkeypatch, frequent):
    """Variants of one text, sentences re-ordered and words inserted: whether a pair is found does not depend on the others."""
    monkeypatch.setattr(neardup, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(neardup, "TOP_FREQUENT", frequent)
    rnd = random.Random(11)
    parts = [[f"s{i}w{j}" for j in range(rnd.randrange(3, 9))] for i in range(8)]

    def variant():
        out = [list(p) for p in parts]
        rnd.shuffle(out)
        for _ in range(rnd.randrange(2, 9)):
            p = rnd.choice(out)
            p.insert(rnd.randrange(len(p) + 1), f"new{rnd.randrange(9)}")
        return ". ".join(" ".join(p) for p in out)

    held, train = [(f"h{i}", variant()) for i in range(40)], [(f"t{i}", variant()) for i in range(90)]
    assert _found_across(spark, held, train) == {(a, b) for a, x in held for b, y in train if alike(x, y)}


def test_hot_class_is_told_without_pairs(spark):
    """A third of the rows in one class, on both sides, and a record that is its own copy across them."""
    held = [(f"h{i}", "one text for all of them") for i in range(60)] + [("x", "alone on both sides here")]
    train = [(f"t{i}", "One text for all of them!") for i in range(70)] + [("x", "alone on both sides here"), ("n", "one text for all of them now")] + [(f"r{i}", f"some other text {i} {i}a {i}b") for i in range(150)]
    both = overlap.texts(spark.createDataFrame(held, "i string, x string"), "i", "x", 1).unionByName(overlap.texts(spark.createDataFrame(train, "i string, x string"), "i", "x", 2))
    members, sets = overlap.classes(both)
    told = {(r["record_id"], r["side"]): (r["same"], r["near"], r["coverage"]) for r in overlap.linked_records(members, overlap.similar_texts(sets)).collect()}
    assert told["h0", "held_out"] == (70, 1, 1.0) and told["t0", "train"] == (60, 0, 1.0) and told["n", "train"][:2] == (0, 1) and len(told) == 131


@pytest.mark.parametrize("changed", [1, 6])
def test_hot_lists_are_cut(spark, monkeypatch, changed):
    """Families of texts of frequent words that agree in whole parts: long equality lists are cut into parts."""
    monkeypatch.setattr(neardup, "LEAST_FREQUENT", 3)
    monkeypatch.setattr(neardup, "TOP_FREQUENT", 3)
    monkeypatch.setattr(P, "LIST_POSTINGS", 15)
    monkeypatch.setattr(P, "LOOK", 1)
    rnd = random.Random(3)
    hot = [f"h{i}" for i in range(60)]
    rows = []
    for family in range(6):
        base = rnd.sample(hot, 24)
        for i in range(40):
            w = list(base)
            for k in rnd.sample(range(24), rnd.randrange(changed + 1)):
                w[k] = rnd.choice(hot)
            rows.append((f"r{family}{i:02d}", " ".join(w + [f"v{rnd.randrange(900)}" for _ in range(rnd.randrange(3))])))
    rows += [(f"s{i}", " ".join(rnd.sample(hot, rnd.randrange(1, 4)))) for i in range(60)]
    members, sets = neardup.classes(spark.createDataFrame(rows, "record_id string, text string"), "record_id", "text")
    order, n, _ = neardup.plan(sets, P.Similarity())
    lists = P.long_lists(sets, lambda b: neardup.emitted(b, order), n, "hi")
    sent = neardup.emitted(sets.select("hi", "toks").toPandas(), order)
    longest = lambda rows: np.unique(rows["key"][rows["kind"] == 1], return_counts=True)[1].max()
    assert order.parts > 1 and lists[1].min() > 1 and longest(P.cut_long(sent, lists)) < 2 * 2 * P.LIST_POSTINGS < 3 * longest(sent)
    assert {tuple(r) for r in neardup.record_pairs(members, neardup.similar_classes(sets)).collect()} == brute(rows)


def test_overlaps_of_short_texts(spark):
    rnd = random.Random(12)
    texts_ = lambda n, mark: [(f"{mark}{i}", " ".join(rnd.sample("a b c d e f g h i j".split(), rnd.randrange(1, 9)))) for i in range(n)]
    held, train = texts_(40, "h"), texts_(60, "t")
    assert _found_across(spark, held, train) == {(a, b) for a, x in held for b, y in train if alike(x, y)}
