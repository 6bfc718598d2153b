import random

from pyspark.sql import functions as F

from tallyloom.plans import components, connected_components, ranked, salted_join, skew
from tallyloom.plans.ranking import unit_hash


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {(x, find(x)) for x in root}


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(60):03d}", f"n{rnd.randrange(60):03d}") for _ in range(40)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]  # a long chain
    edges += [("hub", f"s{i:03d}") for i in range(200)]  # a star
    edges += [(None, "n001"), ("n001", None), ("x", "x")]
    df = spark.createDataFrame(edges, "p string, q string")
    got = {tuple(r) for r in connected_components(df, "p", "q").collect()}
    assert got == brute(edges)


def test_components_with_hot_nodes(spark, monkeypatch):
    """Hubs above and below their neighbours go through the broadcast half of the joins."""
    monkeypatch.setattr(components, "SMALL", 10)
    monkeypatch.setattr(skew, "SMALL", 10)
    edges = [("hub", f"s{i:03d}") for i in range(150)] + [("zhub", f"s{i:03d}") for i in range(120, 300)] + [(f"q{i}", f"q{i + 1}") for i in range(30)] + [(None, "hub")]
    assert {tuple(r) for r in connected_components(spark.createDataFrame(edges, "p string, q string"), "p", "q").collect()} == brute(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_ranks_are_exact_and_layout_free(spark):
    rows = [("hot", f"id{i}") for i in range(500)] + [("cold", "z"), (None, "n1"), (None, "n2")]
    df = spark.createDataFrame(rows, "k string, id string").withColumn("u", unit_hash("id", seed="s"))
    got = [{(r["k"], r["id"]): r["rank"] for r in ranked(df.repartition(n), ["k"], "u", "id", buckets=16).collect()} for n in (1, 7)]
    assert got[0] == got[1]
    assert sorted(v for (k, _), v in got[0].items() if k == "hot") == list(range(500))
    assert sorted(v for (k, _), v in got[0].items() if k is None) == [0, 1]
    order = [r["id"] for r in df.where("k = 'hot'").orderBy("u", "id").collect()]
    assert [got[0][("hot", i)] for i in order] == list(range(500))


def test_weighted_ranks_are_running_sums(spark):
    df = spark.range(400).select(F.lit("k").alias("k"), F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("w")).withColumn("u", unit_hash("id"))
    rows = ranked(df.repartition(5), ["k"], "u", "id", "start", buckets=8, weight="w").orderBy("u", "id").collect()
    assert [r["start"] for r in rows] == [sum(x["w"] for x in rows[:i]) for i in range(len(rows))]


def test_star_join_keeps_every_row(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), ("none", 2), (None, 3)], "k string, v long")
    right = spark.createDataFrame([("h", "x"), ("c", "y"), (None, "z")], "k string, w string")
    for how in ("inner", "left"):
        got = [sorted(map(str, skew.star_join(left, right, "k", hot, how).collect())) for hot in ([], ["h"])]
        assert got[0] == got[1] and len(got[0]) == (51 if how == "inner" else 53)


def test_salted_join_keeps_every_pair(spark):
    left = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(1, "a"), (4, "b"), (4, "c")], "k long, w string")
    assert salted_join(left, right, "k").count() == 40_000 + 1 + 2
    assert salted_join(left, right, "k", "left").count() == 120_001
