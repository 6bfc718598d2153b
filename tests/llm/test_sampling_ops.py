import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing, packing, permanent, quota_sample, splits
from tallyloom.llm.flow import Network, apportion


def test_flow_matches_enumeration():
    rnd = random.Random(1)
    for _ in range(40):
        # transport of 2 x 2 cells with capacities and costs, all integral plans enumerated
        cap = [[rnd.randrange(4) for _ in range(2)] for _ in range(2)]
        cost = [[rnd.randrange(-3, 6) for _ in range(2)] for _ in range(2)]
        out, into = [rnd.randrange(5) for _ in range(2)], [rnd.randrange(5) for _ in range(2)]
        n = Network()
        for i in range(2):
            n.arc("S", ("r", i), out[i])
            n.arc(("c", i), "T", into[i])
        h = {(i, j): n.arc(("r", i), ("c", j), cap[i][j], cost[i][j]) for i in range(2) for j in range(2)}
        sent, total = n.send("S", "T", 99)
        plans = [(a, b, c, d) for a in range(cap[0][0] + 1) for b in range(cap[0][1] + 1) for c in range(cap[1][0] + 1) for d in range(cap[1][1] + 1) if a + b <= out[0] and c + d <= out[1] and a + c <= into[0] and b + d <= into[1]]
        most = max(map(sum, plans))
        assert sent == most and total == min(p[0] * cost[0][0] + p[1] * cost[0][1] + p[2] * cost[1][0] + p[3] * cost[1][1] for p in plans if sum(p) == most)
        assert total == sum(n.flow(x) * cost[i][j] for (i, j), x in h.items())


def test_apportion():
    assert apportion([0.5, 0.25, 0.25], 10) == [5, 3, 2] and apportion([], 3) == []


# Problem 2

TICKET = "record_id string, target struct<issue_category:string,priority:string>"
REQUEST = "request_name string, issue_category string, priority string, target_share double, min_rows long, sample_rows long"


def tickets(spark, rows):
    return spark.createDataFrame([(i, (c, p)) for i, c, p in rows], TICKET)


def test_quotas_follow_targets_floors_and_supply(spark):
    rows = [(f"a{i}", "billing", "low") for i in range(60)] + [(f"b{i}", " Account-Access", "HIGH ") for i in range(30)] + [(f"c{i}", "other", "urgent") for i in range(3)] + [("a0", "billing", "low"), ("n", None, "low"), (None, "billing", "low"), ("z", "nonsense", "low")]
    t = tickets(spark, rows)
    targets = spark.createDataFrame([("r", "billing", "low", 0.5, 1, 40), ("r", "account_access", "high", 0.3, 5, 40), ("r", "other", "urgent", 0.2, 4, 40)], REQUEST)
    plan = quota_sample.plan(t, targets)
    got = {r["issue_category"]: r for r in plan.collect()}
    assert {k: r["available"] for k, r in got.items()} == {"billing": 60, "account_access": 30, "other": 3}
    assert got["other"]["quota"] == 3 and got["other"]["short_of_share"] == 5 and got["other"]["short_of_floor"] == 1
    assert sum(r["quota"] for r in got.values()) == 40 and got["billing"]["quota"] >= 20 and got["account_access"]["quota"] >= 12
    assert [tuple(r) for r in quota_sample.short_cells(plan).collect()] == [("r", "other", "urgent")]
    drawn = [sorted(tuple(r) for r in quota_sample.sample(t.repartition(n), plan).collect()) for n in (1, 5)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == len(set(drawn[0])) == 40


def test_rounding_is_random_fair_and_keeps_margins():
    shares = dict(zip([(i, j) for i in "abc" for j in "xyz"], (0.1607, 0.1259, 0.1915, 0.1435, 0.0293, 0.1491, 0.05, 0.1, 0.05), strict=True))
    drawn = [quota_sample.rounded(shares, 17, str(k)) for k in range(1_500)]
    assert drawn[0] == quota_sample.rounded(shares, 17, "0") and len({str(d) for d in drawn}) > 20
    for d in drawn:
        assert sum(d.values()) == 17 and all(abs(d[c] - shares[c] * 17) < 1 for c in d)
        for axis in (0, 1):
            for label in {c[axis] for c in d}:
                assert abs(sum(n for c, n in d.items() if c[axis] == label) - 17 * sum(x for c, x in shares.items() if c[axis] == label)) < 1
    assert all(abs(sum(d[c] for d in drawn) / len(drawn) - shares[c] * 17) < 0.06 for c in shares)
    assert quota_sample.rounded({("a", "x"): 1 / 3}, 1, "s") in ({("a", "x"): 0}, {("a", "x"): 1}) and quota_sample.rounded({}, 5, "s") == {}


def test_margins_that_give_way_are_told():
    got, rows, cols = quota_sample.quotas({("a", "x"): 0.5, ("b", "y"): 0.5}, {}, {("a", "x"): 10, ("b", "y"): 2}, 10)
    assert got == {("a", "x"): 8, ("b", "y"): 2} and rows == {"a": 3, "b": 0} and cols == {"x": 3, "y": 0}


def test_quota_sample_of_empty_tables(spark):
    t = tickets(spark, [])
    targets = spark.createDataFrame([("r", "billing", "low", 1.0, 2, 5), (None, "billing", "low", 1.0, 1, 1)], REQUEST)
    plan = quota_sample.plan(t, targets)
    assert plan.first()["quota"] == 0 and quota_sample.short_cells(plan).count() == 1 and quota_sample.sample(t, plan).count() == 0
    assert quota_sample.plan(t, targets.limit(0)).count() == 0


# Problem 3

CANON = "record_id string, split string, target struct<issue_category:string>, metadata struct<lineage_root_id:string,parent_record_id:string>"


def canon(spark, rows):
    return spark.createDataFrame([(i, s, ("billing",), (a, b)) for i, s, a, b in rows], CANON)


def test_torn_groups(spark):
    df = canon(spark, [("A", "train", "a ", None), ("B", "eval", " A", None), ("C", "train", "gone", None), ("D", "train", None, "GONE"), ("E", "train", "E", None), ("E", "train", "e", None), ("F", None, None, None), (None, "eval", "a", None)])
    seed = spark.createDataFrame([("e", " Test"), ("F", ""), ("C", "train"), (None, "test")], "record_id string, split string")
    marked = splits.with_seed_marks(splits.related(df), seed)
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.3)], "split_name string, target_share double")
    for lines in (targets, targets.limit(0)):
        rows = splits.assign(marked, lines).collect()
        assert {(r["record_id"], r["group_id"]) for r in rows if r["torn"]} == {("A", "A"), ("B", "A"), ("E", "E")} and len(rows) == 6


def test_split_assignment_keeps_groups_and_shares(spark):
    rows = [(f"g{g}-{i}", "train", f"g{g}-0", None) for g in range(150) for i in range(1 + g % 4)] + [(f"h{i}", "train", "hub", None) for i in range(120)]
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.3), (None, 0.5), ("none", None)], "split_name string, target_share double")
    out = [sorted(tuple(r) for r in splits.assign(splits.related(canon(spark, rows).repartition(n)), targets).collect()) for n in (1, 4)]
    assert out[0] == out[1] and len(out[0]) == len(rows)
    of = {}
    for _, g, s, torn in out[0]:
        assert of.setdefault(g, s) == s and not torn
    share = sum(1 for _, _, s, _ in out[0] if s == "train") / len(rows)
    assert abs(share - 0.7) < 0.02
    report = {r["split_name"]: r for r in splits.shares(splits.assign(splits.related(canon(spark, rows)), targets), targets).collect()}
    assert set(report) == {"train", "test"} and report["train"]["actual_share"] == share and all(r["near_target"] and r["broken_groups"] == 0 for r in report.values())
    assert splits.assign(splits.related(canon(spark, [])), targets).count() == 0


# Problem 5

SRC = "record_id string, source_dataset string, metadata struct<adapter_name:string>"


def test_mix_reaches_shares_or_reports(spark):
    reg = spark.createDataFrame([("a", "fa"), ("b", "fb")], "dataset_name string, adapter_name string")
    rows = [(f"a{i}", "a", ("fa",)) for i in range(10)] + [(f"b{i}", "B!", ("fb",)) for i in range(40)] + [("x", "a", ("fb",)), ("a1", "a", (None,)), ("n", None, (None,)), (None, "a", ("fa",))]
    m = mixing.memberships(spark.createDataFrame(rows, SRC), reg)
    assert m.count() == 51 and m.where("record_id = 'x'").first()["pattern"] == "a;b"
    targets = spark.createDataFrame([("m", "a", 0.5, 2, 60), ("m", "b", 0.5, 1, 60)], "mix_name string, source_dataset string, target_share double, max_repeats int, mix_rows long")
    report, routes, kinds = mixing.plan(m, targets)
    r = {x["source_dataset"]: x for x in report.collect()}
    assert r["a"]["records"] == 11 and r["a"]["short_rows"] == 8 and r["b"]["short_rows"] == 0 and [tuple(x) for x in mixing.short_lines(report).collect()] == [("m", "a")]
    used = mixing.mixed(m, routes, kinds).collect()
    assert sum(u["repeats"] for u in used) == 60 and max(u["repeats"] for u in used if u["source_dataset"] == "a") <= 2 and max(u["repeats"] for u in used if u["source_dataset"] == "b") == 1
    assert sum(u["repeats"] for u in used if u["source_dataset"] == "a") == r["a"]["mixed_rows"]


def test_mix_of_nothing(spark):
    reg = spark.createDataFrame([("a", "fa")], "dataset_name string, adapter_name string")
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 5)], "mix_name string, source_dataset string, target_share double, max_repeats int, mix_rows long")
    m = mixing.memberships(spark.createDataFrame([], SRC), reg)
    report, routes, kinds = mixing.plan(m, targets)
    assert report.first()["short_rows"] == report.first()["lacking_rows"] == 5 and mixing.mixed(m, routes, kinds).count() == 0


TARGETS = "mix_name string, source_dataset string, target_share double, max_repeats int, mix_rows long"


def test_mix_of_records_in_two_sources(spark):
    """Each source uses a shared record as often as its own line allows, and what cannot be had is told."""
    m = spark.createDataFrame([(f"r{i}", "a|b", 1) for i in range(10)], "record_id string, pattern string, size long")
    for rows, got, lacking in ((20, (10, 10), (0, 0)), (40, (30, 10), (0, 10)), (200, (50, 10), (50, 90))):
        report, routes, kinds = mixing.plan(m, spark.createDataFrame([("m", "a", 0.5, 5, rows), ("m", "b", 0.5, 1, rows)], TARGETS))
        r = {x["source_dataset"]: x for x in report.collect()}
        assert tuple(r[s]["mixed_rows"] for s in "ab") == got and tuple(r[s]["lacking_rows"] for s in "ab") == lacking
        assert (r["a"]["short_rows"], r["b"]["short_rows"]) == (max(0, rows // 2 - 50), max(0, rows // 2 - 10))
        used = {s: [u["repeats"] for u in mixing.mixed(m, routes, kinds).collect() if u["source_dataset"] == s] for s in "ab"}
        assert tuple(sum(used[s]) for s in "ab") == got and max(used["a"]) <= 5 and max(used["b"]) == 1


def test_mix_by_tokens(spark):
    reg = spark.createDataFrame([("a", "fa"), ("b", "fb")], "dataset_name string, adapter_name string")
    rows = [(f"{s}{i}", s, (None,), i % 9) for s in "ab" for i in range(200)]
    df = spark.createDataFrame(rows + [rows[5], ("null", "a", (None,), None)], "record_id string, source_dataset string, metadata struct<adapter_name:string>, tokens int")
    m = mixing.memberships(df, reg, F.col("tokens"))
    report, routes, kinds = mixing.plan(m, spark.createDataFrame([("m", "a", 0.75, 3, 2_000), ("m", "b", 0.25, 1, 2_000)], TARGETS))
    size = {r["record_id"]: r["size"] for r in m.collect()}
    got = {s: sum(u["repeats"] * size[u["record_id"]] for u in mixing.mixed(m, routes, kinds).collect() if u["source_dataset"] == s) for s in "ab"}
    assert abs(got["a"] - 1_500) <= 8 and abs(got["b"] - 500) <= 8 and report.where("short_rows > 0").count() == 0


def test_many_patterns_of_few_wanted_sources():
    patterns = {"|".join(sorted({"a", f"x{i}", f"y{i % 50}"})): (1, 2) for i in range(3_000)}
    of = mixing.kinds(patterns, {"a", "b"})
    assert list(of) == ["a"] and of["a"][2:4] == (3_000, 6_000) and mixing.route(of, {"a": (1.0, 1), "b": (0.0, 1)}, 10)[0] == {("a", "a"): 10}
    with pytest.raises(ValueError):
        mixing.kinds({f"s{i}": (1, 1) for i in range(mixing.MOST_KINDS + 1)}, {f"s{i}" for i in range(mixing.MOST_KINDS + 1)})


# The result queries come out of the operators


@pytest.mark.parametrize("module,name,query", [(quota_sample, "shortfalls", "p2_found"), (splits, "allocate", "p3_found"), (mixing, "route", "p5_found")])
def test_results_hang_on_the_flow(spark, monkeypatch, module, name, query):
    from tallyloom.llm import queries

    stubs = {"shortfalls": lambda need, have: dict.fromkeys(need, 0), "allocate": lambda bundles, shares: [], "route": lambda of, lines, rows: ({}, dict.fromkeys(lines, 0), dict.fromkeys(lines, 0))}
    d = "/root/testdata/sf0.001"
    assert queries.queries()[query](spark, d).count() > 0
    monkeypatch.setattr(module, name, stubs[name])
    assert queries.queries()[query](spark, d).count() == 0


# Problem 7


def test_permanent_sample_only_grows(spark, tmp_path):
    reg = permanent.NumberRegistry(spark, str(tmp_path / "r"))
    ids = lambda n: spark.range(n).select(F.concat(F.lit("id"), "id").alias("record_id"))
    rates = lambda x: spark.createDataFrame([("s", x), ("t", 0.5)], "sample_name string, rate double")
    get = lambda n, x, p=3: {tuple(r) for r in permanent.permanent_sample(ids(n).unionByName(ids(5)).repartition(p), "record_id", rates(x), reg).collect()}
    a, b = get(300, 0.2), get(300, 0.2, 7)
    assert a == b
    c = get(900, 0.2)
    assert a <= c and reg.numbers().count() == 900
    assert get(900, 0.05) == c  # a lower rate takes nothing back
    assert c < get(900, 0.4)
    reg.seed = "changed"
    assert get(900, 0.4) == get(900, 0.4) and reg.numbers().count() == 900
    assert permanent.permanent_sample(spark.createDataFrame([(None,)], "record_id string"), "record_id", rates(1.0), permanent.NumberRegistry(spark, str(tmp_path / "e"))).count() == 0


def test_registry_keeps_the_first_number_of_an_id(spark, tmp_path):
    """A batch that another writer adds with the same ids changes nothing, and an unfinished one is written over."""
    reg = permanent.NumberRegistry(spark, str(tmp_path / "r"))
    ids = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "record_id string")
    first = {tuple(r) for r in reg.register(ids, "record_id").collect()}
    reg._numbers.append(spark.createDataFrame([("a", 0.999), ("c", 0.5)], "id string, u double"))
    assert {tuple(r) for r in reg.numbers().collect()} == first | {("c", 0.5)}
    (tmp_path / "r" / "numbers" / "batch=2").mkdir()
    (tmp_path / "r" / "numbers" / "batch=2" / "part-0.parquet").write_text("half a file")
    assert {tuple(r)[0] for r in reg.register(spark.createDataFrame([("d",)], "record_id string"), "record_id").collect()} == {"a", "b", "c", "d"}
    rates = spark.createDataFrame([("s", 0.5), ("t", None), (None, 1.0)], "sample_name string, rate double")
    for _ in range(3):
        assert {tuple(r) for r in reg.thresholds(rates).collect()} == {("s", 0.5), ("t", 0.0)}
    assert reg._thresholds.count() == 1


def test_builds_hang_on_the_registry(spark, monkeypatch):
    from tallyloom.llm import queries

    d = "/root/testdata/sf0.01"
    rows = lambda: sorted(tuple(r) for r in queries.p7_builds(spark, d).collect())
    kept = rows()
    assert kept == rows() and all(r[3] == 0 for r in kept)
    monkeypatch.setattr(permanent.NumberRegistry, "register", lambda self, ids, column: ids.select(F.col(column).alias("id"), permanent.unit_hash(column, seed=self.seed).alias("u")).distinct())
    assert rows() != kept


# Problem 8


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_whole_and_tight(seed):
    rnd = random.Random(seed)
    cap = 100
    counts = {}
    for _ in range(rnd.randrange(1, 400)):
        s = min(cap, max(1, int(rnd.paretovariate(0.8) * 3)))
        counts[s] = counts.get(s, 0) + 1
    segments, bins = packing.pack(counts, cap)
    fill, per = {}, {}
    for size, a, b, first, offset in segments:
        for r in range(a, b):
            fill.setdefault(first + r - a, []).append((offset, offset + size))
            per[size] = per.get(size, 0) + 1
    assert per == counts and set(fill) == set(range(bins))
    for spans in fill.values():
        spans.sort()
        assert spans[-1][1] <= cap and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    total = sum(s * n for s, n in counts.items())
    assert bins <= 1.25 * -(-total // cap) + 1 + sum(n for s, n in counts.items() if 2 * s > cap)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_meet_each_rank_in_its_segment(seed):
    """Every rank finds exactly its own segment, after looking at few others however many segments its size has."""
    rnd = random.Random(seed)
    counts = {s: rnd.randrange(1, 3_000) for s in rnd.sample(range(1, 200), 60)}
    segments, _ = packing.pack(counts, 200)
    parts, width = packing.blocks(segments)
    met = looked = 0
    by = {}
    for size, block, first, last, window, offset in parts:
        by.setdefault((size, block), []).append((first, last, window, offset))
    for size, n in counts.items():
        for rank in range(n):
            here = by[size, rank // width[size]]
            looked += len(here)
            met += sum(a <= rank < b for a, b, _, _ in here)
    assert met == sum(counts.values()) and looked <= 3 * met


def test_pack_nothing_and_full():
    assert packing.pack({}, 10) == ([], 0) and packing.pack({10: 3}, 10)[1] == 3 and packing.pack({5: 3}, 10)[1] == 2 and packing.pack({1: 25}, 10)[1] == 3


def test_windows_of_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 700), (5, "a b c"), (None, "x")], "doc_id long, text string")
    sizes = packing.token_counts(docs, packing.default_vocabulary())
    win = spark.createDataFrame([("w", 512), ("bad", 0), (None, 5)], "window_name string, capacity_tokens int")
    rows = packing.windows_of(sizes, win).collect()
    n = {r["doc_id"]: r["n_tokens"] for r in sizes.collect()}
    assert set(n) == {1, 4, 5}
    for d, total in n.items():
        mine = sorted((r["piece"], r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == d)
        assert sum(m[2] for m in mine) == total and len(mine) == -(-total // 512)
    used = packing.usage(packing.windows_of(sizes, win), win).first()
    assert used["tokens"] == sum(n.values()) and used["bins"] == 2 and used["least_bins"] == 2
    assert [tuple(r) for r in packing.wholeness(packing.windows_of(sizes, win), win).collect()] == [("w", 3, 0, 0, 0)]
    assert packing.windows_of(sizes.limit(0), win).count() == 0


def test_mix_report_names_the_further_witnesses(spark):
    """Claims of the builds and source groups stand beside the records of each source."""
    reg = spark.createDataFrame([("one_a", "ad_a", "g1"), ("two_b", "ad_b", "g2")], "dataset_name string, adapter_name string, source_group string")
    rows = [("1", "one_a", (None, "G1 ")), ("2", "one_a", (None, "g2")), ("3", "??", ("ad_b", "g2")), ("3", "??", ("ad_b", "g1")), ("4", "two_b", (None, None)), ("5", "two_b", (None, "unknown"))]
    canonical = spark.createDataFrame(rows, "record_id string, source_dataset string, metadata struct<adapter_name:string,source_group:string>")
    composition = spark.createDataFrame([("b1", "one_a", 5), ("b1", "ONE-A ", 2), ("b2", "one", 3), ("b2", None, 4), ("b2", "", 1), ("b1", "two_b", 7)], "build_label string, source_dataset string, row_count long")
    targets = spark.createDataFrame([("m", "one_a", 0.5, 1, 4), ("m", "two_b", 0.5, 1, 4)], "mix_name string, source_dataset string, target_share double, max_repeats int, mix_rows long")
    members = mixing.memberships(canonical, reg)
    report = mixing.plan(members, targets)[0]
    got = {r["source_dataset"]: r for r in mixing.witnessed(report, canonical, members, reg, composition).collect()}
    said = {k: (r["records"], r["claimed_rows"], r["unnamed_rows"], r["group_records"], r["other_group_records"]) for k, r in got.items()}
    assert said == {"one_a": (2, 10, 5, 1, 1), "two_b": (3, 7, 5, 1, 0)}
    empty = mixing.witnessed(report, canonical.limit(0), members.limit(0), reg, composition.limit(0)).collect()
    assert len(empty) == 2 and all(r["claimed_rows"] == r["unnamed_rows"] == r["group_records"] == 0 for r in empty)
