import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import generate, manifests, preference, profile, report, sampling
from tallyloom.plans import documents as D
from tallyloom.sources import registry, sinks, staging
from tallyloom.streaming import requests as stream

TARGET = {"summary": "s", "issue_category": "other", "priority": "low", "product_area": "api", "customer": {"name": None, "account_id": None, "plan_tier": None}, "sentiment": "neutral", "requires_human_followup": True, "actions_requested": []}


def test_training_rows_in_both_shapes(spark):
    df = spark.createDataFrame([("a", "p", "c", "r"), (None, None, "c2", None), ("b", "q", None, None)], "record_id string, prompt string, completion string, reference_json string").withColumn("o", F.coalesce("prompt", F.lit("z")))
    rows = {r["record_id"]: tuple(r)[1:] for r in manifests.training_rows(df, "prompt_completion", order=["o"]).collect()}
    assert rows == {"a": ("p", "c"), "row-3": ("", "c2"), "b": ("q", "")}
    assert {r["completion"] for r in manifests.training_rows(df.drop("completion"), "prompt_completion", held_out=True).collect()} == {"r", ""}
    talk = spark.createDataFrame([("a", [("user", "u"), ("assistant", "x")]), ("b", [("user", "u")]), ("c", None)], "record_id string, messages array<struct<role:string,content:string>>")
    got = {r["record_id"]: r["completion"] and r["completion"][0]["content"] for r in manifests.training_rows(talk, "messages").collect()}
    assert got == {"a": "x", "b": None, "c": None}
    with pytest.raises(ValueError):
        manifests.training_rows(df, "table")
    assert manifests.training_rows(df.limit(0), "prompt_completion", percent=0.5).count() == 0


def test_preference_rows_are_whole(spark):
    df = spark.createDataFrame([("p", "c", "r"), ("p", "", "r"), ("p", "c", None)], "prompt string, chosen string, rejected string")
    assert manifests.preference_rows(df, strict=False).count() == 1
    with pytest.raises(Exception, match="preference row"):
        manifests.preference_rows(df).collect()
    assert manifests.labelled(df.withColumn("record_id", F.lit("x"))).first()["labeling_status"] == "labeled"


def test_exchange_format_both_ways(spark):
    df = spark.createDataFrame([("a", "in", json.dumps(TARGET), "sys", {"k": "v"}), ("b", "in", "{}", None, None)], "record_id string, input string, output string, system string, metadata map<string,string>")
    rows = {r["record_id"]: r for r in manifests.from_exchange(df).collect()}
    assert rows["a"]["metadata"] == {"k": "v", "source_system": "sys"} and rows["a"]["target"]["product_area"] == "api" and rows["a"]["reason"] is None
    assert rows["b"]["reason"] == "invalid_target" and rows["b"]["metadata"] == {} and (rows["b"]["split"], rows["b"]["source_dataset"]) == ("train", "exchange")
    again = manifests.to_exchange(manifests.from_exchange(df).where("reason is null")).first()
    assert again["input"].endswith("in") and json.loads(again["output"]) == TARGET and again["system"] == X.SYSTEM_TEXT


def test_requests_and_generation(spark):
    df = spark.createDataFrame([("a", "p", [("user", "u")]), ("b", None, None)], "record_id string, prompt string, messages array<struct<role:string,content:string>>")
    rows = manifests.requests(df, 3, 40)
    assert sorted({(r["candidate_index"], r["seed"]) for r in rows.collect()}) == [(0, 40), (1, 41), (2, 42)] and rows.where("messages is not null").count() == 0
    out = generate.generated(rows.select("record_id", "prompt", "seed"), generate.Placeholder, batch=2).collect()
    assert len(out) == 6 and all(r["response"]["valid"] and r["response"]["missing"] == [] for r in out)

    class Broken:
        def generate_batch(self, prompts, seeds):
            return [("no object", 1.0)] * (len(prompts) - 1)

    with pytest.raises(Exception, match="answers to"):
        generate.generated(rows.select("prompt", "seed"), Broken).collect()
    text = generate.generated(rows.select("prompt", "seed").limit(0), generate.Placeholder)
    assert text.count() == 0


def test_prompt_text_of_bare_tables(spark):
    assert spark.createDataFrame([("t",), (None,)], "input_text string").select(manifests.prompt_text(spark.createDataFrame([], "input_text string")).alias("x")).collect() == [("t",), ("",)]


def test_staging_of_archives_and_fallbacks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.csv", "Id,Text\n1,x\n")
        z.writestr("a.txt", "no")
    url = (tmp_path / "a.zip").as_uri()
    entry = dict(dataset_name="a", source_type="local_csv", source_uri_or_path="{raw_root}/in/rows.csv", adapter_name="x", source_group="domain_task_data", download_url=url)
    (s,) = registry.registry([entry])
    rows, path, fixture = staging.source_rows(spark, s, "id string", str(tmp_path), fetch=staging.stage)
    assert rows.first()["text"] == "x" and path.endswith("rows.csv") and not fixture and not list((tmp_path / "in").glob("tmp*"))
    with pytest.raises(FileNotFoundError):
        staging.download(url, str(tmp_path / "c.csv"), "none.csv")
    (hub,) = registry.registry([{**entry, "dataset_name": "h", "source_type": "huggingface", "source_uri_or_path": "{raw_root}/h.jsonl", "download_url": None}])
    (tmp_path / "hub.jsonl").write_text('{"id": "7"}\n')
    with pytest.raises(FileNotFoundError):
        staging.source_rows(spark, hub, "id string", str(tmp_path), fetch=staging.stage)
    staging.HUBS["huggingface"] = lambda uri, split: str(tmp_path / "hub.jsonl")
    try:
        assert staging.source_rows(spark, hub, "id string", str(tmp_path), fetch=staging.stage)[0].first()["id"] == "7"
    finally:
        staging.HUBS.clear()
    (generated,) = registry.registry([{**entry, "source_type": "generated"}])
    assert staging.source_rows(spark, generated, "id string", str(tmp_path))[:2] == (None, None)


def test_yaml_pointer_and_cache(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a: 1\nprofiles:\n  full:\n    a: 2\n")
    assert D.load_profile(str(tmp_path / "c.yaml"), "full") == {"a": 2} and D.load_profile(str(tmp_path / "c.yaml"), None) == {"a": 1}
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        D.load_yaml(str(tmp_path / "l.yaml"))
    (tmp_path / "r.yaml").write_text("sources:\n- {dataset_name: a, source_type: generated, source_uri_or_path: x, adapter_name: y, source_group: domain_task_data}\n")
    assert registry.load_registry(str(tmp_path / "r.yaml"))[0].dataset_name == "a"
    assert D.read_pointer(str(tmp_path / "p.json")) is None
    D.save_pointer(str(tmp_path / "p.json"), run="r")
    assert D.read_pointer(str(tmp_path / "p.json"))["run"] == "r"
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [D.cached_rows(spark, str(tmp_path / "cache"), "k", make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    assert D.run_manifest("r", {"b": 1}, metrics=None, rows=3)["rows"] == 3


def test_json_lines_are_ascii(spark, tmp_path):
    df = spark.createDataFrame([(1, "é \U0001f600 plain"), (2, None), (3, "ascii")], "b long, a string")
    sinks.write_jsonl(df, str(tmp_path / "j"), ["b"])
    lines = [r[0] for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(lines) == sorted(json.dumps({"a": a, "b": b}, sort_keys=True, separators=(",", ":")) for b, a in ((1, "é \U0001f600 plain"), (2, None), (3, "ascii")))
    paths = sinks.write_mixes(df.withColumn("mix_name", F.lit("m")), str(tmp_path / "m"), order="b")
    assert list(paths) == ["m"] and spark.read.text(paths["m"]).count() == 3


@pytest.mark.parametrize("ranges", [1, 3, 4_096])
def test_percentiles_match_sorting(spark, monkeypatch, ranges):
    """Ties, negative values, outliers, one value only, null values and null keys, with few and many ranges."""
    monkeypatch.setattr(profile, "RANGES", ranges)
    rnd = random.Random(ranges)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, -1e9, 1e12, 0.0, *(round(rnd.gauss(0, 50), 1) for _ in range(9))])) for _ in range(400)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in profile.ordered_values(df, ["k"], "v", {"lo": profile.rank_floor(0.33), "mid": profile.rank_round(0.5), "top": profile.rank_ceil(0.99)}).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        s = sorted(v for x, v in rows if x == k and v is not None)
        if s:
            want[k] = (s[int((len(s) - 1) * 0.33)], s[round((len(s) - 1) * 0.5)], s[max(0, -(-99 * len(s) // 100) - 1)])
    assert got == want and "none" not in got
    assert profile.ordered_values(df.where("k = 'none'"), [], "v", {"x": profile.rank_floor(0.5)}).collect() in ([], [(None,)])


def test_large_top_n_is_cut_by_rank(spark, monkeypatch):
    df = spark.range(300).select(F.concat(F.lit("r"), "id").alias("record_id"))
    few = [sorted(r[0] for r in sampling.hash_top_n(df, "record_id", 5, 40).collect()), [r[0] for r in sampling.first_n(df, ["record_id"], 40).collect()]]
    monkeypatch.setattr(sampling, "TOP", 10)
    assert sorted(r[0] for r in sampling.hash_top_n(df, "record_id", 5, 40).collect()) == few[0]
    assert sorted(r[0] for r in sampling.first_n(df, ["record_id"], 40).collect()) == sorted(few[1])


def test_preference_artifacts_and_final_report(spark, tmp_path):
    import __spark_entry__ as entry

    q, d = entry.queries(), "/root/testdata/sf0.001"
    pairs, summary = q["preference_manifest"](spark, d), q["preference_summary"](spark, d)
    paths = preference.write_artifacts(str(tmp_path), pairs, q["preference_audit"](spark, d), summary)
    assert spark.read.text(paths["pairs"]).count() == pairs.count() and spark.read.text(paths["summary"]).where("value like '%overall%'").count() == 1
    frames, there = report.bundle({"sft": {"metrics": pairs, "history": None}}, {"composition": None})
    assert list(frames) == ["sft/metrics"] and ("all", "composition", False) in there
    names = ("stage_table", "stage_delta_pivot", "failure_bucket_matrix", "case_study_topk")
    text = report.final_report(q["composition_table"](spark, d).drop("build_label"), *[q[n](spark, d) for n in names], there)
    assert text.count("\n## ") == 6 and "- sft: history" in text and "| baseline |" in text


def test_stream_windows_and_progress(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "short", True, 10.0, 1.0), ("a", "2024-01-01 00:00:00", "short", True, 10.0, 1.0), ("b", "2024-01-01 00:00:50", "short", False, 99.0, None), ("c", "2024-01-01 00:05:00", "short", True, 30.0, 3.0)]
    spark.createDataFrame(rows, "request_id string, t string, bucket_label string, success boolean, latency_ms double, ttft_ms double").withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "in"))
    got = {}
    for kind, args in (("tumble", {"window": "1 minute"}), ("slide", {"window": "1 minute", "slide": "30 seconds"}), ("session", {"gap": "2 minutes"})):
        out = stream.windowed_latency(stream.request_stream(spark, str(tmp_path / "in")), late="1 hour", **args)
        query = out.writeStream.outputMode("complete").format("memory").queryName(f"w_{kind}").trigger(availableNow=True).start()
        query.awaitTermination()
        got[kind] = sorted((r["requests"], r["successes"], r["mean_ms"], r["mean_ttft_ms"]) for r in spark.table(f"w_{kind}").collect())
        told = stream.progress(query)
        assert sum(p["input_rows"] for p in told) == 4 and told[-1]["late_rows"] == 0
    assert got["tumble"] == got["session"] == [(1, 1, 30.0, 3.0), (2, 1, 10.0, 1.0)] and len(got["slide"]) == 5
