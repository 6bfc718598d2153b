import json

import pytest
from pyspark.sql import functions as F

from tallyloom import storage
from tallyloom.plans.build import Profile, build
from tallyloom.sources import adapters, readers, registry, sinks
from tallyloom.streaming import requests


def test_jsonl_is_strict(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "more": 2}\n\n{"id": "2"}\n')
    rows = readers.read_jsonl(spark, str(p), "id string").collect()
    assert [r["id"] for r in rows] == ["1", "2"] and rows[0]["raw"].startswith('{"id"')
    p.write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl(spark, str(p), "id string").collect()
    assert readers.read_jsonl_or_empty(spark, str(tmp_path / "none"), "id string").count() == 0


def test_csv_headers_and_empty_cells(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Complaint ID,Sub-product\n1,"two\nlines"\n2,\n3,""\n')
    rows = readers.read_csv(spark, str(p)).orderBy("complaint_id").collect()
    assert rows[0]["sub_product"] == "two\nlines" and not rows[1]["sub_product"] and not rows[2]["sub_product"]


def test_step_checkpoints(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"step_id": "s1", "experiment_family": "base", "summary_row": {"rps": 1.0}, "raw_rows": [{"id": "q"}]}))
    (tmp_path / "b.json").write_text("{broken")
    steps = readers.read_step_checkpoints(spark, str(tmp_path), "step_id string, experiment_family string, summary_row struct<rps:double>, raw_rows array<struct<id:string>>")
    parts = readers.bundle_from_steps(steps)
    assert parts["summary_rows"].count() == 1 and parts["raw_rows"].first()["id"] == "q" and parts["config_rows"].count() == 0


ENTRY = dict(dataset_name="a", source_type="local_jsonl", source_uri_or_path="{raw_root}/x", adapter_name="hf_it_helpdesk_ticket_v1", source_group="domain_task_data", odd=1)


def test_registry(spark, tmp_path):
    (s,) = registry.registry([ENTRY])
    assert s.extra == {"odd": 1} and s.path("/r", "/raw") == "/raw/x" and registry.registry_frame(spark, [s]).count() == 1
    with pytest.raises(ValueError):
        registry.registry([ENTRY, ENTRY])
    with pytest.raises(ValueError):
        registry.registry([{**ENTRY, "source_type": "ftp"}])
    assert registry.active([s], exclude={"a"}) == [] and registry.active([s]) == [s]
    with pytest.raises(FileNotFoundError):
        registry.resolve(s, str(tmp_path), str(tmp_path))
    assert registry.resolve(s, str(tmp_path), str(tmp_path), fetch=lambda src, path: open(path, "w").close())[0].endswith("/x")


def test_adapters_and_rejects(spark):
    desk = spark.createDataFrame([("T1", "Locked out", "I cannot access my account, urgent", "a.b@x.org"), (None, None, " ", None)], "ticket_id string, subject string, description string, requester_email string")
    rows = adapters.adapt("hf_it_helpdesk_ticket_v1", desk).orderBy("reason").collect()
    t = rows[0]["target"]
    assert (t["issue_category"], t["priority"], t["customer"]["name"], rows[0]["input_text"]) == ("account_access", "urgent", "A B", "Subject: Locked out\n\nI cannot access my account, urgent")
    assert adapters.rejects(adapters.adapt("hf_it_helpdesk_ticket_v1", desk), "x").first()["reason"] == "missing_description"
    mail = spark.createDataFrame([("1", "s", "How do I start? low", ["x"], "See the help center")], "id string, subject string, message string, tags array<string>, answer string")
    assert adapters.adapt("hf_customer_support_ticket_v1", mail).first()["target"]["requires_human_followup"] is False
    law = spark.createDataFrame([("9", "Card", None, "Fees", "Charged twice")], "complaint_id string, product string, sub_product string, issue string, consumer_complaint_narrative string")
    got = adapters.adapt("cfpb_complaint_csv_v1", law).first()
    assert got["target"]["summary"] == "Card: Fees" and got["target"]["issue_category"] == "billing" and got["extras"] == {"product": "Card", "issue": "Fees"}
    with pytest.raises(ValueError):
        adapters.adapt("none", law)
    loose = spark.createDataFrame([("a", '{"summary": 1}'), ("b", None)], "text string, output string")
    assert {r["reason"] for r in adapters.adapt("hf_schema_discipline_json_v1", loose).collect()} == {"schema_violation", "missing_text_or_output"}


def test_build_and_export(spark, tmp_path):
    (s,) = registry.registry([ENTRY])
    raw = spark.range(60).select(F.concat(F.lit("t"), "id").alias("ticket_id"), F.lit("s").alias("subject"), F.when(F.col("id") > 0, F.concat(F.lit("the printer of ENT-"), "id")).alias("description"))
    rows, refused = build([(s, raw)], Profile(train_target=20, eval_target=5, max_source_share=None, max_synthetic_share=0.25))
    counts = {(r["split"], r["syn"]): r["count"] for r in rows.groupBy("split", F.col("metadata.synthetic").alias("syn")).count().collect()}
    assert refused.count() == 1 and counts["train", False] == 20 and counts["train", True] <= 6 and counts["eval", False] == 5
    paths = sinks.export(rows, str(tmp_path))
    assert spark.read.parquet(paths["canonical"]).count() == rows.count()
    line = json.loads(spark.read.text(paths["sft_prompt_completion"]).first()[0])
    assert list(line) == sorted(line) and json.loads(line["completion"])["customer"] == {"account_id": None, "name": None, "plan_tier": None}


def test_small_sinks(spark, tmp_path):
    path = sinks.write_document(str(tmp_path / "d" / "x.json"), {"b": 1, "a": None})
    assert readers.read_json_document(path) == {"a": None, "b": 1} and readers.read_json_document(str(tmp_path / "no")) is None
    with pytest.raises(ValueError):
        sinks.mirror(path, str(tmp_path / "y"), most=1)
    a, b = spark.createDataFrame([(1, {"k": "v"})], "x int, m map<string,string>"), spark.createDataFrame([(2,)], "y int")
    sinks.write_csv_union([a, b], str(tmp_path / "u"))
    assert spark.read.csv(str(tmp_path / "u"), header=True).count() == 2
    assert sinks.markdown_table(b) == "| y |\n| --- |\n| 2 |\n"
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(5), 4)
    assert readers.first_existing([None, str(tmp_path / "no"), path]) == path


def test_request_stream(spark, tmp_path):
    src = str(tmp_path / "log")
    rows = [("a", "2024-01-01 00:00:01", "short", True, 5.0), ("a", "2024-01-01 00:00:01", "short", True, 5.0), ("b", "2024-01-01 00:00:30", "short", False, 9.0), ("c", "2024-01-01 00:30:00", "short", True, 1.0)]
    spark.createDataFrame(rows, "request_id string, t string, bucket_label string, success boolean, latency_ms double").select("request_id", F.col("t").cast("timestamp").alias("ts"), "bucket_label", "success", "latency_ms").write.parquet(src)
    out = requests.windowed_latency(requests.request_stream(spark, src))
    for _ in range(2):  # a second run adds nothing
        requests.write_once(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).orderBy("start").first()
    assert (first["requests"], first["successes"], first["mean_ms"]) == (2, 1, 5.0)


def test_written_tables_use_the_shared_folder(spark):
    assert storage.written(spark.range(3).toDF("x"), "t").count() == 3
    assert storage.shared_dir(spark) == storage.shared_dir(spark)
