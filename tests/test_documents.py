import pytest
from pyspark.sql import functions as F

from tallyloom import schema
from tallyloom.operators import compare, evaluate, promptsets, report, serving
from tallyloom.plans import documents as D


def test_profiles_overlay_and_precedence():
    base = {"a": 1, "n": {"x": 1, "y": 2}, "profiles": {"full": {"n": {"y": 3}, "b": 4}}}
    assert D.overlay(base, "full") == {"a": 1, "n": {"x": 1, "y": 3}, "b": 4} == D.overlay(base, "big", aliases={"big": "full"})
    assert D.overlay(base, "none") == {"a": 1, "n": {"x": 1, "y": 2}} and D.first_set(None, 0, 5) == 0 and D.first_set(default=7) == 7
    with pytest.raises(ValueError):
        D.overlay(base, "none", strict=True)


def test_steps_resume_only_under_the_same_settings(tmp_path):
    f = D.fingerprint({"b": 1, "a": 2})
    assert f == D.fingerprint({"a": 2, "b": 1}) and len(D.fingerprint({}, 16, "sha1")) == 16
    for _ in range(2):
        D.save_step(str(tmp_path), "mix/1", {"x": 1}, f)
    assert D.finished_steps(str(tmp_path)) == ["mix/1"] and D.finished_steps(str(tmp_path / "no")) == []
    with pytest.raises(ValueError):
        D.save_step(str(tmp_path), "s2", {}, "other")
    D.check_resume(None, "any")
    assert D.rewrite_prefix("/mnt/a/b", {"/mnt/a": "/data"}) == "/data/b" and D.rewrite_prefix("/mnt/ab", {"/mnt/a": "/data"}) == "/mnt/ab" and D.rewrite_prefix(None, {}) is None
    assert D.excerpt(None, ("k",)) == {"k": None} and "updated_at_utc" in open(D.save_pointer(str(tmp_path / "p.json"), run="r")).read()


def test_schema_document():
    s = schema.json_schema()
    assert s["additionalProperties"] is False and "actions_requested" not in s["required"] and s["properties"]["priority"]["enum"] == list(schema.DOMAINS["priority"])


def test_promptset(spark):
    df = spark.range(90).select(F.concat(F.lit("r"), "id").alias("record_id"), F.repeat(F.lit("word. "), (F.col("id") % 30 + 1).cast("int")).alias("input_text"))
    rows = promptsets.promptset(df, 60, 10)
    counts = {r["length_family"]: r["count"] for r in rows.groupBy("length_family").count().collect()}
    assert counts == {"natural": 60, "stress": 10} and rows.where("length_family = 'stress' and benchmark_variant is null").count() == 0
    m = promptsets.median_and_p90(spark.createDataFrame([("k", x) for x in (1, 2, 3, 10)], "k string, x long"), ["k"], "x").first()
    assert (m["median"], m["p90"]) == (2.5, 3)


def test_training_series(spark):
    log = spark.createDataFrame([(1, "0.5", None, None, "x"), (2, None, "0.4", "0.9", None), (3, None, None, "0.3", "1e-4")], "step long, loss string, eval_loss string, train_loss string, learning_rate string")
    got = {(r["step"], r["metric"]): r["value"] for r in promptsets.training_series(log).collect()}
    assert got == {(1.0, "loss"): 0.5, (2.0, "eval_loss"): 0.4, (3.0, "loss"): 0.3, (3.0, "learning_rate"): 1e-4}
    assert promptsets.telemetry(spark.createDataFrame([(2.0,)], "step double"), 4, 2, 10.0).first()["tokens_seen"] == 160.0


def test_reports(spark):
    import __spark_entry__ as entry

    q, d = entry.queries(), "/root/testdata/sf0.001"
    rates, prf, buckets = (q[n](spark, d).where("stage = 'sft'").drop("stage") for n in ("evaluation_rates", "prf_per_field", "bucket_labels_explode"))
    text = report.single_run("sft", rates, prf, buckets, q["primary_bucket"](spark, d).where("primary_bucket <> 'clean'"))
    assert "| micro |" in text and text.count("## ") == 4
    assert "semantic_gain" in report.comparison(q["stage_delta_pivot"](spark, d), q["stage_evidence_topk"](spark, d), q["failure_bucket_matrix"](spark, d))
    rows = spark.createDataFrame([("e1", True, 1.0, "short"), ("e1", True, 4.0, "long"), ("e2", False, 9.0, "short"), ("e2", False, 9.0, "long")], "e string, success boolean, ms double, bucket_label string")
    whole, parts = serving.workload_summary(rows, ["e"], "ms", "success"), serving.workload_summary(rows, ["e", "bucket_label"], "ms", "success")
    wide = {r["e"]: r for r in report.experiment_summary(whole, parts, "e").collect()}
    assert wide["e1"]["short_to_long_p99_ratio"] == 0.25 and wide["e2"]["short_p99_ms"] is None
    assert [tuple(r) for r in report.failures_by_experiment(rows, "e").collect()] == [("e2", 2)] and report.best_row(rows, "ms", "e").first()["e"] == "e2"


def test_correctness_sample(spark):
    rows = spark.createDataFrame([("a", True, True, True), ("b", True, False, None), ("c", False, False, None)], "record_id string, parses boolean, valid boolean, priority boolean")
    r = serving.correctness(rows, rows.select("record_id").limit(3), ["priority"]).first()
    assert (r["sampled"], r["json_parse_pass_rate"], r["priority"]) == (3, 0.666667, 1.0)
    assert serving.correctness(rows.limit(0), rows.select("record_id"), []).first()["schema_pass_rate"] == 0.0
    assert compare.struct_code and evaluate.column("a.b") == "a_b"
