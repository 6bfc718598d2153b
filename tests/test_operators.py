import pytest
from pyspark.sql import functions as F

from tallyloom.operators import augment, compare, evaluate, lineage, preference, profile, sampling, serving

COUNTS = {"a": 8, "b": 4}


def test_quotas_top_up_before_the_cap():
    assert sampling.quotas(COUNTS, 6, {}, 0.5) == {"a": 3, "b": 3}
    assert sampling.quotas(COUNTS, 12, {}) == {"a": 8, "b": 4}
    assert sampling.quotas({"a": 1, "b": 9}, 6, {}) == {"a": 1, "b": 5}
    assert sum(sampling.quotas({"a": 5, "b": 5, "c": 5}, 2, {}).values()) == 2
    assert sampling.quotas({}, 5, {}) == {}


def test_samples_do_not_depend_on_layout(spark):
    df = spark.range(500).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") < 400, "hot").otherwise("cold").alias("s"))
    runs = [sorted(r[0] for r in sampling.weighted_sample(df.repartition(n), "s", "id", 100, {"hot": 2.0}, None, 17).collect()) for n in (1, 4, 16)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 100
    assert sampling.percent_subset(df, "id", 0.3).count() == 150 and sampling.percent_subset(df.limit(0), "id", 0.3).count() == 0
    assert sampling.percent_subset(df, "id", 0.5, limit=3).count() == 3
    with pytest.raises(ValueError):
        sampling.percent_subset(df, "id", 0)


def test_cap_of_synthetic_rows(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") < 50).alias("s"))
    assert sampling.cap_synthetic(df, "s", "id", 0.2, 1).where("s").count() == 12


def test_mixes(spark):
    rows = spark.createDataFrame([("a", "short"), ("b", "short"), ("c", "long"), ("d", "stress_long"), ("e", "stress_long")], "id string, b string")
    assert {r["b"] for r in sampling.workload_mix(rows, "b", "id", "stress_mix_50_50_x", 4, 1).collect()} == {"short", "stress_long"}
    assert sampling.workload_mix(rows, "b", "id", "stress_mix_50_50_x", 4, 1).count() == 4
    assert sampling.mix_plan("natural_mix_90_10_short_long", 10, 0) == [("short", 0, 9), ("long", 1, 1), ("medium", 2, None)]
    with pytest.raises(ValueError):
        sampling.mix_plan("no", 1, 0)


def test_chunks(spark):
    got = [r["chunk"] for r in sampling.chunks(spark.range(7).repartition(3), ["id"], 3).orderBy("id").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 20])
def test_three_percentiles(spark, n):
    import math

    v = sorted((i * 37) % 11 for i in range(n))
    df = spark.createDataFrame([(x,) for x in v], "x long")
    at = lambda e: profile.ordered_value(df, [], "x", e, "y").first()[0]
    assert at(profile.rank_ceil(0.9)) == v[max(0, math.ceil(0.9 * n) - 1)]
    assert at(profile.rank_round(0.95)) == v[round((n - 1) * 0.95)]
    assert at(profile.rank_floor(0.66)) == v[int((n - 1) * 0.66)]


def test_profiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, x long")
    assert profile.histogram(empty, "x").count() == 0 and profile.length_buckets(empty, "x").count() == 0
    assert profile.null_rates(empty, {"x": F.col("x")}).first()["null_rate"] == 0.0


def test_all_leaks_go(spark):
    rows = [(f"t{i}", "train", "r") for i in range(30)] + [("e", "eval", "r"), ("ok", "train", None), ("s", None, "r")]
    df = spark.createDataFrame(rows, "record_id string, split string, lineage_root_id string")
    assert {r[0] for r in lineage.without_leaks(df).collect()} == {"e", "ok", "s"}
    s = lineage.summary(df).first()
    assert s["leaked_train_row_count"] == 30 and len(s["leaked_examples"]) == 10 and not s["is_lineage_clean"]


TARGET = "struct<summary:string,customer:struct<name:string,account_id:string,plan_tier:string>>"


def test_augmentation_order_and_nulls(spark):
    rows = [("b", "train", "s", "I am Ann Lee of ENT-1, Pro plan", ("x", ("Ann Lee", "ENT-1", "pro")), None), ("a", "train", "s", "plain", ("x", (None, None, None)), "root"), ("c", "train", "s", None, ("x", None), None)]
    df = spark.createDataFrame(rows, f"record_id string, split string, source_dataset string, input_text string, target {TARGET}, lineage_root_id string")
    out = {(r["parent_record_id"], r["augmentation_kind"]): r for r in augment.augmented(df).collect()}
    assert ("a", "missing_field_ticket") not in out and ("b", "correct_null_ticket") not in out and not any(k[0] == "c" for k in out)
    hidden = out["b", "missing_field_ticket"]
    assert hidden["record_id"] == "b__aug_009" and hidden["input_text"].startswith("I am our team of the affected account, current plan plan\n\n")
    assert hidden["target"]["customer"].asDict() == dict(name=None, account_id=None, plan_tier=None) and out["a", "correct_null_ticket"]["lineage_root_id"] == "root"
    assert [r["augmentation_index"] for r in augment.augmented(df, 3).orderBy("augmentation_index").collect()] == [0, 1, 3]


P = "struct<issue_category:string,priority:string,product_area:string,customer_name:string,customer_account_id:string,customer_plan_tier:string,sentiment:string,requires_human_followup:string,actions_requested:array<string>,summary:string>"


def pred(**k):
    base = dict(issue_category="billing", priority="low", product_area="api", customer_name=None, customer_account_id="A", customer_plan_tier=None, sentiment="neutral", requires_human_followup="True", actions_requested=["a", "b"], summary="one two")
    return tuple({**base, **k}.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, f"record_id string, stage string, parses boolean, valid boolean, extra int, p {P}, r {P}")


def test_metrics(spark):
    df = frame(spark, [("1", "s", True, True, 0, pred(), pred()), ("2", "s", True, True, 1, pred(actions_requested=["a"], customer_name="X", priority="high"), pred()), ("3", "s", False, False, 0, None, pred())])
    counts = {r["field"]: r for r in evaluate.prf(evaluate.field_counts(df)).collect()}
    assert (counts["priority"]["tp"], counts["priority"]["fp"], counts["priority"]["fn"]) == (1, 1, 2)
    assert (counts["actions_requested"]["tp"], counts["actions_requested"]["fn"]) == (3, 3) and "micro" in counts
    rates = evaluate.rates(df, ["stage"]).first()
    assert abs(rates["json_validity_rate"] - 2 / 3) < 1e-6 and abs(rates["exact_priority"] - 1 / 3) < 1e-6
    errors = {r["field"]: r for r in evaluate.field_errors(df, ["stage"]).collect()}
    assert errors["customer.name"]["null_handling_mistake"] == 1 and errors["customer.account_id"]["missing"] == 1
    scored = {r["record_id"]: r for r in evaluate.scored(df).collect()}
    assert scored["1"]["failure_mode"] == "clean" and scored["1"]["exact"] and scored["1"]["labels"] == []
    assert scored["2"]["labels"] == ["hallucinated_keys", "semantic_failures", "null_handling_mistakes", "partial_action_extraction"] and scored["3"]["labels"][0] == "syntax_failures"
    assert abs(scored["1"]["semantic_score"] - 1) < 1e-12
    assert evaluate.prf(evaluate.field_counts(df.limit(0))).count() <= 1


def test_missing_is_not_null(spark):
    df = spark.createDataFrame([('{"a": null}',), ('{"b": true}',), ('{"a": 1}',)], "j string")
    got = [r[0] for r in df.select(evaluate.path_token(F.try_parse_json("j"), "$.a")).collect()]
    assert got == ["$.a=null", None, "$.a=1"]


def test_ranking_and_pairs(spark):
    good, bad = pred(), pred(priority="high")
    df = frame(spark, [("r", "s", True, True, 0, good, pred()), ("r", "s", True, True, 0, good, pred()), ("r", "s", False, False, 0, None, pred()), ("q", "s", True, True, 0, good, pred()), ("q", "s", True, True, 0, bad, pred())])
    w = evaluate.scored(df).withColumn("candidate_index", F.when(F.col("parses"), F.when(F.col("matches") == 8, 0).otherwise(1)).otherwise(2)).withColumn("text_key", F.col("candidate_index").cast("string")).withColumn("dedupe_key", F.col("text_key"))
    pairs = {r["record_id"]: r for r in preference.gated(preference.pairs(preference.ranked_candidates(preference.distinct_candidates(w)))).collect()}
    assert pairs["r"]["n"] == 2 and pairs["r"]["chosen"]["candidate_index"] == 0 and pairs["r"]["rejected"]["candidate_index"] == 2 and pairs["r"]["skip_reason"] is None
    assert pairs["q"]["rejected"]["candidate_index"] == 1
    lone = preference.gated(preference.pairs(preference.ranked_candidates(preference.distinct_candidates(w.where("record_id = 'r' and parses"))))).first()
    assert lone["skip_reason"] == "insufficient_distinct_candidates"


def test_comparison_classes(spark):
    def row(i, b, s, d):
        return [(i, st, True, v, 0, p, pred()) for st, (v, p) in zip(("baseline", "sft", "dpo"), (b, s, d), strict=True)]

    good, bad, awful = (True, pred()), (True, pred(priority="high")), (True, pred(issue_category="x", priority="x", product_area="x", sentiment="x", customer_account_id=None, actions_requested=[]))
    df = frame(spark, row("r1", bad, good, good) + row("r2", good, bad, good) + row("r3", good, good, bad) + row("r4", good, (False, pred()), good) + row("r5", awful, awful, awful))
    scored = evaluate.scored(df).withColumn("raw_output", F.col("p.priority"))
    j = compare.three_way(scored, score="semantic_score")
    cases = {(r["category"], r["record_id"]) for r in compare.case_studies(j).collect()}
    assert {("baseline_bad_to_sft_good", "r1"), ("sft_good_to_dpo_better", "r2"), ("sft_good_to_dpo_worse", "r3"), ("syntax_cleaned_up_semantics_unchanged", "r4"), ("unchanged_hard_failures", "r5")} <= cases
    found = {(r["evidence"], r["record_id"]) for r in compare.evidence(compare.three_way(scored)).collect()}
    assert {("semantic_gain", "r2"), ("semantic_regression", "r3"), ("syntax_gain_only", "r4")} <= found
    assert compare.regressions(j).first()["record_id"] == "r3"


def test_zip_is_strict(spark):
    a = spark.range(3).withColumnRenamed("id", "ordinal")
    with pytest.raises(ValueError):
        compare.zip_join(a, a.limit(2))


def test_serving(spark):
    df = spark.createDataFrame([("a", 10.0, True), ("a", 20.0, True), ("a", 30.0, True), ("a", 40.0, True), ("a", 999.0, False)], "w string, ms double, ok boolean")
    r = serving.workload_summary(df, ["w"], "ms", "ok", F.lit(2.0)).first()
    assert (r["p50"], r["p90"], r["p99"], r["request_count"], r["success_count"], r["throughput_rps"], r["success_rps"]) == (20, 40, 40, 5, 4, 2.5, 2.0)
    b = spark.range(1).select(serving.context_budget(F.lit(20), F.lit(12), max_len=12, margin=0, least=2, wanted=4).alias("b")).first()["b"]
    assert b["reason"] == "trimmed_user_ticket_text" and b["kept"] == 2 and b["head"] + b["tail"] == 2
    toks = spark.range(1).select(serving.cut_tokens(F.split(F.lit("a b c d"), " "), F.struct(F.lit(2).alias("trimmed"), F.lit(1).alias("head"), F.lit(1).alias("tail"))).alias("t")).first()["t"]
    assert toks == ["a", "d"]
    conf = spark.createDataFrame([(10.0, None, 1, 1), (9.0, 5.0, 2, 1), (1.0, 1.0, 3, 1)], "throughput_rps double, short_p99_ms double, max_num_batched_tokens int, max_num_seqs int")
    assert serving.tuned_config(conf, 0.8).first()["max_num_batched_tokens"] == 2
    assert [r["request_id"] for r in serving.request_ids(spark.createDataFrame([("b",), ("a",)], "k string"), "x", "k").orderBy("k").collect()] == ["x-00000", "x-00001"]
