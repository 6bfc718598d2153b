import json

from pyspark.sql import functions as F

from tallyloom.functions import scores as S
from tallyloom.functions import text as X
from tallyloom.functions import udfs


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def lit(v):
    return F.lit(v)


def test_classifiers_use_substrings_in_order(spark):
    r = one(
        spark,
        a=X.issue_category(lit("My invoice shows an error")),
        b=X.issue_category(lit("the app crashed")),
        c=X.priority(lit("follow up later")),  # "low" inside a word
        d=X.priority(lit("CRITICAL but low")),
        e=X.priority(lit("refund please")),
        f=X.plan_tier(lit("there is a problem")),  # "pro" inside a word
        g=X.plan_tier(lit("nothing here")),
        h=X.sentiment(lit("thanks, but it is broken")),
        i=X.product_area(lit("")),
        j=X.issue_category(F.lit(None).cast("string"), lit("webhook")),
    )
    assert r == dict(a="billing", b="technical_bug", c="low", d="urgent", e="high", f="pro", g=None, h="positive", i="other", j="integration")


def test_names_and_summaries(spark):
    r = one(spark, a=X.name_from_email(lit("ana.maria_lopez@x.org")), b=X.name_from_email(lit("nobody")), c=X.name_from_email(lit("@x.org")), d=X.summary_line(lit(" "), lit("a\n  b")), e=X.summary_line(lit(None).cast("string"), lit("")), f=F.length(X.summary_line(lit("x" * 200), lit(""))))
    assert r == dict(a="Ana Maria Lopez", b=None, c=None, d="a b", e="Customer support request", f=140)


def test_split_rules(spark):
    r = one(spark, a=X.hash_split(lit("example"), lit("row-1"), eval_ratio=0.653), b=X.hash_split(lit("example"), lit("row-1"), eval_ratio=0.652), c=X.hash_split(lit("e"), lit("r"), lit(" Validation ")), d=X.split_hint(lit("dev")))
    assert r == dict(a="eval", b="train", c="eval", d=None)


def test_fences_sentences_tokens(spark):
    r = one(spark, a=X.strip_fences(lit("```json\n{}\n```")), b=X.strip_fences(lit("{}")), c=X.sentences(lit("One. Two..\nThree")), d=X.sentences(lit("none")), e=X.word_tokens(lit("Ab-c 9")), f=F.size(X.space_tokens(lit("  ")))) 
    assert r == dict(a="{}", b="{}", c=["One", "Two", "Three"], d=["none"], e=["ab", "c", "9"], f=0)


def test_messages(spark):
    m = X.messages(lit(" hi "), lit("{}"))
    r = one(spark, a=F.size(X.before_assistant(m)), b=X.conversation(m)["completion"][0]["content"], c=X.conversation(X.messages(lit("x"))), d=F.size(X.request_messages(F.slice(m, 3, 1), lit("t"))))
    assert r["a"] == 2 and r["b"] == "{}" and r["c"] is None and r["d"] == 2


def test_replace_first_is_literal_and_once(spark):
    r = one(spark, a=X.replace_first(lit("a.b a.b"), lit("a.b"), "x"), b=X.replace_first(lit("PRO pro"), lit("pro"), "plan", True), c=X.replace_first(lit("t"), F.lit(None).cast("string"), "x"), d=X.replace_first(lit("t"), lit(""), "x"))
    assert r == dict(a="x a.b", b="plan pro", c="t", d="t")


def test_set_and_bag_scores(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    r = one(spark, a=S.set_f1(arr("x"), arr("x", "y")), b=S.set_f1(arr(), arr()), c=S.bag_overlap(arr("a", "a", "b"), arr("a", "a", "a")), d=S.bag_f1(arr("a", "b"), arr("a", "b")), e=S.concision(lit(64)), f=S.schema_points(lit(1), lit(2), lit(9)))
    assert abs(r["a"] - 2 / 3) < 1e-12 and r["b"] == 0 and r["c"] == 2 and r["d"] == 1 and r["e"] == 0.5 and r["f"] == 0


def test_failure_mode_order(spark):
    t, f, z, n = lit(True), lit(False), lit(0), lit(8)
    r = one(spark, a=S.failure_mode(f, f, z, z, n, lit(1.0)), b=S.failure_mode(t, f, z, z, n, lit(1.0)), c=S.failure_mode(t, t, lit(1), lit(1), n, lit(1.0)), d=S.failure_mode(t, t, z, lit(1), n, lit(1.0)), e=S.failure_mode(t, t, z, z, n, lit(0.0)), g=S.failure_mode(t, t, z, z, n, lit(1.0)))
    assert list(r.values()) == ["parse_failure", "schema_failure", "hallucinated_keys", "null_handling_mistake", "semantic_mismatch", "clean"]


GOOD = {"summary": "s", "issue_category": "billing", "priority": "low", "product_area": "api", "customer": {"name": " ", "account_id": "A", "plan_tier": None}, "sentiment": "neutral", "requires_human_followup": True, "actions_requested": None}


def test_json_recovery():
    assert udfs.parse_text('{"a": 1}') == ('{"a": 1}', None, False)
    assert udfs.parse_text('```json\n{"a": 1}\n```')[2] is False
    assert udfs.parse_text('Sure: {"a": "}"} ok') == ('{"a": "}"}', None, True)
    assert udfs.parse_text("no")[1] == "no_json_object"
    assert udfs.parse_text("[1]")[0] is None
    assert udfs.parse_text(None)[0] is None


def test_validation_rules():
    ok, normal, *_ = udfs.validate(json.dumps(GOOD))
    assert ok and json.loads(normal)["customer"] == {"name": None, "account_id": "A", "plan_tier": None} and json.loads(normal)["actions_requested"] == []
    assert udfs.validate(json.dumps({k: v for k, v in GOOD.items() if k != "summary"}))[3] == ["summary"]
    bad = udfs.validate(json.dumps({**GOOD, "priority": "asap", "customer": {"email": "x"}}))
    assert not bad[0] and {"path": "priority", "issue_type": "enum"} in bad[2] and bad[4] == ["customer.email"]
    assert not udfs.validate(json.dumps({**GOOD, "requires_human_followup": 1}))[0]
    assert not udfs.validate(json.dumps({**GOOD, "actions_requested": [" "]}))[0]
    assert not udfs.validate("[]")[0] and not udfs.validate(None)[0]


def test_udfs_in_spark(spark):
    df = spark.createDataFrame([(json.dumps(GOOD), "x"), (None, "y"), ("nope", None)], "t string, u string")
    rows = df.select(udfs.parse_output("t").alias("p"), udfs.validate_payload("t").alias("v"), udfs.sequence_ratio("t", "u").alias("r"), udfs.canonical_json("t").alias("c")).collect()
    assert [r["v"]["is_valid"] for r in rows] == [True, False, False] and rows[1]["r"] is None and rows[0]["c"].startswith('{\n  "actions_requested": null')
