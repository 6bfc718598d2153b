"""Queries of scans, sinks, projections, scalar functions, manifests, reports and streams, each with SQL that says the same where SQL can.

Sinks and scans write into the shared folder and read what they wrote, so their SQL is that of the rows that went in.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalogue import (
    _PRF_SQL, _RANK_SQL, NULLABLE_FIELDS, RECORDS_SQL, SCORED_SQL, SYSTEM, USER, _bucketed, _first, _gated, _LEN, _q, _ranked, _requests, _with, candidates, predictions, query, records, rules_sql, scored,
)
from .functions import text as X
from .functions import udfs
from .operators import augment, evaluate, generate, manifests, preference, profile, promptsets, report, sampling, serving
from .schema import DOMAINS, TARGET, TOP_KEYS, json_schema
from .session import table
from .sources import adapters, readers, registry, sinks
from .storage import is_folder, scratch
from .streaming import requests as stream

_TRIM = lambda c: f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"

# Text functions.


@query(f"WITH {RECORDS_SQL} SELECT record_id, t.customer.name AS name FROM rec WHERE regexp_full_match(t.customer.name, '[A-Z][a-z]+ [A-Z][a-z]+')")
def name_from_email(spark, d):
    """The names of customers, read from addresses made of them."""
    df = records(spark, d).where(F.col("target.customer.name").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$"))
    address = F.concat(F.lit(" "), F.lower(F.replace("target.customer.name", F.lit(" "), F.lit("._"))), F.lit("@mail.example"))
    return df.select("record_id", X.name_from_email(address).alias("name"))


@query(f"WITH {RECORDS_SQL} SELECT record_id, left(regexp_replace(coalesce(nullif({_TRIM('t.summary')}, ''), nullif({_TRIM('input_text')}, ''), '{X.SUMMARY_FALLBACK}'), '\\s+', ' ', 'g'), {X.SUMMARY_LENGTH}) AS line FROM rec")
def summary_line(spark, d):
    return records(spark, d).select("record_id", X.summary_line(F.col("target.summary"), F.col("input_text")).alias("line"))


@query("SELECT doc_id, 'doc-' || left(sha1(text), 10) AS stable_id, left(text, 240) AS excerpt FROM documents WHERE text IS NOT NULL")
def stable_ids(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.stable_id("doc", F.col("text")).alias("stable_id"), X.excerpt(F.col("text")).alias("excerpt"))


@query("""WITH h AS (SELECT lower(trim(coalesce(split, ''))) AS h FROM support_tickets) SELECT CASE WHEN h IN ('train', 'training') THEN 'train'
WHEN h IN ('eval', 'evaluation', 'test', 'validation') THEN 'eval' END AS split, count(*) AS rows FROM h GROUP BY 1""")
def split_hints(spark, d):
    return table(spark, d, "support_tickets").groupBy(X.split_hint(F.col("split")).alias("split")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT record_id, {_TRIM("regexp_replace(t.summary, '\\s+', ' ', 'g')")} AS f FROM rec WHERE t.summary IS NOT NULL),
p AS (SELECT record_id, f, list_filter(list_transform(string_split(f, '.'), lambda x: trim(x)), lambda x: x <> '') AS p FROM s) SELECT record_id, greatest(len(p), 1)::INT AS sentences, coalesce(p[1], f) AS first FROM p""")
def sentence_split(spark, d):
    s = X.sentences(F.col("target.summary"))
    return records(spark, d).where("target.summary is not null").select("record_id", F.size(s).alias("sentences"), F.element_at(s, 1).alias("first"))


@query("SELECT DISTINCT source, replace(replace(replace(source, '/', '_'), ' ', '_'), ':', '_') AS slug FROM documents WHERE source IS NOT NULL")
def slugs(spark, d):
    return table(spark, d, "documents").where("source is not null").select("source", X.slug(F.col("source")).alias("slug")).distinct()


@query(f"""WITH {RECORDS_SQL} SELECT record_id, array_to_string(list_filter([t.issue_category, t.priority, array_to_string(t.actions_requested, ' ')], lambda x: x IS NOT NULL AND x <> ''), ' ') AS tags
FROM rec""")
def tags_flatten(spark, d):
    parts = [F.col("target.issue_category"), F.col("target.priority"), F.array_join("target.actions_requested", " ")]
    return records(spark, d).select("record_id", F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]).alias("tags"))


@query("""SELECT DISTINCT record_id, json_extract_string(completion, '$.issue_category') AS issue_category, json_extract_string(completion, '$.summary') AS summary, 1 + len(json_keys(completion)) +
CASE WHEN json_type(completion, '$.customer') = 'OBJECT' THEN len(json_keys(completion, '$.customer')) + 1 ELSE 0 END + CASE
WHEN json_array_length(completion, '$.actions_requested') > 0 THEN json_array_length(completion, '$.actions_requested')::BIGINT + 1 ELSE 0 END + 1 AS lines
FROM support_tickets_sft_prompt_completion WHERE completion IS NOT NULL""")
def canonical_json(spark, d):
    """Payloads as sorted, indented JSON: what they hold, and their number of lines."""
    df = table(spark, d, "support_tickets_sft_prompt_completion").where("completion is not null").select("record_id", udfs.canonical_json("completion").alias("j")).distinct()
    return df.select("record_id", F.get_json_object("j", "$.issue_category").alias("issue_category"), F.get_json_object("j", "$.summary").alias("summary"), F.size(F.split("j", "\n")).cast("long").alias("lines"))


_LOW2 = "lower(array_to_string(list_filter([{0}], lambda x: x <> ''), ' '))"


def _labels_sql(category: str, product: str, issue: str, level: str) -> str:
    """Labels as the target builder reads them, each from its own inputs in its own order."""
    of = lambda *p: _LOW2.format(", ".join(p))
    c, p = rules_sql(of(category, product, issue), X.CATEGORY_WORDS, "other"), rules_sql(of(level, issue, category), X.PRIORITY_WORDS, "medium")
    return f"{c} AS issue_category, {p} AS priority, {rules_sql(of(product, category, issue), X.AREA_WORDS, 'other')} AS product_area, {rules_sql(of(issue, level, category), X.SENTIMENT_WORDS, 'neutral')} AS sentiment"


_T = {"text": _TRIM("input_text"), "level": "coalesce(t.priority, '')", "kind": "coalesce(t.issue_category, '')", "area": "coalesce(t.product_area, '')"}


@query(f"""WITH {RECORDS_SQL}, l AS (SELECT record_id, {_labels_sql(_T['kind'], _T['area'], _T['text'], _T['level'])} FROM rec) SELECT *, issue_category <> 'general_question' OR priority <> 'low' AS requires_human_followup
FROM l""")
def target_builder(spark, d):
    none, of = F.lit(None).cast("string"), lambda c: F.coalesce(F.col(f"target.{c}"), F.lit(""))
    t = X.target_from_text(F.col("target.summary"), X.clean(F.col("input_text")), of("priority"), of("issue_category"), of("product_area"), none, none, none)
    return records(spark, d).withColumn("b", t).select("record_id", *[F.col(f"b.{c}").alias(c) for c in ("issue_category", "priority", "product_area", "sentiment", "requires_human_followup")])


# Adapters: rows of one source as raw rows of each kind.


def _complaint_rows(spark, d):
    t = F.col("target")
    return records(spark, d).where("source_dataset = 'consumer_finance_complaints'").select(
        F.col("record_id").alias("complaint_id"), t["product_area"].alias("product"), F.lit("").alias("sub_product"), t["issue_category"].alias("issue"), F.col("input_text").alias("consumer_complaint_narrative"), F.lit("Closed").alias("company_response_to_consumer")
    )


_C_REC = "(SELECT * FROM rec WHERE source = 'consumer_finance_complaints')"
_C_CAT = f"array_to_string(list_filter([{_T['area']}, {_T['kind']}], lambda x: x <> ''), ' ')"


@query(f"""WITH {RECORDS_SQL} SELECT record_id, CASE WHEN {_T['text']} = '' THEN 'missing_consumer_complaint_narrative' END AS reason, left(coalesce(nullif({_T['area']}, ''), 'Consumer complaint') || ': ' || coalesce(nullif({_T['kind']}, ''), 'reported issue'), 140) AS summary, {_labels_sql(_C_CAT, _T['area'], _T['text'], "''")}, true AS requires_human_followup
FROM {_C_REC}""")
def adapter_complaints(spark, d):
    out = adapters.complaints(_complaint_rows(spark, d))
    return out.select("record_id", "reason", *[F.col(f"target.{c}").alias(c) for c in ("summary", "issue_category", "priority", "product_area", "sentiment", "requires_human_followup")])


@query(f"""WITH {RECORDS_SQL}, x AS (SELECT *, {_TRIM("t.summary")} AS subject, {_T['text']} AS body FROM rec WHERE source = 'internal_it_helpdesk_tickets'), y AS (SELECT *, CASE WHEN subject <> '' THEN 'Subject: ' || subject || chr(10) || chr(10) || body ELSE body END AS whole FROM x)
SELECT record_id, CASE WHEN body = '' THEN 'missing_description' END AS reason, md5(whole) AS digest, {_labels_sql(_T['kind'], "''", 'whole', _T['level'])} FROM y""")
def adapter_helpdesk(spark, d):
    rec = records(spark, d).where("source_dataset = 'internal_it_helpdesk_tickets'")
    raw = rec.select(F.col("record_id").alias("ticket_id"), F.col("target.summary").alias("subject"), F.col("input_text").alias("description"), F.col("target.priority").alias("priority"), F.col("target.issue_category").alias("category"))
    return adapters.helpdesk(raw).select("record_id", "reason", F.md5("input_text").alias("digest"), *[F.col(f"target.{c}").alias(c) for c in ("issue_category", "priority", "product_area", "sentiment")])


_DOMAIN = "t.issue_category IN ('billing', 'account_access', 'technical_bug', 'feature_request', 'integration', 'general_question', 'other') AND t.priority IN ('low', 'medium', 'high', 'urgent') AND t.sentiment IN ('negative', 'neutral', 'positive', 'mixed')"
_DOMAIN += " AND t.product_area IN ('web_app', 'mobile_app', 'api', 'billing_portal', 'account_portal', 'integrations', 'other', 'unknown') AND coalesce(t.customer.plan_tier, 'free') IN ('free', 'pro', 'business', 'enterprise') AND t.requires_human_followup IS NOT NULL AND trim(coalesce(t.summary, '')) <> '' AND t.customer IS NOT NULL"


@query(f"""WITH {RECORDS_SQL}, v AS (SELECT coalesce({_DOMAIN} AND len(list_filter(coalesce(t.actions_requested, []), lambda x: trim(coalesce(x, '')) = '')) = 0, false) AS ok, t IS NULL AS none, {_T['text']} AS text FROM rec)
SELECT CASE WHEN text = '' OR none THEN 'missing_text_or_output' WHEN NOT ok THEN 'schema_violation' END AS reason, count(*) AS rows FROM v GROUP BY 1""")
def adapter_discipline(spark, d):
    raw = records(spark, d).select("record_id", F.col("input_text").alias("text"), F.to_json("target", {"ignoreNullFields": "false"}).alias("output"))
    return adapters.schema_discipline(raw).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


# Messages, prompts and the exchange format.

_EVAL = "(SELECT DISTINCT record_id, prompt, messages, input_text, reference_json FROM support_tickets_eval_manifest WHERE record_id IS NOT NULL)"


def _manifest(spark, d):
    return table(spark, d, "support_tickets_eval_manifest").where("record_id is not null").select("record_id", "prompt", "messages", "input_text", "reference_json").distinct()


@query(f"""SELECT record_id, len(messages) >= 2 AND messages[-1].role = 'assistant' AS talk, CASE WHEN len(messages) >= 2 AND messages[-1].role = 'assistant' THEN len(messages) - 1 END::INT AS turns, md5(CASE
WHEN len(messages) >= 2 AND messages[-1].role = 'assistant' THEN messages[-1].content END) AS digest FROM {_EVAL} WHERE messages IS NOT NULL""")
def conversations(spark, d):
    m = F.col("messages")
    talk = _manifest(spark, d).where("messages is not null").withColumn("ok", (F.size(m) >= 2) & (F.try_element_at(m, F.lit(-1))["role"] == "assistant")).withColumn("c", X.conversation(m))
    return talk.select("record_id", F.col("ok").alias("talk"), F.when(F.col("c").isNotNull(), F.size("c.prompt")).alias("turns"), F.md5(F.element_at("c.completion", 1)["content"]).alias("digest"))


@query(f"SELECT record_id, md5(CASE WHEN regexp_matches(coalesce(prompt, ''), '\\S') THEN prompt WHEN messages IS NOT NULL THEN array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), chr(10)) ELSE coalesce(input_text, '') END) AS digest FROM {_EVAL}")
def prompt_text_pick(spark, d):
    df = _manifest(spark, d)
    return df.select("record_id", F.md5(manifests.prompt_text(df)).alias("digest"))


@query(f"""SELECT record_id, md5(CASE hash_ WHEN 0 THEN prompt WHEN 1 THEN array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), chr(10)) ELSE coalesce(input_text, '') END) AS digest
FROM (SELECT *, ('0x' || substr(md5(record_id), 1, 2))::INT % 3 AS hash_ FROM {_EVAL}) WHERE prompt IS NOT NULL AND messages IS NOT NULL""")
def prompt_text_fallbacks(spark, d):
    """The same pick over rows of which a third have no prompt and a third neither prompt nor messages."""
    at = F.conv(F.substring(F.md5("record_id"), 1, 2), 16, 10).cast("int") % 3
    df = _manifest(spark, d).where("prompt is not null and messages is not null").withColumn("prompt", F.when(at == 0, F.col("prompt")).when(at == 1, F.lit(" \n"))).withColumn("messages", F.when(at < 2, F.col("messages")))
    return df.select("record_id", F.md5(manifests.prompt_text(df)).alias("digest"))


@query(f"SELECT record_id, i::INT AS candidate_index, (40 + i)::INT AS seed, md5(prompt) AS digest, len(messages)::INT AS turns FROM {_EVAL}, range(4) r(i)")
def inference_requests(spark, d):
    df = manifests.requests(_manifest(spark, d), 4, 40, "messages")
    return df.select("record_id", "candidate_index", "seed", F.md5("prompt").alias("digest"), F.when(F.col("messages").isNotNull(), F.size("messages")).alias("turns"))


@query(f"WITH {RECORDS_SQL} SELECT record_id, md5('{_q(USER)}' || {_T['text']}) AS input, md5('{_q(SYSTEM)}') AS system, t.issue_category AS issue_category, t.customer.name AS name FROM rec")
def exchange_format(spark, d):
    out = manifests.to_exchange(records(spark, d))
    return out.select("record_id", F.md5("input").alias("input"), F.md5("system").alias("system"), F.get_json_object("output", "$.issue_category").alias("issue_category"), F.get_json_object("output", "$.customer.name").alias("name"))


@query(f"""WITH {RECORDS_SQL}, v AS (SELECT *, coalesce({_DOMAIN} AND len(list_filter(coalesce(t.actions_requested, []), lambda x: trim(coalesce(x, '')) = '')) = 0, false) AS ok FROM rec)
SELECT record_id, md5('{_q(USER)}' || {_T['text']}) AS digest, CASE WHEN NOT ok THEN 'invalid_target' END AS reason, CASE WHEN ok THEN t.priority END AS priority, '{_q(SYSTEM)}' IS NOT NULL AS kept FROM v""")
def exchange_roundtrip(spark, d):
    back = manifests.from_exchange(manifests.to_exchange(records(spark, d)))
    return back.select("record_id", F.md5("input_text").alias("digest"), "reason", F.col("target.priority").alias("priority"), (F.col("metadata")["source_system"] == X.SYSTEM_TEXT).alias("kept"))


@query(f"""WITH {RECORDS_SQL} SELECT record_id, md5('{_q(SYSTEM)}' || chr(10) || chr(10) || '{_q(USER)}' || {_T['text']} || chr(10)) AS digest, t.issue_category AS issue_category, 'todo' AS labeling_status, true AS waits
FROM rec""")
def preference_placeholders(spark, d):
    out = manifests.preference_placeholders(records(spark, d))
    return out.select("record_id", F.md5("prompt").alias("digest"), F.get_json_object("reference_completion", "$.issue_category").alias("issue_category"), "labeling_status", (F.col("chosen").isNull() & F.col("rejected").isNull()).alias("waits"))


@query(f"""WITH {RECORDS_SQL} SELECT record_id, split, md5('{_q(SYSTEM)}' || chr(10) || chr(10) || '{_q(USER)}' || {_T['text']} || chr(10)) AS prompt, md5('{_q(USER)}' || {_T['text']}) AS user_turn, 2 AS turns, t.sentiment AS sentiment
FROM rec WHERE split = 'eval'""")
def eval_projection(spark, d):
    rec = manifests.split_rows(records(spark, d).withColumn("metadata", F.lit(None)), "eval")
    out = sinks.eval_manifest(rec)
    return out.select("record_id", "split", F.md5("prompt").alias("prompt"), F.md5(F.element_at("messages", 2)["content"]).alias("user_turn"), F.size("messages").alias("turns"), F.get_json_object("reference_json", "$.sentiment").alias("sentiment"))


# Manifests.

_HASHED = "row_number() OVER (ORDER BY substr(sha256('17:' || record_id), 1, 16), record_id)"


@query(f"""WITH r AS (SELECT record_id, coalesce(any_value(prompt), '') AS prompt, coalesce(any_value(completion), '') AS completion FROM support_tickets_sft_prompt_completion GROUP BY record_id),
k AS (SELECT *, {_HASHED} AS i, count(*) OVER () AS n FROM r) SELECT record_id, md5(prompt) AS prompt, md5(completion) AS completion FROM k WHERE i <= greatest(1, floor(n * 0.25))""")
def training_manifest(spark, d):
    """A quarter of the training rows in hash order, missing completions as empty texts."""
    rows = table(spark, d, "support_tickets_sft_prompt_completion").groupBy("record_id").agg(F.any_value("prompt", True).alias("prompt"), F.any_value("completion", True).alias("completion"))
    return manifests.training_rows(rows, "prompt_completion", percent=0.25).select("record_id", F.md5("prompt").alias("prompt"), F.md5("completion").alias("completion"))


@query(f"SELECT record_id, md5(coalesce(prompt, '')) AS prompt, md5(coalesce(reference_json, '')) AS completion FROM {_EVAL}")
def eval_training_manifest(spark, d):
    rows = manifests.training_rows(_manifest(spark, d), "prompt_completion", held_out=True)
    return rows.select("record_id", F.md5("prompt").alias("prompt"), F.md5("completion").alias("completion"))


@query(f"""SELECT CASE WHEN named THEN record_id ELSE 'eval-' || row_number() OVER (ORDER BY record_id, md5(coalesce(prompt, ''))) END AS record_id,
CASE WHEN len(messages) >= 2 AND messages[-1].role = 'assistant' THEN len(messages) - 1 END::INT AS turns FROM (SELECT *, ('0x' || substr(md5(record_id), 1, 1))::INT % 2 = 0 AS named
FROM {_EVAL})""")
def messages_manifest(spark, d):
    """Rows in messages shape of which half have lost their id and are named by their place."""
    keep = F.conv(F.substring(F.md5("record_id"), 1, 1), 16, 10).cast("int") % 2 == 0
    df = _manifest(spark, d).withColumns({"o": F.col("record_id"), "p": F.md5(F.coalesce("prompt", F.lit("")))}).withColumn("record_id", F.when(keep, F.col("record_id")))
    return manifests.training_rows(df, "messages", held_out=True, order=["o", "p"]).select("record_id", F.when(F.col("prompt").isNotNull(), F.size("prompt")).alias("turns"))


@query(f"SELECT record_id FROM (SELECT DISTINCT record_id FROM {_EVAL}) ORDER BY record_id LIMIT 25")
def eval_manifest_head(spark, d):
    """The first rows of the evaluation manifest by id."""
    return sampling.first_n(_manifest(spark, d).select("record_id").distinct(), ["record_id"], 25)


@query(f"""WITH {RECORDS_SQL}, k AS (SELECT record_id, {_HASHED} AS i, count(*) OVER () AS n FROM rec WHERE split = 'train') SELECT record_id FROM k WHERE i <= greatest(1, floor(n * 0.1))""")
def preference_source(spark, d):
    return manifests.split_rows(records(spark, d), "train", percent=0.1).select("record_id")


@query(f"""WITH {_RANK_SQL} SELECT record_id, md5(c.raw_output) AS chosen, md5(r.raw_output) AS rejected FROM sk JOIN rk c USING (record_id)
JOIN rk r USING (record_id) WHERE skip_reason IS NULL AND c.rank = 1 AND r.candidate_index = ri AND c.raw_output <> '' AND r.raw_output <> ''""")
def preference_manifest(spark, d):
    live = _gated(spark, d).where("skip_reason is null").join(records(spark, d).select("record_id", X.prompt(F.col("input_text")).alias("prompt")), "record_id")
    none = F.lit(None).cast("string")
    pairs = live.select("record_id", F.concat_ws("\n", "record_id", "prompt").alias("prompt"), preference.completion_text(none, F.col("chosen.text_key")).alias("chosen"), preference.completion_text(none, F.col("rejected.text_key")).alias("rejected"))
    return manifests.preference_rows(pairs, strict=False).select(F.substring_index("prompt", "\n", 1).alias("record_id"), F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


# The preference run.


@query(f"""WITH {_RANK_SQL}, a AS (SELECT record_id, count(*) AS distinct_candidates, count_if(parses) AS parseable_json_count, count_if(valid) AS schema_valid_count, string_agg(failure_mode, ',' ORDER BY rank) AS modes FROM rk GROUP BY 1),
g AS (SELECT record_id, count(*) AS generated FROM scored GROUP BY 1)
SELECT record_id, generated, distinct_candidates, parseable_json_count, schema_valid_count, modes, CASE WHEN skip_reason IS NULL THEN ci END AS chosen_index, CASE WHEN skip_reason IS NULL THEN ri END AS rejected_index, skip_reason,
CASE WHEN skip_reason IS NULL THEN round(gap, 6) END AS gap, CASE WHEN skip_reason IS NOT NULL THEN 'Skipped because ' || replace(skip_reason, '_', ' ') || '.' END AS why FROM a JOIN g USING (record_id) JOIN sk USING (record_id)""")
def preference_audit(spark, d):
    made = candidates(spark, d).groupBy("record_id").agg(F.count(F.lit(1)).alias("generated"))
    rows = preference.audit(_ranked(spark, d), _gated(spark, d), made)
    return rows.select(
        "record_id", "generated", "distinct_candidates", "parseable_json_count", "schema_valid_count", F.array_join("dominant_failure_modes", ",").alias("modes"), "chosen_index", "rejected_index", "skip_reason",
        F.round("score_gap.numeric_score_gap", 6).alias("gap"), F.when(F.col("skip_reason").isNotNull(), F.col("decision_rationale")).alias("why"),
    )


_R = lambda a, b: f"round(coalesce(({a}) / nullif({b}, 0), 0.0), 6)"


@query(f"""WITH {_RANK_SQL}, s1 AS (SELECT sk.*, r.valid AS rv FROM sk LEFT JOIN rk r ON sk.record_id = r.record_id AND r.candidate_index = sk.ri), s2 AS (SELECT 'overall' AS scope, * FROM s1 UNION ALL SELECT source, * FROM s1), made AS (SELECT 'overall' AS scope, * FROM scored UNION ALL SELECT source, * FROM scored),
p AS (SELECT scope, count(*) AS rows, count_if(skip_reason IS NULL) AS pairs, count_if(skip_reason IS NULL AND cv) AS cvn, count_if(skip_reason IS NULL AND rv) AS rvn FROM s2 GROUP BY 1), c AS (SELECT scope, count(*) AS candidates, count_if(parses) AS pn, count_if(valid) AS vn FROM made GROUP BY 1)
SELECT scope, rows, pairs, {_R('pairs', 'rows')} AS emission_rate, rows - pairs AS skipped, {_R('cvn', 'pairs')} AS chosen_valid_rate, {_R('rvn', 'pairs')} AS rejected_valid_rate, candidates, {_R('pn', 'candidates')} AS json_valid_rate, {_R('vn', 'candidates')} AS schema_pass_rate FROM p JOIN c USING (scope)""")
def preference_summary(spark, d):
    return preference.run_summary(candidates(spark, d), _gated(spark, d), "source_dataset")


# Reports.

_MICRO = f"{_PRF_SQL}, mi AS (SELECT stage, f1 AS micro_f1 FROM m WHERE field = 'micro'), ma AS (SELECT stage, round(avg(f1), 6) AS macro_f1 FROM m WHERE field <> 'micro' GROUP BY 1), ra AS (SELECT stage, count(*) AS rows, round(avg(parses::INT), 6) AS json_validity_rate, round(avg(valid::INT), 6) AS schema_pass_rate, round(avg((extra > 0)::INT), 6) AS hallucinated_rate FROM scored GROUP BY 1)"


def _summary(spark, d):
    rows = predictions(spark, d)
    counts = evaluate.field_counts(rows, ["stage"])
    return report.stage_summary(evaluate.rates(rows, ["stage"]), evaluate.prf(counts), evaluate.macro(counts, ["stage"]))


@query(f"""WITH {_MICRO} SELECT stage, round(json_validity_rate, 4) AS json_validity_rate, round(schema_pass_rate, 4) AS schema_pass_rate,
round(hallucinated_rate, 4) AS hallucinated_rate, round(micro_f1, 4) AS micro_f1, round(macro_f1, 4) AS macro_f1 FROM ra JOIN mi USING (stage)
JOIN ma USING (stage)""")
def stage_table(spark, d):
    return report.stage_table(_summary(spark, d)).drop("latency_mean_ms", "latency_p95_ms")


@query(f"WITH {_MICRO} SELECT stage, rows, json_validity_rate, micro_f1, macro_f1 FROM ra JOIN mi USING (stage) JOIN ma USING (stage)")
def stage_summary(spark, d):
    return _summary(spark, d).select("stage", "rows", F.col("syntax.json_validity_rate").alias("json_validity_rate"), F.col("semantic.micro_f1").alias("micro_f1"), F.col("semantic.macro_f1").alias("macro_f1"))


@query("""SELECT build_label, source_dataset, split, coalesce(row_count, 0) AS row_count, coalesce(synthetic_row_count, 0) AS synthetic_row_count,
round(coalesce(synthetic_row_rate, 0.0), 4) AS synthetic_row_rate FROM support_tickets_dataset_composition""")
def composition_table(spark, d):
    df = table(spark, d, "support_tickets_dataset_composition").withColumn("source_dataset", F.struct("build_label", "source_dataset"))
    return report.composition_table(df).select("source_dataset.*", "split", "row_count", "synthetic_row_count", "synthetic_row_rate")


@query(f"""WITH {_MICRO}, b AS (SELECT stage, count(*) AS labels FROM (SELECT stage, unnest(labels) AS l FROM scored) GROUP BY 1), q AS (SELECT stage, count(*) AS n, list_sort(list(len(raw_output))) AS s FROM scored GROUP BY 1)
SELECT stage, rows, macro_f1, micro_f1, labels, s[round_even((n - 1) * 0.5, 0)::BIGINT + 1] AS p50, s[round_even((n - 1) * 0.95, 0)::BIGINT + 1] AS p95 FROM ra JOIN mi USING (stage) JOIN ma USING (stage) JOIN b USING (stage) JOIN q USING (stage)""")
def evaluation_document(spark, d):
    """Everything of an evaluation in one row per stage; the length of the output stands for its latency."""
    df = scored(spark, d).withColumn("ms", F.length("raw_output").cast("long")).select("record_id", "source_dataset", "stage", "parses", "valid", "extra", "p", "r", "ms")
    doc = evaluate.document(df, ["stage"], "ms")
    labels = F.aggregate(F.map_values("buckets"), F.lit(0).cast("long"), lambda a, x: a + x)
    return doc.select("stage", "rows", "macro_f1", F.col("fields")["micro"]["f1"].alias("micro_f1"), labels.alias("labels"), F.col("latency_p50").alias("p50"), F.col("latency_p95").alias("p95"))


_BUCKET_EV = "CASE event_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END"
_P99 = "quantile_disc(value, 0.99) FILTER (success AND b = '{0}')"


@query(f"""WITH e AS (SELECT *, value IS NOT NULL AND event_id % 17 <> 0 AS success, {_BUCKET_EV} AS b FROM events), w AS (SELECT event_type, count(*) AS request_count, quantile_disc(value, 0.99) FILTER (success) AS p99, {_P99.format('short')} AS short_p99_ms, {_P99.format('long')} AS long_p99_ms FROM e GROUP BY 1)
SELECT *, round(short_p99_ms / nullif(long_p99_ms, 0), 6) AS short_to_long_p99_ratio FROM w""")
def experiment_summary(spark, d):
    b = F.when(F.col("event_id") % 3 == 0, "short").when(F.col("event_id") % 3 == 1, "medium").otherwise("long")
    rows = _requests(spark, d).withColumn("bucket_label", b)
    whole, parts = serving.workload_summary(rows, ["event_type"], "value", "success"), serving.workload_summary(rows, ["event_type", "bucket_label"], "value", "success")
    return report.experiment_summary(whole, parts, "event_type").select("event_type", "request_count", "p99", "short_p99_ms", "long_p99_ms", "short_to_long_p99_ratio")


@query("SELECT user_id, count(*) AS failures FROM events WHERE NOT (value IS NOT NULL AND event_id % 17 <> 0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def failures_by_experiment(spark, d):
    return report.failures_by_experiment(_requests(spark, d), "user_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 1")
def best_row(spark, d):
    return report.best_row(table(spark, d, "events").select("event_id", "value"), "value", "event_id")


@query("SELECT kind, median(length(text)) AS median, list_sort(list(length(text)))[floor((count(text) - 1) * 0.9)::BIGINT + 1]::INT AS p90 FROM documents WHERE text IS NOT NULL GROUP BY kind")
def median_and_p90(spark, d):
    return promptsets.median_and_p90(table(spark, d, "documents").where("text is not null and kind is not null").select("kind", F.length("text").alias("n")), ["kind"], "n")


# Serving.


@query(f"""WITH {SCORED_SQL}, s AS (SELECT record_id FROM (SELECT record_id, {_HASHED} AS i FROM rec)), x AS (SELECT * FROM scored WHERE stage = 'dpo')
SELECT count(*) AS sampled, round(avg(parses::INT), 6) AS json_parse_pass_rate, round(avg(valid::INT), 6) AS schema_pass_rate,
round(avg((p_priority = r_priority)::INT), 6) AS priority FROM x JOIN s USING (record_id)""")
def correctness_sample(spark, d):
    rows = predictions(spark, d).where("stage = 'dpo'").withColumn("priority", F.col("p.priority") == F.col("r.priority"))
    return serving.correctness(rows, records(spark, d).select("record_id"), ["priority"])


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, E' \\t\\n\\r'), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, len(w) AS u, 256 - 32 - (len(w) + 40) AS room, greatest(0, 256 - 32 - 96 - 40) AS most FROM w), c AS (SELECT *, CASE WHEN room >= 96 OR u <= most THEN w ELSE list_concat(w[1:floor(most * 0.55)::INT], w[len(w) - (most - floor(most * 0.55)::INT) + 1:]) END AS k FROM b)
SELECT doc_id, len(k)::INT AS kept, md5(array_to_string(k, ' ')) AS digest FROM c""")
def head_tail_cut(spark, d):
    """Texts that do not fit keep their head and tail."""
    w = X.space_tokens(F.col("text"))
    df = table(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w")).withColumn("b", serving.context_budget(F.size("w") + 40, F.size("w"), max_len=256))
    return df.withColumn("k", serving.cut_tokens(F.col("w"), F.col("b"))).select("doc_id", F.size("k").alias("kept"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("SELECT printf('nations-%05d', row_number() OVER (ORDER BY n_name) - 1) AS request_id, n_name FROM nation")
def request_ids(spark, d):
    return serving.request_ids(table(spark, d, "nation").select("n_name"), "nations", "n_name").select("request_id", "n_name")


@query("SELECT floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 512)::BIGINT AS chunk, o_orderkey FROM orders")
def chunking(spark, d):
    return sampling.chunks(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 512).select("chunk", "o_orderkey")


@query("SELECT event_id::DOUBLE AS step, event_id * 32::DOUBLE AS examples_seen, event_id * 32 * 120.5::DOUBLE AS tokens_seen FROM events")
def telemetry(spark, d):
    return promptsets.telemetry(table(spark, d, "events").select(F.col("event_id").cast("double").alias("step")), 8, 4, 120.5)


_LOG = "(SELECT event_id AS step, CASE WHEN event_id % 3 = 0 THEN value END AS loss, CASE WHEN event_id % 3 = 1 THEN value END AS eval_loss, value AS train_loss, CASE WHEN event_id % 2 = 0 THEN value END AS learning_rate FROM events)"


@query(f"""WITH x AS (SELECT step::DOUBLE AS step, coalesce(loss, CASE WHEN eval_loss IS NULL THEN train_loss END) AS loss, eval_loss, learning_rate FROM {_LOG})
SELECT step, 'loss' AS metric, loss AS value FROM x WHERE loss IS NOT NULL UNION ALL SELECT step, 'eval_loss', eval_loss FROM x WHERE eval_loss IS NOT NULL UNION ALL SELECT step, 'learning_rate', learning_rate FROM x WHERE learning_rate IS NOT NULL""")
def training_series(spark, d):
    v, i = F.col("value").cast("string"), F.col("event_id")
    log = table(spark, d, "events").select(i.alias("step"), F.when(i % 3 == 0, v).alias("loss"), F.when(i % 3 == 1, v).alias("eval_loss"), v.alias("train_loss"), F.when(i % 2 == 0, v).alias("learning_rate"))
    return promptsets.training_series(log)


@query(f"""WITH {RECORDS_SQL}, n AS (SELECT record_id, input_text, row_number() OVER (ORDER BY substr(sha256('17:' || record_id), 1, 16), record_id) AS i
FROM rec WHERE input_text IS NOT NULL) SELECT record_id, 'natural' AS length_family FROM n WHERE i <= 200""")
def promptset_natural(spark, d):
    """The natural prompts of a benchmark set, in hash order."""
    return promptsets.promptset(records(spark, d), 200, 50).where("length_family = 'natural'").select("record_id", "length_family")


@query(f"WITH {_LEN} SELECT bucket_label, count(*) AS rows FROM bk WHERE bucket_label = 'short' GROUP BY 1")
def bucket_filter(spark, d):
    return _bucketed(spark, d).where("bucket_label = 'short'").groupBy("bucket_label").agg(F.count(F.lit(1)).alias("rows"))


# Generation.


@query(f"""SELECT record_id, 'other' AS issue_category, true AS schema_is_valid, false AS json_recovery_used, 0 AS missing, 'placeholder' AS backend
FROM (SELECT DISTINCT record_id, source_dataset, input_text, prompt FROM support_tickets_eval_manifest WHERE record_id IS NOT NULL)""")
def prediction_rows(spark, d):
    """Every evaluation row through the placeholder backend, as prediction rows."""
    rows = table(spark, d, "support_tickets_eval_manifest").where("record_id is not null").groupBy("record_id", "source_dataset", "input_text", "prompt").agg(F.any_value("reference_json").alias("reference_payload"), F.lit(17).alias("seed"))
    made = generate.prediction_rows(generate.generated(rows, generate.Placeholder), "baseline", {"backend": "placeholder"})
    return made.select("record_id", F.get_json_object("parsed_payload", "$.issue_category").alias("issue_category"), "schema_is_valid", "json_recovery_used", F.size("missing_fields").alias("missing"), "backend")


# Scans and sinks.


@query("SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def jsonl_roundtrip(spark, d):
    """All documents through the JSON-lines sink and the strict scan."""
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars"), path, ["doc_id"])
    return readers.read_jsonl(spark, path, "doc_id long, text string, lang string, n_chars long").select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query("SELECT count(*) AS lines, count_if(escaped) AS escaped FROM (SELECT regexp_matches(text, '[^\\x00-\\x7f]') OR regexp_matches(coalesce(lang, ''), '[^\\x00-\\x7f]') AS escaped FROM documents)")
def jsonl_is_ascii(spark, d):
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, d, "documents").select("text", "lang"), path)
    lines = spark.read.text(path)
    return lines.agg(F.count_if(~F.col("value").rlike(r"[^\x00-\x7f]")).alias("lines"), F.count_if(F.col("value").rlike(r"\\u00[89a-f]|\\u0[1-9a-f]|\\u[1-9a-f]")).alias("escaped"))


@query("SELECT 'customer' AS kind, c_custkey::VARCHAR AS key, c_name AS name, NULL AS segment_of_part FROM customer UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name, p_brand FROM part")
def csv_union_roundtrip(spark, d):
    """Two tables with different columns through one CSV under the union of their headers."""
    path = scratch(spark, "csv")
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("Segment of-Part"))
    sinks.write_csv_union([a, b], path)
    return readers.read_csv(spark, path).select("kind", "key", "name", F.nullif("segment_of_part", F.lit("")).alias("segment_of_part"))


@query(f"""WITH {RECORDS_SQL} SELECT 'canonical' AS product, count(*) AS rows FROM rec UNION ALL SELECT 'sft_prompt_completion', count_if(split = 'train')
FROM rec UNION ALL SELECT 'sft_messages', count_if(split = 'train') FROM rec UNION ALL SELECT 'eval_manifest', count_if(split = 'eval')
FROM rec""")
def export_products(spark, d):
    """The four products of a build, written and read back."""
    paths = sinks.export(records(spark, d).withColumn("metadata", F.struct("synthetic", "lineage_root_id")), scratch(spark, "export"))
    counts = [(spark.read.parquet(p) if name == "canonical" else spark.read.text(p)).agg(F.lit(name).alias("product"), F.count(F.lit(1)).alias("rows")) for name, p in paths.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def optional_scan(spark, d):
    """Regions through JSON lines, and a file that is not there as no rows."""
    path = scratch(spark, "regions")
    sinks.write_jsonl(table(spark, d, "region").select("r_regionkey", "r_name"), path)
    here, gone = (readers.read_jsonl_or_empty(spark, p, "r_regionkey long, r_name string") for p in (path, path + "-none"))
    return table(spark, d, "nation").join(here.unionByName(gone), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT l_returnflag AS mix_name, count(*) AS rows FROM lineitem GROUP BY 1")
def mix_sink(spark, d):
    """One folder of JSON lines per mix."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mix_name"), F.col("l_orderkey").alias("record_id"))
    paths = sinks.write_mixes(rows, scratch(spark, "mixes"))
    out = None
    for name, p in sorted(paths.items()):
        one = spark.read.text(p).agg(F.lit(name).alias("mix_name"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_linestatus || l_linenumber AS step_id, count(*) AS requests, max(l_quantity)::DOUBLE AS worst FROM lineitem WHERE l_linenumber > 2 GROUP BY 1")
def checkpoint_bundle(spark, d):
    """A run of steps written one document per line and read back as the parts of a bundle; one family of two is searched."""
    df = table(spark, d, "lineitem").groupBy(F.concat("l_linestatus", "l_linenumber").alias("step_id"), F.when(F.col("l_linenumber") > 2, "baseline").otherwise("config_search").alias("experiment_family"))
    steps = df.agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").cast("double").alias("w")).select("step_id", "experiment_family", F.struct(F.col("n").alias("requests"), F.col("w").alias("worst")).alias("summary_row"), F.array(F.struct("n")).alias("raw_rows"))
    path = scratch(spark, "steps")
    sinks.write_jsonl(steps, path)
    read = spark.read.schema("step_id string, experiment_family string, summary_row struct<requests:long,worst:double>, raw_rows array<struct<n:long>>").json(path)
    return readers.bundle_from_steps(read)["summary_rows"].select("step_id", "requests", "worst")


@query("SELECT dataset_name, source_type, source_group, default_inclusion_weight FROM source_registry")
def registry_table(spark, d):
    sources = registry.registry([r.asDict() for r in table(spark, d, "source_registry").collect()])
    return registry.registry_frame(spark, sources).select("dataset_name", "source_type", "source_group", "default_inclusion_weight")


# Streams: the events table as a stream of request-log rows.


def _log(spark, d):
    at, reader = f"{d}/events.parquet", spark.readStream.schema(table(spark, d, "events").schema)
    events = reader.parquet(at) if is_folder(spark, at) else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    ts = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))  # the same instant whatever the session's zone
    ok = F.col("value").isNotNull() & (F.col("event_id") % 17 != 0)
    return events.select(F.col("event_id").cast("string").alias("request_id"), ts.alias("ts"), F.col("event_type").alias("bucket_label"), ok.alias("success"), F.col("value").alias("latency_ms"), (F.col("value") / 4).alias("ttft_ms"))


def _streamed(spark, rows, mode: str):
    """What a stream gives once its input is used up."""
    target, kind = scratch(spark, "stream"), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{target}/{'all' if mode == 'complete' else f'batch={number}'}")

    rows.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(kind).parquet(f"{target}/all" if mode == "complete" else target)


_OK = "(value IS NOT NULL AND event_id % 17 <> 0)"
_WINDOWED = f"count(*) AS requests, count_if({_OK}) AS successes, round(avg(value) FILTER ({_OK}), 6) AS mean_ms, round(avg(value / 4) FILTER ({_OK}), 6) AS mean_ttft_ms"


def _shown(df):
    return df.select(F.unix_timestamp("start").alias("begin"), "bucket_label", "requests", "successes", F.round("mean_ms", 6).alias("mean_ms"), F.round("mean_ttft_ms", 6).alias("mean_ttft_ms"))


@query(f"SELECT epoch(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01'))::BIGINT AS begin, event_type AS bucket_label, {_WINDOWED} FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return _shown(_streamed(spark, stream.windowed_latency(_log(spark, d), "1 day", "3650 days"), "complete"))


@query(f"SELECT epoch(time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01'))::BIGINT - k * 43200 AS begin, event_type AS bucket_label, {_WINDOWED} FROM events, range(2) r(k) GROUP BY 1, 2")
def stream_sliding(spark, d):
    return _shown(_streamed(spark, stream.windowed_latency(_log(spark, d), "1 day", "3650 days", slide="12 hours"), "complete"))


@query(f"""WITH o AS (SELECT *, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) > INTERVAL '20 minutes' AS new FROM events), s AS (SELECT *, count_if(coalesce(new, false)) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM o)
SELECT floor(epoch(min(ts)))::BIGINT AS begin, event_type AS bucket_label, {_WINDOWED} FROM s GROUP BY event_type, k""")
def stream_sessions(spark, d):
    return _shown(_streamed(spark, stream.windowed_latency(_log(spark, d), late="3650 days", gap="20 minutes"), "complete"))


@query(f"SELECT event_id::VARCHAR AS request_id, {_OK} AS success FROM events")
def stream_sink(spark, d):
    """Every row of the stream through the idempotent sink."""
    target = scratch(spark, "sink")
    stream.write_once(_log(spark, d).select("request_id", "success"), target, scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).select("request_id", "success")


# More projections and generators.

_DESK = "(SELECT record_id, any_value(input_text) AS input_text FROM rec WHERE source = 'internal_it_helpdesk_tickets' GROUP BY 1)"


@query(f"""WITH {RECORDS_SQL} SELECT record_id, CASE WHEN ('0x' || substr(sha1('internal_it_helpdesk_tickets:' || record_id), 1, 8))::BIGINT % 1000 < 200 THEN 'eval' ELSE 'train' END AS split, dataset_name AS source_dataset, source_group, source_type, adapter_name, license_note,
record_id AS lineage_root_id, 'stable_hash' AS split_origin, false AS synthetic, 'v1' AS mapping_version, true AS hashed, true AS stamped FROM {_DESK}, source_registry WHERE dataset_name = 'internal_it_helpdesk_tickets' AND {_T['text']} <> ''""")
def canonical_projection(spark, d):
    """Accepted rows of one source with their split and provenance."""
    (source,) = [s for s in registry.registry([r.asDict() for r in table(spark, d, "source_registry").collect()]) if s.dataset_name == "internal_it_helpdesk_tickets"]
    raw = records(spark, d).where(F.col("source_dataset") == source.dataset_name).select(F.col("record_id").alias("ticket_id"), F.col("input_text").alias("description"))
    out, m = adapters.canonical(adapters.helpdesk(raw), source, 0.2), "metadata"
    kept = [F.col(f"{m}.{c}").alias(c) for c in ("source_group", "source_type", "adapter_name", "license_note", "lineage_root_id", "split_origin", "synthetic", "mapping_version")]
    hashed, stamped = F.col(f"{m}.raw_hash").rlike("^[0-9a-f]{40}$"), F.col(f"{m}.ingested_at_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}(Z|[+-]\d\d:\d\d)$")
    return out.select("record_id", "split", "source_dataset", *kept, hashed.alias("hashed"), stamped.alias("stamped"))


@query(f"""WITH m AS (SELECT *, list_position(list_transform(messages, lambda x: trim(x.role)), 'assistant') AS a FROM {_EVAL} WHERE messages IS NOT NULL),
h AS (SELECT *, CASE WHEN coalesce(a, 0) > 0 THEN messages[1:a - 1] ELSE messages END AS h FROM m) SELECT record_id, CASE WHEN len(h) > 0 THEN len(h) ELSE 2 END::INT AS turns, md5(CASE WHEN len(h) > 0 THEN h[-1].content ELSE '{_q(USER)}' || {_T['text']} END) AS digest FROM h""")
def request_messages(spark, d):
    """What is sent to a model for every evaluation row: the turns before the assistant, else the rendered ticket."""
    df = _manifest(spark, d).where("messages is not null").withColumn("h", X.request_messages(F.col("messages"), F.col("input_text")))
    return df.select("record_id", F.size("h").alias("turns"), F.md5(F.element_at("h", -1)["content"]).alias("digest"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def zip_join(spark, d):
    """Two halves of a table's columns put together again by their place."""
    from .operators import compare

    df = sampling.chunks(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 1).withColumnRenamed("chunk", "ordinal")
    return compare.zip_join(df.select("ordinal", "o_orderkey", "o_custkey"), df.select("ordinal", "o_totalprice")).drop("ordinal")


_VARIANTS = f"""o AS (SELECT *, row_number() OVER (ORDER BY source || chr(0) || record_id) - 1 AS pos FROM rec WHERE input_text IS NOT NULL AND split = 'train'),
h AS (SELECT *, {_first('input_text', 't.customer.name', augment.STAND_INS['name'])} AS a FROM o), h2 AS (SELECT *, {_first('a', 't.customer.account_id', augment.STAND_INS['account_id'])} AS b FROM h),
h3 AS (SELECT *, CASE WHEN length(t.customer.plan_tier) > 0 AND instr(lower(b), lower(t.customer.plan_tier)) > 0 THEN left(b, instr(lower(b), lower(t.customer.plan_tier)) - 1) || '{augment.STAND_INS['plan_tier']}' || substr(b, instr(lower(b), lower(t.customer.plan_tier)) + length(t.customer.plan_tier)) ELSE b END AS c FROM h2),
k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(augment.KINDS))}) AS k(kp, kind)),
v AS (SELECT *, pos * {len(augment.KINDS)} + kp AS i, kind IN {augment.HIDING} AS hides FROM h3, k WHERE (kind NOT IN {augment.HIDING} OR c <> input_text) AND (kind <> 'correct_null_ticket' OR (t.customer.name IS NULL AND t.customer.account_id IS NULL AND t.customer.plan_tier IS NULL)))"""


def _variants(spark, d, most=None):
    return augment.augmented(records(spark, d).where("split = 'train'"), most)


@query(f"WITH {RECORDS_SQL}, {_VARIANTS} SELECT record_id AS parent_record_id, kind AS augmentation_kind, i AS augmentation_index FROM v ORDER BY i LIMIT 700")
def augment_prefix(spark, d):
    """Generation stops after so many accepted variants; the indices keep the gaps of those that do not apply."""
    return _variants(spark, d, 700).select("parent_record_id", "augmentation_kind", "augmentation_index")


@query(f"""WITH {RECORDS_SQL}, {_VARIANTS} SELECT i AS augmentation_index, CASE WHEN NOT (hides AND a <> input_text) THEN t.customer.name END AS name,
CASE WHEN NOT (hides AND b <> a) THEN t.customer.account_id END AS account_id, CASE WHEN NOT hides THEN t.customer.plan_tier END AS plan_tier, t.issue_category AS issue_category
FROM v""")
def augment_targets(spark, d):
    """What is hidden in a variant's text is null in its target; the rest of the target stays."""
    c = F.col("target.customer")
    return _variants(spark, d).select("augmentation_index", c["name"].alias("name"), c["account_id"].alias("account_id"), c["plan_tier"].alias("plan_tier"), F.col("target.issue_category").alias("issue_category"))


_FIELDS = ", ".join(f"('{k}', {k != 'actions_requested'}, {len(DOMAINS[k]) if k in DOMAINS else 'NULL'})" for k in TOP_KEYS)


@query(f"SELECT * FROM (VALUES {_FIELDS}) AS f(field, required, values_allowed)")
def schema_fields(spark, d):
    """The payload schema as it describes itself."""
    s = json_schema()
    rows = [(k, k in s["required"], len(p["enum"]) if "enum" in p else None) for k, p in s["properties"].items()]
    return spark.createDataFrame(rows, "field string, required boolean, values_allowed int")
