"""The queries of the core on the test tables, each with SQL that says the same where SQL can.

Stage predictions are derived from the canonical records: a share of every field, chosen by hash, is replaced by what the
label rules read in the text, so all stages have whole tables, real errors and an exact SQL counterpart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scores as S
from .functions import text as X
from .functions import udfs
from .operators import augment, compare, evaluate, lineage, preference, profile, sampling, serving
from .operators.lineage import root
from .schema import DOMAINS, LIST_FIELD, NULLABLE_FIELDS, SCALAR_FIELDS, TARGET, TOP_KEYS
from .session import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Stage -> share of replaced fields, of unparsable, invalid and padded outputs, as two hex digits.
STAGES = {"baseline": ("c0", "06", "20", "10"), "sft": ("50", "04", "0c", "06"), "dpo": ("38", "02", "06", "03")}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import row_queries  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import row_queries  # noqa: F401

    return dict(_sql)


def _q(s: str) -> str:
    return s.replace("'", "''")


def rules_sql(x: str, rules, otherwise: str | None) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, '{_q(X.pattern(w))}') THEN '{label}'" for label, w in rules)
    return f"(CASE {cases} ELSE {'NULL' if otherwise is None else repr(otherwise)} END)"


# One row per record.

RECORDS_SQL = """rec AS MATERIALIZED (SELECT record_id, min(split) AS split, min(input_text) AS input_text, any_value(target) AS t, min(metadata.lineage_root_id) AS lineage_root_id, bool_or(metadata.synthetic) AS synthetic,
 min(coalesce(nullif(source_dataset, ''), 'unknown')) AS source FROM support_tickets_canonical WHERE record_id IS NOT NULL GROUP BY record_id)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Distinct canonical records with the columns that repeats agree on, the least of those they do not."""
    df = table(spark, d, "support_tickets_canonical").where("record_id is not null")
    source = F.coalesce(F.nullif(F.col("source_dataset"), F.lit("")), F.lit("unknown"))
    return df.groupBy("record_id").agg(F.min("split").alias("split"), F.min("input_text").alias("input_text"), F.any_value("target", True).alias("target"), F.min("metadata.lineage_root_id").alias("lineage_root_id"), F.bool_or("metadata.synthetic").alias("synthetic"), F.min(source).alias("source_dataset"))


_LOW = "lower(coalesce(input_text, ''))"
_FIELD_SQL = {
    "issue_category": ("t.issue_category", rules_sql(_LOW, X.CATEGORY_WORDS, "other")),
    "priority": ("t.priority", rules_sql(_LOW, X.PRIORITY_WORDS, "medium")),
    "product_area": ("t.product_area", rules_sql(_LOW, X.AREA_WORDS, "other")),
    "sentiment": ("t.sentiment", rules_sql(_LOW, X.SENTIMENT_WORDS, "neutral")),
    "customer.plan_tier": ("t.customer.plan_tier", rules_sql(_LOW, X.PLAN_WORDS, None)),
    "customer.name": ("t.customer.name", "NULL"),
    "customer.account_id": ("t.customer.account_id", "NULL"),
    "requires_human_followup": ("CASE WHEN t.requires_human_followup THEN 'True' WHEN NOT t.requires_human_followup THEN 'False' END", "CASE WHEN t.requires_human_followup THEN 'False' WHEN NOT t.requires_human_followup THEN 'True' END"),
}
_C = evaluate.column
SYSTEM, USER = X.SYSTEM_TEXT, X.USER_TEXT
_hex = lambda stage, what: f"substr(sha1(record_id || ':{stage}:{what}'), 1, 2)"


def _stage_sql(stage: str) -> str:
    swap, unparsed, invalid, padded = STAGES[stage]
    fields = ", ".join(f"{ref} AS r_{_C(f)}, CASE WHEN ok THEN CASE WHEN {_hex(stage, f)} < '{swap}' THEN {rule} ELSE {ref} END END AS p_{_C(f)}" for f, (ref, rule) in _FIELD_SQL.items())
    return f"""SELECT record_id, source, '{stage}' AS stage, ok AS parses, ok AND {_hex(stage, 'schema')} >= '{invalid}' AS valid, CASE WHEN ok AND {_hex(stage, 'extra')} < '{padded}' THEN 1 ELSE 0 END AS extra, {fields},
    coalesce(t.actions_requested, []) AS r_actions, CASE WHEN ok THEN CASE WHEN {_hex(stage, 'actions')} < '{swap}' THEN coalesce(t.actions_requested, [])[2:] ELSE coalesce(t.actions_requested, []) END END AS p_actions,
    coalesce(t.summary, '') AS r_summary, CASE WHEN ok THEN CASE WHEN {_hex(stage, 'summary')} < '{swap}' THEN left(coalesce(t.summary, ''), 60) ELSE coalesce(t.summary, '') END END AS p_summary
    FROM (SELECT *, {_hex(stage, 'parse')} >= '{unparsed}' AS ok FROM rec)"""


_ITEMS = "list_distinct(list_filter(list_transform(coalesce({0}, []), lambda x: trim(coalesce(x, 'None'))), lambda x: x <> ''))"
_RATIO = lambda a, b: f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


def f1_sql(tp: str, fp: str, fn: str) -> str:
    p, r = _RATIO(tp, f"{tp} + {fp}"), _RATIO(tp, f"{tp} + {fn}")
    return _RATIO(f"2 * {p} * {r}", f"{p} + {r}")


_MATCH = " + ".join(f"(p_{_C(f)} IS NOT DISTINCT FROM r_{_C(f)})::INT" for f in SCALAR_FIELDS)
_NULLS = " + ".join(f"(r_{_C(f)} IS NULL AND p_{_C(f)} IS NOT NULL AND p_{_C(f)} <> '')::INT" for f in NULLABLE_FIELDS)
_BAG = "coalesce(list_sum(list_transform(list_distinct(pt), lambda k: least(len(list_filter(pt, lambda x: x = k)), len(list_filter(rt, lambda x: x = k))))), 0)"
STAGES_SQL = f"{RECORDS_SQL}, pred AS MATERIALIZED ({' UNION ALL '.join(_stage_sql(s) for s in STAGES)})"
SCORED_SQL = f"""{STAGES_SQL},
 c1 AS (SELECT *, {_MATCH} AS matches, {_NULLS} AS null_errors, {_ITEMS.format('p_actions')} AS pa, {_ITEMS.format('r_actions')} AS ra, regexp_extract_all(lower(coalesce(p_summary, '')), '[a-z0-9]+') AS pt, regexp_extract_all(lower(coalesce(r_summary, '')), '[a-z0-9]+') AS rt FROM pred),
 c2 AS (SELECT *, len(list_intersect(pa, ra)) AS atp, {_BAG} AS bag, len(pt) AS words, matches < {len(SCALAR_FIELDS)} OR p_actions IS DISTINCT FROM r_actions OR p_summary IS DISTINCT FROM r_summary AS differs FROM c1),
 c3 AS (SELECT *, {f1_sql('atp', '(len(pa) - atp)', '(len(ra) - atp)')} AS actions_f1, {f1_sql('bag', '(words - bag)', '(len(rt) - bag)')} AS summary_f1, CASE WHEN words <= 32 THEN 1.0 ELSE 32.0 / words END AS concise FROM c2),
 scored AS MATERIALIZED (SELECT *, 5.0 * parses::INT + 5.0 * valid::INT - 2.0 * extra + 1.5 * matches + 2.0 * actions_f1 + 1.5 * summary_f1 - 1.5 * null_errors + 0.5 * concise AS numeric_score,
  CASE WHEN NOT parses THEN 'parse_failure' WHEN NOT valid THEN 'schema_failure' WHEN extra > 0 THEN 'hallucinated_keys' WHEN null_errors > 0 THEN 'null_handling_mistake' WHEN matches < {len(SCALAR_FIELDS)} OR actions_f1 < 1.0 THEN 'semantic_mismatch' ELSE 'clean' END AS failure_mode,
  (matches + actions_f1) / 9.0 AS semantic_score, (matches + actions_f1 - null_errors) / 9.0 AS penalised_score, parses::INT * 4 + valid::INT * 2 + (extra = 0)::INT AS syntax, parses AND valid AND extra = 0 AND NOT differs AS exact,
  list_filter([CASE WHEN NOT parses OR NOT valid THEN 'syntax_failures' END, CASE WHEN extra > 0 THEN 'hallucinated_keys' END, CASE WHEN parses AND differs THEN 'semantic_failures' END, CASE WHEN null_errors > 0 THEN 'null_handling_mistakes' END, CASE WHEN atp > 0 AND atp < len(ra) THEN 'partial_action_extraction' END], lambda x: x IS NOT NULL) AS labels,
  coalesce(p_summary, '') || '|' || coalesce(p_issue_category, '') || '|' || coalesce(p_priority, '') AS raw_output FROM c3)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, source_dataset, stage, parses, valid, extra, p, r) of all stages; one scan, then one row per stage."""
    text, t = F.coalesce(F.col("input_text"), F.lit("")), F.col("target")
    ref = evaluate.flat_payload(t)
    rules = {"issue_category": X.issue_category(text), "priority": X.priority(text), "product_area": X.product_area(text), "sentiment": X.sentiment(text), "customer.plan_tier": X.plan_tier(text)}
    followup = F.when(t["requires_human_followup"], "False").when(~t["requires_human_followup"], "True")
    ruled = F.struct(*[rules.get(f, followup if f == "requires_human_followup" else F.lit(None).cast("string")).alias(_C(f)) for f in SCALAR_FIELDS])
    actions, summary = F.coalesce(t["actions_requested"], F.array().cast("array<string>")), F.coalesce(t["summary"], F.lit(""))
    r = F.struct(*[ref[_C(f)].alias(_C(f)) for f in SCALAR_FIELDS], actions.alias(LIST_FIELD), summary.alias("summary"))
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), *[F.lit(v).alias(n) for n, v in zip(("swap", "unparsed", "invalid", "padded"), STAGES[s], strict=True)]) for s in STAGES])
    rows = records(spark, d).select("record_id", "source_dataset", ruled.alias("ruled"), r.alias("r")).select("*", F.inline(stages))
    h = lambda what: F.substring(F.sha1(F.concat(F.col("record_id"), F.lit(":"), F.col("stage"), F.lit(f":{what}"))), 1, 2)
    swapped = lambda what: h(what) < F.col("swap")
    acts = F.col(f"r.{LIST_FIELD}")
    p = F.struct(
        *[F.when(swapped(f), F.col(f"ruled.{_C(f)}")).otherwise(F.col(f"r.{_C(f)}")).alias(_C(f)) for f in SCALAR_FIELDS],
        F.when(swapped("actions"), F.slice(acts, F.lit(2), F.greatest(F.size(acts), F.lit(1)))).otherwise(acts).alias(LIST_FIELD),
        F.when(swapped("summary"), F.left(F.col("r.summary"), F.lit(60))).otherwise(F.col("r.summary")).alias("summary"),
    )
    rows = rows.withColumn("parses", h("parse") >= F.col("unparsed"))
    return rows.select("record_id", "source_dataset", "stage", "parses", (F.col("parses") & (h("schema") >= F.col("invalid"))).alias("valid"), F.when(F.col("parses") & (h("extra") < F.col("padded")), 1).otherwise(0).alias("extra"), F.when(F.col("parses"), p).alias("p"), "r")


def scored(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.scored(predictions(spark, d))
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return s.withColumn("raw_output", F.concat(part("p.summary"), F.lit("|"), part("p.issue_category"), F.lit("|"), part("p.priority")))


def _with(sql: str, ctes: str = "") -> str:
    return f"WITH {ctes or SCORED_SQL} {sql}"


# Building a dataset.


@query(f"WITH {RECORDS_SQL} SELECT record_id, CASE WHEN ('0x' || substr(sha1(concat_ws(':', source, record_id)), 1, 8))::BIGINT % 1000 < 150 THEN 'eval' ELSE 'train' END AS split FROM rec")
def split_assignment(spark, d):
    return records(spark, d).select("record_id", X.hash_split(F.col("source_dataset"), F.col("record_id")).alias("split"))


@query(f"""WITH {RECORDS_SQL}, v AS (SELECT *, t.issue_category AS c, t.priority AS p FROM rec),
m AS (SELECT source, split, string_agg(c || '=' || n, ',' ORDER BY c) AS categories FROM (SELECT source, split, c, count(*) AS n FROM v WHERE c IS NOT NULL GROUP BY ALL) GROUP BY ALL),
m2 AS (SELECT source, split, string_agg(p || '=' || n, ',' ORDER BY p) AS priorities FROM (SELECT source, split, p, count(*) AS n FROM v WHERE p IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT source AS source_dataset, split, count(*) AS row_count, count_if(synthetic) AS synthetic_row_count, round(count_if(synthetic) / count(*), 4) AS synthetic_row_rate, any_value(categories) AS categories, any_value(priorities) AS priorities
FROM v LEFT JOIN m USING (source, split) LEFT JOIN m2 USING (source, split) GROUP BY source, split""")
def split_composition(spark, d):
    df = records(spark, d).select("source_dataset", "split", "synthetic", F.col("target.issue_category").alias("c"), F.col("target.priority").alias("p"))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    out = profile.composition(df, ["source_dataset", "split"], "synthetic", {"c": "categories", "p": "priorities"})
    return out.withColumns({"categories": shown(F.col("categories")), "priorities": shown(F.col("priorities"))})


@query(f"""WITH {RECORDS_SQL} SELECT 'split' AS field, split AS value, count(*) AS rows FROM rec GROUP BY split UNION ALL SELECT 'source_dataset', source, count(*) FROM rec GROUP BY source
UNION ALL SELECT 'issue_category', t.issue_category, count(*) FROM rec GROUP BY t.issue_category UNION ALL SELECT 'sentiment', t.sentiment, count(*) FROM rec GROUP BY t.sentiment""")
def source_value_counts(spark, d):
    df = records(spark, d).select("split", "source_dataset", F.col("target.issue_category").alias("issue_category"), F.col("target.sentiment").alias("sentiment"))
    return profile.value_counts(df, ["split", "source_dataset", "issue_category", "sentiment"])


@query("SELECT source, count(*) AS row_count, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY source")
def source_share(spark, d):
    return profile.share_of_total(table(spark, d, "documents"), "source")


@query("""SELECT kind, count(length(text)) AS n, coalesce(min(length(text)), 0) AS least, coalesce(max(length(text)), 0) AS most, coalesce(round(avg(length(text)), 2), 0.0) AS mean, coalesce(sum(length(text)), 0)::BIGINT AS total
FROM documents GROUP BY kind""")
def length_stats(spark, d):
    return profile.length_stats(table(spark, d, "documents"), ["kind"], F.length("text"))


@query(f"""SELECT doc_id, {rules_sql("lower(text)", X.CATEGORY_WORDS, "other")} AS issue_category, {rules_sql("lower(text)", X.AREA_WORDS, "other")} AS product_area, {rules_sql("lower(text)", X.SENTIMENT_WORDS, "neutral")} AS sentiment,
{rules_sql("lower(text)", X.PRIORITY_WORDS, "medium")} AS priority, {rules_sql("lower(text)", X.PLAN_WORDS, None)} AS plan_tier FROM documents WHERE text IS NOT NULL""")
def text_labels(spark, d):
    df, t = table(spark, d, "documents").where("text is not null"), F.col("text")
    return df.select("doc_id", X.issue_category(t).alias("issue_category"), X.product_area(t).alias("product_area"), X.sentiment(t).alias("sentiment"), X.priority(t).alias("priority"), X.plan_tier(t).alias("plan_tier"))


@query(f"SELECT {rules_sql('lower(o_orderpriority)', X.PRIORITY_WORDS, 'medium')} AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def priority_normalised(spark, d):
    return table(spark, d, "orders").groupBy(X.priority(F.col("o_orderpriority")).alias("priority")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT round(coalesce(avg((t.customer.name IS NULL)::INT), 0), 4) AS "customer.name", round(coalesce(avg((t.customer.account_id IS NULL)::INT), 0), 4) AS "customer.account_id", round(coalesce(avg((t.customer.plan_tier IS NULL)::INT), 0), 4) AS "customer.plan_tier",
round(coalesce(avg((lineage_root_id IS NULL)::INT), 0), 4) AS lineage_root_id FROM rec) UNPIVOT r ON COLUMNS(*) INTO NAME field VALUE null_rate""")
def null_rates(spark, d):
    df = records(spark, d)
    return profile.null_rates(df, {**{f: F.col(f"target.{f}") for f in NULLABLE_FIELDS}, "lineage_root_id": F.col("lineage_root_id")})


_REASON_SQL = "CASE WHEN trim(coalesce(input_text, '')) = '' THEN 'missing_text' WHEN record_id IS NULL THEN 'missing_id' WHEN t.summary IS NULL THEN 'missing_summary' END"


@query(f"WITH {RECORDS_SQL} SELECT coalesce({_REASON_SQL}, 'accepted') AS reason, source AS source_dataset, count(*) AS rows FROM rec GROUP BY ALL")
def reject_sideoutput(spark, d):
    reason = F.when(F.trim(F.coalesce("input_text", F.lit(""))) == "", "missing_text").when(F.col("record_id").isNull(), "missing_id").when(F.col("target.summary").isNull(), "missing_summary")
    df = records(spark, d).withColumn("reason", reason)
    ok, bad = df.where("reason is null").select(F.lit("accepted").alias("reason"), "source_dataset"), df.where("reason is not null").select("reason", "source_dataset")
    return ok.unionByName(bad).groupBy("reason", "source_dataset").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {RECORDS_SQL} SELECT source AS source_dataset, count(*) AS rows FROM rec WHERE NOT (split = 'eval' AND coalesce(synthetic, false)) GROUP BY 1")
def enforce_eval_policy(spark, d):
    from .plans.build import eval_policy

    df = records(spark, d).withColumn("metadata", F.struct("synthetic"))
    return eval_policy(df, False).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT dataset_name, default_inclusion_weight * CASE source_group WHEN 'domain_task_data' THEN 1.0 WHEN 'schema_discipline_data' THEN 0.2 ELSE 0.0 END AS weight
FROM source_registry WHERE enabled_by_default AND source_group <> 'schema_discipline_data'""")
def active_sources(spark, d):
    from .sources import registry as R

    sources = R.registry([r.asDict() for r in table(spark, d, "source_registry").collect()])
    groups = {"domain_task_data": 1.0, "schema_discipline_data": 0.2, "synthetic_augmentation_data": 0.0}
    return spark.createDataFrame([(s.dataset_name, R.weight(s, None, groups)) for s in R.active(sources)], "dataset_name string, weight double")


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT source, count(*) AS n, coalesce(any_value(default_inclusion_weight), 1.0) AS w FROM rec LEFT JOIN source_registry ON source = dataset_name GROUP BY source),
k AS (SELECT count(*) // 4 AS target FROM rec), a AS (SELECT *, least(n, greatest(1, round_even(target * w / sum(w) OVER (), 0)))::BIGINT AS q FROM s, k),
b AS (SELECT *, target - sum(q) OVER () AS spare, coalesce(sum(n - q) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM a),
c AS (SELECT *, q + greatest(0, least(n - q, spare - room)) AS q2 FROM b), e AS (SELECT *, sum(q2) OVER () - target AS over, coalesce(sum(q2) OVER (ORDER BY q2 DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM c),
g AS (SELECT source, least(q2 - greatest(0, least(q2, over - held)), greatest(1, floor(target * 0.45))) AS quota FROM e),
r AS (SELECT record_id, source, row_number() OVER (PARTITION BY source ORDER BY substr(sha256('17:' || record_id), 1, 16), record_id) AS i FROM rec) SELECT record_id, source AS source_dataset FROM r JOIN g USING (source) WHERE i <= quota""")
def weighted_quota_sample(spark, d):
    rec = records(spark, d).select("record_id", "source_dataset")
    weights = {r[0]: r[1] for r in table(spark, d, "source_registry").select("dataset_name", "default_inclusion_weight").collect()}
    return sampling.weighted_sample(rec, "source_dataset", "record_id", rec.count() // 4, weights, 0.45, 17)


@query(f"WITH {RECORDS_SQL} SELECT record_id FROM rec ORDER BY substr(sha256('17:' || record_id), 1, 16), record_id LIMIT 20")
def hash_topn_sample(spark, d):
    return sampling.hash_top_n(records(spark, d).select("record_id"), "record_id", 17, 20)


@query(f"""WITH {RECORDS_SQL} SELECT record_id FROM (SELECT record_id, row_number() OVER (ORDER BY substr(sha256('17:' || record_id), 1, 16), record_id) AS i, count(*) OVER () AS n
FROM rec) WHERE i <= greatest(1, floor(n * 0.3))""")
def exact_percent_subset(spark, d):
    return sampling.percent_subset(records(spark, d).select("record_id"), "record_id", 0.3)


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT record_id, coalesce(synthetic, false) AS synthetic FROM rec), k AS (SELECT floor(count_if(NOT synthetic) * 0.2::DOUBLE / 0.8::DOUBLE) AS most FROM r),
s AS (SELECT record_id, row_number() OVER (ORDER BY substr(sha256('217:' || record_id), 1, 16), record_id) AS i FROM r WHERE synthetic) SELECT record_id, false AS synthetic FROM r WHERE NOT synthetic UNION ALL SELECT record_id, true FROM s, k WHERE i <= most""")
def synthetic_cap(spark, d):
    return sampling.cap_synthetic(records(spark, d).select("record_id", F.coalesce("synthetic", F.lit(False)).alias("synthetic")), "synthetic", "record_id", 0.2, 217)


_first = lambda text, found, by: f"CASE WHEN length({found}) > 0 AND instr({text}, {found}) > 0 THEN left({text}, instr({text}, {found}) - 1) || '{by}' || substr({text}, instr({text}, {found}) + length({found})) ELSE {text} END"


@query(f"""WITH {RECORDS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY source || chr(0) || record_id) - 1 AS pos FROM rec WHERE input_text IS NOT NULL AND split = 'train'),
h AS (SELECT *, {_first('input_text', 't.customer.name', 'our team')} AS a FROM o), h2 AS (SELECT *, {_first('a', 't.customer.account_id', 'the affected account')} AS b FROM h),
h3 AS (SELECT *, CASE WHEN length(t.customer.plan_tier) > 0 AND instr(lower(b), lower(t.customer.plan_tier)) > 0 THEN left(b, instr(lower(b), lower(t.customer.plan_tier)) - 1) || 'current plan' || substr(b, instr(lower(b), lower(t.customer.plan_tier)) + length(t.customer.plan_tier)) ELSE b END AS c FROM h2),
k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{_q(augment.BEFORE.get(k, ''))}', '{_q(augment.BEHIND[k])}')" for i, k in enumerate(augment.KINDS))}) AS k(kp, kind, pre, post))
SELECT record_id || '__aug_' || CASE WHEN pos * 7 + kp < 1000 THEN lpad((pos * 7 + kp)::VARCHAR, 3, '0') ELSE (pos * 7 + kp)::VARCHAR END AS record_id, record_id AS parent_record_id, kind AS augmentation_kind,
sha1(pre || CASE WHEN kind IN ('missing_field_ticket', 'ambiguous_customer_info_ticket') THEN c ELSE input_text END || chr(10) || chr(10) || post) AS raw_hash
FROM h3, k WHERE (kind NOT IN ('missing_field_ticket', 'ambiguous_customer_info_ticket') OR c <> input_text) AND (kind <> 'correct_null_ticket' OR (t.customer.name IS NULL AND t.customer.account_id IS NULL AND t.customer.plan_tier IS NULL))""")
def augment_fanout(spark, d):
    rows = augment.augmented(records(spark, d).where("split = 'train'"))
    return rows.select("record_id", "parent_record_id", "augmentation_kind", "raw_hash")


_HELD = "held AS (SELECT DISTINCT coalesce(lineage_root_id, record_id) AS root FROM rec WHERE split = 'eval')"


@query(f"WITH {RECORDS_SQL}, {_HELD} SELECT record_id FROM rec WHERE split = 'train' AND coalesce(lineage_root_id, record_id) IN (SELECT root FROM held)")
def lineage_leak_semi(spark, d):
    return lineage.leaked(records(spark, d).select("record_id", "split", "lineage_root_id")).select("record_id")


@query(f"WITH {RECORDS_SQL}, {_HELD} SELECT record_id, split FROM rec WHERE split <> 'train' OR coalesce(lineage_root_id, record_id) NOT IN (SELECT root FROM held)")
def lineage_leak_anti(spark, d):
    return lineage.without_leaks(records(spark, d).select("record_id", "split", "lineage_root_id")).select("record_id", "split")


@query(f"""WITH {RECORDS_SQL}, {_HELD}, bad AS (SELECT record_id FROM rec WHERE split = 'train' AND coalesce(lineage_root_id, record_id) IN (SELECT root
FROM held)) SELECT (SELECT count(*) FROM held) AS eval_root_count, (SELECT count(*) FROM bad) AS leaked_train_row_count, (SELECT string_agg(record_id, ',' ORDER BY record_id)
FROM (SELECT DISTINCT record_id FROM bad ORDER BY 1 LIMIT 10)) AS leaked_examples, (SELECT count(*) = 0 FROM bad) AS is_lineage_clean""")
def lineage_summary(spark, d):
    out = lineage.summary(records(spark, d).select("record_id", "split", "lineage_root_id"))
    return out.withColumn("leaked_examples", F.nullif(F.array_join("leaked_examples", ","), F.lit("")))


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM (SELECT text, doc_id, coalesce(source, '') AS source FROM documents) GROUP BY text")
def dedupe_keep_first(spark, d):
    return profile.keep_first(table(spark, d, "documents").select("text", "doc_id", F.coalesce("source", F.lit("")).alias("source")), ["text"], ["doc_id"])


# Evaluation.


@query(_with("SELECT stage, failure_mode, count(*) AS rows FROM scored GROUP BY ALL"))
def failure_mode(spark, d):
    return scored(spark, d).groupBy("stage", "failure_mode").agg(F.count(F.lit(1)).alias("rows"))


@query(_with("SELECT stage, bucket, count(*) AS rows FROM (SELECT stage, unnest(labels) AS bucket FROM scored) GROUP BY ALL"))
def bucket_labels_explode(spark, d):
    return evaluate.bucket_counts(scored(spark, d), ["stage"])


@query(_with("SELECT stage, record_id, coalesce(labels[1], 'clean') AS primary_bucket FROM scored"))
def primary_bucket(spark, d):
    return scored(spark, d).select("stage", "record_id", F.coalesce(F.try_element_at("labels", F.lit(1)), F.lit("clean")).alias("primary_bucket"))


@query(_with("SELECT stage, count(*) AS failures FROM scored WHERE NOT parses OR NOT valid OR differs GROUP BY 1"))
def failure_rows(spark, d):
    return evaluate.failures(predictions(spark, d)).groupBy("stage").agg(F.count(F.lit(1)).alias("failures"))


_COUNT_SQL = " UNION ALL ".join(f"SELECT stage, '{f}' AS field, (p_{_C(f)} IS NOT DISTINCT FROM r_{_C(f)})::INT AS tp, (p_{_C(f)} IS DISTINCT FROM r_{_C(f)} AND p_{_C(f)} IS NOT NULL)::INT AS fp, (p_{_C(f)} IS DISTINCT FROM r_{_C(f)} AND r_{_C(f)} IS NOT NULL)::INT AS fn FROM scored" for f in SCALAR_FIELDS)
_PRF_SQL = f"""{SCORED_SQL}, u AS ({_COUNT_SQL} UNION ALL SELECT stage, '{LIST_FIELD}', atp, len(pa) - atp, len(ra) - atp FROM scored),
g AS (SELECT stage, coalesce(field, 'micro') AS field, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM u GROUP BY GROUPING SETS ((stage, field), (stage))),
m AS (SELECT *, round({_RATIO('tp', 'tp + fp')}, 6) AS precision, round({_RATIO('tp', 'tp + fn')}, 6) AS recall, round({f1_sql('tp', 'fp', 'fn')}, 6) AS f1, tp + fn AS support FROM g)"""


@query(f"WITH {_PRF_SQL} SELECT * FROM m")
def prf_per_field(spark, d):
    return evaluate.prf(evaluate.field_counts(predictions(spark, d), ["stage"]))


@query(f"WITH {_PRF_SQL} SELECT stage, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM m WHERE field <> 'micro' GROUP BY 1")
def macro_f1(spark, d):
    return evaluate.macro(evaluate.field_counts(predictions(spark, d), ["stage"]), ["stage"])


_EXACT_SQL = ", ".join(f"round(avg((p_{_C(f)} IS NOT DISTINCT FROM r_{_C(f)})::INT), 6) AS exact_{_C(f)}" for f in evaluate.EXACT_FIELDS)


@query(_with(f"""SELECT stage, count(*) AS rows, round(avg(parses::INT), 6) AS json_validity_rate, round(avg(valid::INT), 6) AS schema_pass_rate,
round(avg((extra > 0)::INT), 6) AS hallucinated_rate, {_EXACT_SQL} FROM scored GROUP BY 1"""))
def evaluation_rates(spark, d):
    return evaluate.rates(predictions(spark, d), ["stage"])


_JSON_SIDE = "CASE {0} % 4 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN 'true' ELSE '1' END"


@query(f"""WITH e AS (SELECT event_type, {_JSON_SIDE.format('event_id')} AS a, {_JSON_SIDE.format('(event_id // 4)')} AS b FROM events)
SELECT event_type, coalesce(a, 'missing') AS predicted, coalesce(b, 'missing') AS reference, a IS NOT DISTINCT FROM b AS same, count(*) AS rows FROM e GROUP BY ALL""")
def exact_match_missing_vs_null(spark, d):
    """A path that is missing, null, true or 1 on either side; only the same presence and value match."""
    shown = lambda n: F.when(n % 4 == 0, "{}").when(n % 4 == 1, '{"k": null}').when(n % 4 == 2, '{"k": true}').otherwise('{"k": 1}')
    token = lambda n: evaluate.path_token(F.try_parse_json(shown(n)), "$.k")
    rows = table(spark, d, "events").select("event_type", token(F.col("event_id")).alias("a"), token(F.floor(F.col("event_id") / 4)).alias("b"))
    said = lambda c: F.coalesce(F.substring_index(c, "=", -1), F.lit("missing"))
    return rows.groupBy("event_type", said("a").alias("predicted"), said("b").alias("reference"), F.col("a").eqNullSafe(F.col("b")).alias("same")).agg(F.count(F.lit(1)).alias("rows"))


@query(_with("SELECT stage, field, reference, predicted, count(*) AS rows FROM ("
    + " UNION ALL ".join(f"SELECT stage, '{f}' AS field, coalesce(r_{_C(f)}, 'None') AS reference, coalesce(p_{_C(f)}, 'None') AS predicted FROM scored" for f in evaluate.EXACT_FIELDS) + ") GROUP BY ALL"))
def confusion_matrix(spark, d):
    return evaluate.confusion(predictions(spark, d), ["stage"])


_ERR_SQL = " UNION ALL ".join(
    f"SELECT stage, '{f}' AS field, count_if(r_{c} IS NOT NULL AND p_{c} IS NULL) AS missing, count_if(p_{c} IS DISTINCT FROM r_{c}) AS mismatch, {f'count_if(r_{c} IS NULL AND p_{c} IS NOT NULL AND p_{c} <> {chr(39) * 2})' if f in NULLABLE_FIELDS else '0'} AS null_handling_mistake FROM scored GROUP BY 1"
    for f, c in [*((f, _C(f)) for f in SCALAR_FIELDS), (LIST_FIELD, "actions")]
)


@query(_with(_ERR_SQL))
def field_error_counts(spark, d):
    return evaluate.field_errors(predictions(spark, d), ["stage"])


@query(_with("SELECT stage, record_id, round(actions_f1, 6) AS actions_f1 FROM scored"))
def actions_set_f1(spark, d):
    p = predictions(spark, d)
    return p.select("stage", "record_id", F.round(S.set_f1(F.col(f"p.{LIST_FIELD}"), F.col(f"r.{LIST_FIELD}")), 6).alias("actions_f1"))


@query(_with("""SELECT stage, record_id, round(summary_f1, 6) AS summary_f1, round(numeric_score, 6) AS numeric_score, round(semantic_score, 6) AS semantic_score,
round(penalised_score, 6) AS penalised_score FROM scored"""))
def candidate_scores(spark, d):
    return scored(spark, d).select("stage", "record_id", *[F.round(c, 6).alias(c) for c in ("summary_f1", "numeric_score", "semantic_score", "penalised_score")])


# Comparison of stages.

_SIDE = "any_value({0}) FILTER (stage = '{1}') AS {2}_{3}"
_JOIN3 = (
    SCORED_SQL
    + ", j AS (SELECT record_id, "
    + ", ".join(_SIDE.format(c, stage, s, n) for s, stage in zip("bsd", STAGES, strict=True) for c, n in (("penalised_score", "score"), ("syntax", "syntax"), ("exact", "exact"), ("raw_output", "output")))
    + " FROM scored GROUP BY record_id HAVING count(DISTINCT stage) = 3)"
)


@query(_with("""SELECT s.record_id, round(d.semantic_score - s.semantic_score, 6) AS delta, d.syntax - s.syntax AS syntax_delta FROM scored s
JOIN scored d ON s.record_id = d.record_id AND s.stage = 'sft' AND d.stage = 'dpo'"""))
def stage_join_two(spark, d):
    rows = scored(spark, d)
    a, b = compare.staged(rows, "sft", "s", "semantic_score"), compare.staged(rows, "dpo", "d", "semantic_score")
    return a.join(b, "record_id").select("record_id", F.round(F.col("d_score") - F.col("s_score"), 6).alias("delta"), (compare.struct_code(F.col("d_syntax")) - compare.struct_code(F.col("s_syntax"))).alias("syntax_delta"))


@query(f"WITH {_JOIN3} SELECT record_id, round(b_score, 6) AS b_score, round(s_score, 6) AS s_score, round(d_score, 6) AS d_score, d_exact FROM j")
def stage_join_three(spark, d):
    j = compare.three_way(scored(spark, d))
    return j.select("record_id", *[F.round(f"{s}_score", 6).alias(f"{s}_score") for s in "bsd"], "d_exact")


@query(f"""WITH {_JOIN3}, e AS (SELECT *, CASE WHEN d_score > s_score + 1e-9 AND d_syntax >= s_syntax THEN 'semantic_gain' WHEN d_syntax > s_syntax AND d_score <= s_score + 1e-9 AND d_score + 1e-9 >= s_score THEN 'syntax_gain_only' WHEN d_score + 1e-9 < s_score THEN 'semantic_regression'
WHEN d_syntax < s_syntax OR d_output IS DISTINCT FROM s_output THEN 'mixed_result' END AS evidence FROM j),
o AS (SELECT *, round(CASE evidence WHEN 'semantic_gain' THEN s_score - d_score WHEN 'syntax_gain_only' THEN -d_syntax ELSE d_score - s_score END, 9) AS x, round(CASE evidence WHEN 'syntax_gain_only' THEN d_score WHEN 'mixed_result' THEN d_syntax ELSE 0.0 END, 9) AS y FROM e WHERE evidence IS NOT NULL)
SELECT evidence, place, record_id, round(s_score, 4) AS s_score, round(d_score, 4) AS d_score FROM (SELECT *, row_number() OVER (PARTITION BY evidence ORDER BY x, y, record_id) AS place FROM o) WHERE place <= 3""")
def stage_evidence_topk(spark, d):
    return compare.evidence(compare.three_way(scored(spark, d)))


@query(f"""WITH {_JOIN3.replace('any_value(penalised_score)', 'any_value(semantic_score)')}, c AS (
SELECT record_id, 'baseline_bad_to_sft_good' AS category, s_score - b_score AS weight FROM j WHERE NOT b_exact AND s_exact UNION ALL
SELECT record_id, 'sft_good_to_dpo_better', d_score - s_score FROM j WHERE s_syntax = 7 AND s_score >= 0.75 AND d_score > s_score + 1e-9 AND d_syntax >= s_syntax UNION ALL
SELECT record_id, 'sft_good_to_dpo_worse', s_score - d_score + (d_syntax < s_syntax)::INT FROM j WHERE s_syntax = 7 AND s_score >= 0.75 AND (d_score + 1e-9 < s_score OR d_syntax < s_syntax) UNION ALL
SELECT record_id, 'syntax_cleaned_up_semantics_unchanged', 1.0 FROM j WHERE d_syntax > s_syntax AND abs(d_score - s_score) <= 1e-9 UNION ALL
SELECT record_id, 'unchanged_hard_failures', 1.5 - greatest(b_score, s_score, d_score) FROM j WHERE b_score < 0.5 AND s_score < 0.5 AND d_score < 0.5 AND NOT b_exact AND NOT s_exact AND NOT d_exact)
SELECT category, place, record_id, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY -round(weight, 9), record_id) AS place FROM c) WHERE place <= 3""")
def case_study_topk(spark, d):
    return compare.case_studies(compare.three_way(scored(spark, d), score="semantic_score"))


@query(f"""WITH {_JOIN3.replace('any_value(penalised_score)', 'any_value(semantic_score)')} SELECT record_id, round(d_score - s_score, 6) AS delta
FROM j WHERE d_syntax < s_syntax OR d_score + 1e-9 < s_score ORDER BY round(d_score - s_score, 6), d_syntax, record_id LIMIT 5""")
def regressions_top5(spark, d):
    return compare.regressions(compare.three_way(scored(spark, d), score="semantic_score"))


_PIVOT = ", ".join(f"max(f1) FILTER (stage = '{s}') AS {s}" for s in STAGES)


@query(f"""WITH {_PRF_SQL}, w AS (SELECT field, {_PIVOT} FROM m GROUP BY field) SELECT *, round(sft - baseline, 6) AS sft_minus_baseline,
round(dpo - sft, 6) AS dpo_minus_sft, round(dpo - baseline, 6) AS dpo_minus_baseline FROM w WHERE baseline IS NOT NULL""")
def stage_delta_pivot(spark, d):
    return compare.stage_deltas(evaluate.prf(evaluate.field_counts(predictions(spark, d), ["stage"])), "field", "f1")


@query(_with("SELECT bucket, " + ", ".join(f"count_if(stage = '{s}') AS {s}" for s in STAGES) + " FROM (SELECT stage, unnest(labels) AS bucket FROM scored) GROUP BY 1"))
def failure_bucket_matrix(spark, d):
    return compare.bucket_matrix(evaluate.bucket_counts(scored(spark, d), ["stage"]))


# Preference pairs: the three stages of a record as its candidates.


def candidates(spark: SparkSession, d: str) -> DataFrame:
    names = list(STAGES)
    index = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("stage")) - 1
    return scored(spark, d).withColumns({"candidate_index": index.cast("int"), "text_key": F.col("raw_output"), "dedupe_key": F.when(F.col("parses"), F.col("raw_output")).otherwise("unparsed")})


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return preference.ranked_candidates(preference.distinct_candidates(candidates(spark, d)))


_RANK_SQL = f"""{SCORED_SQL}, cand AS (SELECT *, CASE stage {' '.join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STAGES))} END AS candidate_index, CASE WHEN parses THEN raw_output ELSE 'unparsed' END AS dedupe_key FROM scored),
ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, dedupe_key ORDER BY candidate_index) AS f FROM cand) WHERE f = 1),
rk AS MATERIALIZED (SELECT *, struct_pack(a := -parses::INT, b := -valid::INT, c := -(extra = 0)::INT, d := extra, e := -matches, f := -actions_f1, g := -summary_f1, h := null_errors, i := words, j := -concise, k := raw_output) AS rank_key,
 row_number() OVER (PARTITION BY record_id ORDER BY -parses::INT, -valid::INT, -(extra = 0)::INT, extra, -matches, -actions_f1, -summary_f1, null_errors, words, -concise, raw_output, candidate_index) AS rank FROM ded),
pr AS MATERIALIZED (SELECT record_id, any_value(source) AS source, count(*) AS n, max(candidate_index) FILTER (rank = 1) AS ci, bool_or(valid) FILTER (rank = 1) AS cv, max(rank_key) FILTER (rank = 1) AS ck, max(rank_key) FILTER (rank = 2) AS sk, arg_max(rank, parses::INT * 100 + rank) FILTER (rank > 1) AS rj FROM rk GROUP BY record_id),
pj AS (SELECT pr.*, c.failure_mode AS cm, r.failure_mode AS rm, r.rank_key AS jk, r.candidate_index AS ri, c.numeric_score - r.numeric_score AS gap FROM pr JOIN rk c ON pr.record_id = c.record_id AND c.rank = 1 LEFT JOIN rk r ON pr.record_id = r.record_id AND r.rank = rj),
sk AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient_distinct_candidates' WHEN NOT cv THEN 'no_schema_valid_candidate' WHEN ck IS NOT DISTINCT FROM pj.sk THEN 'non_unique_top_candidate' WHEN rj IS NULL THEN 'insufficient_distinct_candidates' WHEN ck IS NOT DISTINCT FROM jk THEN 'no_strict_score_gap' WHEN gap < 0.5 THEN 'score_gap_below_threshold' WHEN cm = rm AND cm <> 'clean' THEN 'same_failure_mode' END AS skip_reason FROM pj)"""


@query(f"WITH {_RANK_SQL} SELECT record_id, candidate_index, rank FROM rk")
def candidate_rank(spark, d):
    return _ranked(spark, d).select("record_id", "candidate_index", "rank")


@query(f"WITH {_RANK_SQL} SELECT record_id, n, ci AS chosen_index, ri AS rejected_index FROM sk")
def worst_parseable(spark, d):
    return preference.pairs(_ranked(spark, d)).select("record_id", "n", F.col("chosen.candidate_index").alias("chosen_index"), F.col("rejected.candidate_index").alias("rejected_index"))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    of = records(spark, d).select("record_id", "source_dataset")
    return preference.gated(preference.pairs(_ranked(spark, d)), 0.5).join(of, "record_id")


@query(f"WITH {_RANK_SQL} SELECT coalesce(skip_reason, 'emitted') AS skip_reason, count(*) AS rows FROM sk GROUP BY 1")
def pair_skip_reason(spark, d):
    return _gated(spark, d).groupBy(F.coalesce("skip_reason", F.lit("emitted")).alias("skip_reason")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {_RANK_SQL} SELECT CASE WHEN grouping(source) = 1 THEN 'overall' ELSE source END AS source_dataset, count(*) AS rows,
count_if(skip_reason IS NULL) AS pairs, round(count_if(skip_reason IS NULL) / count(*), 6) AS emission_rate FROM sk GROUP BY GROUPING SETS ((), (source))""")
def pair_quality(spark, d):
    return preference.pair_quality(_gated(spark, d), "source_dataset")


@query(f"WITH {_RANK_SQL} SELECT count(*) AS pairs, round(avg(gap), 6) AS numeric_score_gap FROM sk WHERE skip_reason IS NULL")
def score_gap_avg(spark, d):
    live = _gated(spark, d).where("skip_reason is null")
    return preference.gaps(live).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("numeric_score_gap"), 6).alias("numeric_score_gap"))


def _told(field: str, sentence: str, unit: str | None) -> str:
    if unit is None:
        return f"WHEN c.{field} AND NOT r.{field} THEN '{sentence}'"
    shown = [f"printf('%.4f', {x}.{field})" if field in S.DECIMAL else f"{x}.{field}" for x in "cr"]
    return f"WHEN c.{field} {'<' if field in S.SMALLER else '>'} r.{field} THEN '{sentence} (' || {shown[0]} || ' vs ' || {shown[1]} || '{unit}).'"


@query(f"""WITH {_RANK_SQL} SELECT record_id, CASE {' '.join(_told(*x) for x in S.REASONS)} ELSE '{S.LAST_REASON}' END AS rationale FROM sk
JOIN rk c USING (record_id) JOIN rk r USING (record_id) WHERE skip_reason IS NULL AND c.rank = 1 AND r.candidate_index = ri""")
def pair_rationale(spark, d):
    """One row per emitted pair with the text of the decision."""
    live = _gated(spark, d).where("skip_reason is null")
    return live.select("record_id", S.rationale(F.col("chosen"), F.col("rejected")).alias("rationale"))


# Serving.

_EV = "(SELECT *, value IS NOT NULL AND event_id % 17 <> 0 AS success FROM events)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("success", F.col("value").isNotNull() & (F.col("event_id") % 17 != 0))


@query(f"""SELECT event_type, count(*) AS request_count, count_if(success) AS success_count, quantile_disc(value, 0.5) FILTER (success) AS p50, quantile_disc(value, 0.9) FILTER (success) AS p90, quantile_disc(value, 0.99) FILTER (success) AS p99,
round(count_if(success) / count(*), 6) AS success_rate, round((quantile_disc(value, 0.99) FILTER (success)) / nullif(quantile_disc(value, 0.5) FILTER (success), 0), 6) AS tail_inflation FROM {_EV} GROUP BY 1""")
def latency_p_ceil(spark, d):
    return serving.workload_summary(_requests(spark, d), ["event_type"], "value", "success")


@query("SELECT event_type, list_sort(list(value))[round_even((count(value) - 1) * 0.95, 0)::BIGINT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_p_round(spark, d):
    return profile.ordered_value(table(spark, d, "events"), ["event_type"], "value", profile.rank_round(0.95), "p95")


_LEN = "l AS MATERIALIZED (SELECT doc_id, length(text) AS n_text FROM documents WHERE text IS NOT NULL), q AS (SELECT list_sort(list(n_text)) AS s FROM l), cut AS (SELECT s[floor((len(s) - 1) * 0.33)::BIGINT + 1] AS lo, s[floor((len(s) - 1) * 0.66)::BIGINT + 1] AS hi FROM q), bk AS MATERIALIZED (SELECT doc_id, n_text, CASE WHEN n_text <= lo THEN 'short' WHEN n_text <= hi THEN 'medium' ELSE 'long' END AS bucket_label FROM l, cut)"


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    return profile.length_buckets(table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("n_text")), "n_text")


@query(f"WITH {_LEN} SELECT doc_id, bucket_label FROM bk")
def length_bucket_cutoffs(spark, d):
    return _bucketed(spark, d).select("doc_id", "bucket_label")


@query(f"""WITH {_LEN}, p AS (SELECT bucket_label, quantile_disc(n_text, 0.99) AS p99, quantile_disc(n_text, 0.5) AS p50 FROM bk GROUP BY 1)
SELECT bucket_label, p50, p99, round(p99 / nullif(p50, 0), 6) AS tail_ratio FROM p""")
def bucket_tail_ratio(spark, d):
    ranks = profile.ordered_values(_bucketed(spark, d), ["bucket_label"], "n_text", {"p50": profile.rank_ceil(0.5), "p99": profile.rank_ceil(0.99)})
    return ranks.withColumn("tail_ratio", F.round(F.try_divide("p99", "p50"), 6))


_draw = lambda b, seed, n: f"(SELECT doc_id, bucket_label FROM bk WHERE bucket_label = '{b}' ORDER BY substr(sha256('{seed}:' || doc_id), 1, 16), doc_id::VARCHAR LIMIT {n})"


@query(f"WITH {_LEN} SELECT doc_id::VARCHAR AS doc_id, bucket_label, 'natural_mix_70_30_short_long' AS mix_name FROM ({_draw('short', 17, 84)} UNION ALL {_draw('long', 18, 36)})")
def workload_mix(spark, d):
    rows = _bucketed(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "bucket_label")
    return sampling.workload_mix(rows, "bucket_label", "doc_id", "natural_mix_70_30_short_long", 120, 17)


_CONF = "c AS (SELECT l_linenumber AS max_num_seqs, l_returnflag AS flag, count(*)::DOUBLE AS throughput_rps, round(avg(l_extendedprice), 4) AS short_p99_ms, max(l_quantity)::INT AS max_num_batched_tokens FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_CONF}, e AS (SELECT *, max(throughput_rps) OVER () AS best FROM c) SELECT max_num_seqs, flag, throughput_rps FROM e
WHERE throughput_rps >= best * 0.5 ORDER BY short_p99_ms, throughput_rps DESC, max_num_batched_tokens, max_num_seqs LIMIT 1""")
def config_argmin(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("max_num_seqs"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).cast("double").alias("throughput_rps"), F.round(F.avg("l_extendedprice"), 4).alias("short_p99_ms"), F.max("l_quantity").cast("int").alias("max_num_batched_tokens"))
    return serving.tuned_config(rows, 0.5).select("max_num_seqs", "flag", "throughput_rps")


@query("SELECT mix || '-' || c AS step_id, mix, c AS concurrency FROM (VALUES ('a'), ('b'), ('c')) m(mix), (VALUES (1), (4), (8)) k(c) WHERE NOT (mix = 'a' AND c IN (1, 4))")
def plan_crossjoin_resume(spark, d):
    steps = serving.plan(spark, mix=["a", "b", "c"], concurrency=[1, 4, 8]).withColumn("step_id", F.concat_ws("-", "mix", "concurrency")).withColumn("concurrency", F.col("concurrency").cast("int"))
    return serving.remaining(steps, spark.createDataFrame([("a-1",), ("a-4",)], "step_id string"))


@query("""WITH m AS (SELECT record_id, messages, list_position(list_transform(messages, lambda x: trim(x.role)), 'assistant') AS a FROM support_tickets_eval_manifest WHERE record_id IS NOT NULL)
SELECT DISTINCT record_id, len(CASE WHEN coalesce(a, 0) > 0 THEN messages[1:a - 1] ELSE messages END)::INT AS kept, md5(coalesce(array_to_string(list_transform(CASE WHEN coalesce(a, 0) > 0 THEN messages[1:a - 1] ELSE messages END, lambda x: trim(x.role) || ': ' || coalesce(x.content, '')), chr(10)), '')) AS digest FROM m""")
def messages_takewhile(spark, d):
    kept = X.before_assistant(F.col("messages"))
    return table(spark, d, "support_tickets_eval_manifest").where("record_id is not null").select("record_id", F.when(F.col("messages").isNotNull(), F.size(kept)).alias("kept"), F.md5(F.coalesce(X.chat_text(kept), F.lit(""))).alias("digest")).distinct()


@query("SELECT DISTINCT record_id, len(messages)::INT AS turns, messages[-1].role AS last_role FROM support_tickets_eval_manifest WHERE record_id IS NOT NULL")
def messages_pack(spark, d):
    m = F.col("messages")
    return table(spark, d, "support_tickets_eval_manifest").where("record_id is not null").select("record_id", F.when(m.isNotNull(), F.size(m)).alias("turns"), F.try_element_at(m, F.lit(-1))["role"].alias("last_role")).distinct()


@query(f"WITH {RECORDS_SQL} SELECT record_id, md5('{_q(X.SYSTEM_TEXT)}' || chr(10) || chr(10) || '{_q(X.USER_TEXT)}' || regexp_replace(coalesce(input_text, ''), '^\\s+|\\s+$', '', 'g') || chr(10)) AS digest FROM rec")
def prompt_render(spark, d):
    return records(spark, d).select("record_id", F.md5(X.prompt(F.col("input_text"))).alias("digest"))


@query("SELECT l_returnflag, coalesce(max(l_discount) FILTER (l_linestatus = 'F'), 0.0) AS F, coalesce(max(l_discount) FILTER (l_linestatus = 'O'), 0.0) AS O FROM lineitem GROUP BY 1")
def heatmap_pivot(spark, d):
    return profile.heatmap(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.max("l_discount"))


@query("""WITH s AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, least(40, greatest(10, floor(sqrt(count(*)))))::INT AS bins FROM documents WHERE n_chars IS NOT NULL)
SELECT CASE WHEN hi = lo THEN 1 ELSE least(bins, floor((n_chars - lo) / (hi - lo) * bins) + 1)::INT END AS bin, count(*) AS rows FROM documents, s WHERE n_chars IS NOT NULL GROUP BY 1""")
def histogram_bins(spark, d):
    return profile.histogram(table(spark, d, "documents"), "n_chars")


@query(r"""WITH k AS (SELECT kind, len(list_filter(regexp_split_to_array(trim(text, E' \t\n\r'), '\s+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL)
SELECT kind, count(*) AS n, min(n) AS least, max(n) AS most, round(avg(n), 2) AS mean, sum(n)::BIGINT AS total FROM k GROUP BY 1""")
def token_counts(spark, d):
    return profile.length_stats(table(spark, d, "documents").where("text is not null"), ["kind"], F.size(X.space_tokens(F.col("text"))))


#: How a completion is dressed up or damaged, by a hash of its record: (before it, behind it, parsed, recovered).
DRESSES = (
    ("", "", True, False),
    ("```json\n", "\n```", True, False),
    ("```\n", "\n```", True, False),
    ('Here is {it}: ', " - done", False, False),
    ("Sure. ", ' {"more": "}"}', True, True),
    ('"', '"', True, True),
    ("[", "]", True, True),
    ("{", "", False, False),
    ("No object: [1, 2] ", "", True, True),
)
_DRESSED = "('0x' || substr(md5(record_id), 1, 4))::BIGINT % {0}"
_COMPLETIONS = f"dressed AS (SELECT DISTINCT record_id, completion, {_DRESSED.format(len(DRESSES))} AS dress FROM support_tickets_sft_prompt_completion)"


def completions(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Distinct completions, null ones too, with a number below ``n`` by a hash of their record."""
    at = F.conv(F.substring(F.md5("record_id"), 1, 4), 16, 10).cast("long") % n
    return table(spark, d, "support_tickets_sft_prompt_completion").select("record_id", "completion").distinct().withColumn("dress", at)


def _dress(at, what):
    out = None
    for i, kind in enumerate(DRESSES):
        v = F.lit(kind[what])
        out = F.when(at == i, v) if out is None else out.when(at == i, v)
    return out


@query(f"""WITH {_COMPLETIONS} SELECT record_id, CASE WHEN completion IS NOT NULL THEN md5(CASE dress {' '.join(f"WHEN {i} THEN '{_q(a)}' || completion || '{_q(b)}'" if i > 2 else f'WHEN {i} THEN completion' for i, (a, b, _, _) in enumerate(DRESSES))} END) END AS digest
FROM dressed""")
def strip_fences(spark, d):
    df = completions(spark, d, len(DRESSES))
    dressed = F.concat(_dress(F.col("dress"), 0), F.col("completion"), _dress(F.col("dress"), 1))
    return df.select("record_id", F.when(F.col("completion").isNotNull(), F.md5(X.strip_fences(dressed))).alias("digest"))


_PARSED = ", ".join(f"({i}, {a}, {b})" for i, (_, _, a, b) in enumerate(DRESSES))


@query(f"""WITH {_COMPLETIONS}, k(dress, ok, again) AS (VALUES {_PARSED})
SELECT record_id, completion IS NOT NULL AND ok AS parsed, completion IS NOT NULL AND again AS recovered, CASE WHEN completion IS NULL OR dress = 3 THEN CASE WHEN completion IS NULL THEN 'no_json_object' ELSE 'invalid_json_object' END WHEN NOT ok THEN 'no_json_object' END AS error,
CASE WHEN ok THEN json_extract_string(completion, '$.issue_category') END AS issue_category FROM dressed JOIN k USING (dress)""")
def parse_output(spark, d):
    """Completions in fences, in prose, in quotes and brackets, behind other braces, unbalanced, and null."""
    df = completions(spark, d, len(DRESSES))
    parsed = df.withColumn("o", udfs.parse_output(F.concat(_dress(F.col("dress"), 0), F.col("completion"), _dress(F.col("dress"), 1))))
    return parsed.select("record_id", F.col("o.payload").isNotNull().alias("parsed"), F.col("o.recovered").alias("recovered"), F.col("o.error").alias("error"), F.get_json_object("o.payload", "$.issue_category").alias("issue_category"))


#: How a valid payload is broken: (key, JSON it gets or None to drop it, is_valid, first issue).
BREAKS = (
    (None, None, True, None),
    ("summary", None, False, "missing"),
    ("extra", "1", False, "extra_forbidden"),
    ("priority", '"soon"', False, "enum"),
    ("sentiment", "null", False, "string_type"),
    ("summary", '"  "', False, "blank"),
    ("requires_human_followup", '"yes"', False, "bool_type"),
    ("customer", '{"name": null, "mail": "x"}', False, "extra_forbidden"),
    ("customer", '"nobody"', False, "model_type"),
    ("actions_requested", '["call", " "]', False, "blank"),
    ("actions_requested", None, True, None),
    ("actions_requested", '"call"', False, "list_type"),
)
_KINDS = ", ".join(f"({i}, {ok}, {'NULL' if issue is None else repr(issue)})" for i, (_, _, ok, issue) in enumerate(BREAKS))


@query(f"""WITH p AS (SELECT record_id, {_DRESSED.format(len(BREAKS))} AS dress, split_part(json_extract_string(completion, '$.issue_category'), '?', 1) AS c FROM (SELECT DISTINCT record_id, completion FROM support_tickets_sft_prompt_completion) WHERE completion IS NOT NULL),
k(dress, ok, issue) AS (VALUES {_KINDS}) SELECT record_id, ok AS is_valid, issue AS first_issue, CASE WHEN ok THEN c END AS issue_category, CASE issue WHEN 'missing' THEN 75 WHEN 'extra_forbidden' THEN 90 ELSE CASE WHEN ok THEN 100 ELSE 85 END END AS points FROM p JOIN k USING (dress)""")
def validate_payload(spark, d):
    """Completions as they are and broken in eleven ways, with their schema-only score."""
    df = completions(spark, d, len(BREAKS)).where("completion is not null")
    fields = F.from_json("completion", "map<string,string>")
    plain = F.from_json("completion", TARGET)
    parts = {k: F.to_json(F.struct(plain[k].alias("v")), {"ignoreNullFields": "false"}) for k in TOP_KEYS}
    changed = None
    for i, (key, value, _, _) in enumerate(BREAKS):
        shown = {k: (F.lit(f'"{k}": {value}') if k == key else F.concat(F.lit(f'"{k}": '), F.regexp_extract(parts[k], r'(?s)^\{"v":(.*)\}$', 1))) for k in TOP_KEYS if not (k == key and value is None)}
        if key and key not in TOP_KEYS:
            shown[key] = F.lit(f'"{key}": {value}')
        text = F.concat(F.lit("{"), F.concat_ws(", ", *shown.values()), F.lit("}"))
        changed = F.when(F.col("dress") == i, text) if changed is None else changed.when(F.col("dress") == i, text)
    checked = df.where(fields.isNotNull()).withColumn("v", udfs.validate_payload(changed))
    other = F.size("v.issues") - F.size("v.missing") - F.size("v.unexpected")
    return checked.select("record_id", F.col("v.is_valid").alias("is_valid"), F.try_element_at("v.issues", F.lit(1))["issue_type"].alias("first_issue"), F.get_json_object("v.normalized", "$.issue_category").alias("issue_category"), S.schema_points(F.size("v.missing"), F.size("v.unexpected"), other).alias("points"))


@query()
def sequence_ratio(spark, d):
    """difflib's ratio of a ticket's summary and its first action; SQL has no such function."""
    df = records(spark, d).where("target.summary is not null and size(target.actions_requested) > 0")
    return df.select("record_id", F.round(udfs.sequence_ratio("target.summary", F.col("target.actions_requested")[0]), 6).alias("ratio"))


@query("""WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, E' \\t\\n\\r'), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, len(w) AS u, 512 - 32 - (len(w) + 40) AS room, greatest(0, 512 - 32 - 96 - 40) AS most FROM k)
SELECT doc_id, CASE WHEN room >= 96 OR u <= most THEN u ELSE most END::INT AS kept, CASE WHEN room >= 96 THEN greatest(1, least(256, room)) WHEN u <= most THEN 96 ELSE greatest(1, least(256, 512 - 32 - 40 - most)) END::INT AS output_tokens, CASE WHEN room >= 96 THEN NULL WHEN u <= most THEN 'output_shrunk_to_minimum' ELSE 'trimmed_user_ticket_text' END AS reason FROM b""")
def context_budget(spark, d):
    w = X.space_tokens(F.col("text"))
    df = table(spark, d, "documents").where("text is not null").select("doc_id", F.size(w).alias("u"))
    return df.withColumn("b", serving.context_budget(F.col("u") + 40, F.col("u"), max_len=512)).select("doc_id", "b.kept", "b.output_tokens", "b.reason")


@query("""SELECT event_id::DOUBLE AS step, 'value' AS metric, value FROM events WHERE value IS NOT NULL UNION ALL SELECT event_id, 'k', try_cast(json_extract_string(props, '$.k') AS DOUBLE)
FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL""")
def history_unpivot(spark, d):
    log = table(spark, d, "events").select("event_id", F.col("value").cast("string").alias("value"), F.get_json_object("props", "$.k").alias("k"))
    return serving.history(log, "event_id", ["value", "k"])


@query(f"""WITH {RECORDS_SQL}, v AS (SELECT record_id, ('0x' || substr(sha256('17:' || record_id), 1, 16))::HUGEINT % 3 AS i FROM rec)
SELECT record_id || '-stress-' || (['{"', '".join(augment.STRESS_KINDS)}'])[(i + 1)::BIGINT] AS record_id, record_id AS lineage_record_id
FROM v""")
def stress_variants(spark, d):
    return augment.stress_rows(records(spark, d)).select("record_id", "lineage_record_id")


@query(f"WITH {RECORDS_SQL} SELECT DISTINCT source AS label FROM rec UNION SELECT dataset_name FROM source_registry")
def label_union(spark, d):
    return records(spark, d).select(F.col("source_dataset").alias("label")).union(table(spark, d, "source_registry").select("dataset_name")).distinct()


def raw_sources(spark: SparkSession, d: str):
    """(source, raw rows) of every registry source that has an adapter, as that source would deliver them.

    A record belongs to the source that its source_dataset names exactly, else to the one its adapter_name names.
    """
    from .sources.registry import registry

    entries = table(spark, d, "source_registry")
    sources = {s.adapter_name: s for s in registry([r.asDict() for r in entries.collect()])}
    by_name = F.broadcast(entries.select(F.col("dataset_name").alias("n")))  # a row per source
    by_adapter = F.broadcast(entries.select(F.col("adapter_name").alias("a"), F.col("dataset_name").alias("m")))
    df = table(spark, d, "support_tickets_canonical").where("record_id is not null").withColumn("adapter", F.col("metadata.adapter_name"))
    named = df.join(by_name, F.col("source_dataset") == F.col("n"), "left").join(by_adapter, F.col("adapter") == F.col("a"), "left")
    rec = named.groupBy("record_id").agg(F.min(F.coalesce("n", "m")).alias("source"), F.min("input_text").alias("input_text"), F.any_value("target", True).alias("target"))
    of = lambda adapter: rec.where(F.col("source") == sources[adapter].dataset_name)
    t, text, key = F.col("target"), F.col("input_text"), F.col("record_id")
    seed = table(spark, d, "support_tickets").where("record_id is not null").groupBy("record_id").agg(F.min("split").alias("split"), F.min("input_text").alias("input_text"), F.any_value("target", True).alias("target"))
    desk = of("hf_it_helpdesk_ticket_v1").select(key.alias("ticket_id"), F.lit(None).cast("string").alias("subject"), text.alias("description"), t["priority"].alias("priority"), t["issue_category"].alias("category"))
    mail = of("hf_customer_support_ticket_v1").select(key.alias("id"), t["summary"].alias("subject"), text.alias("body"), t["priority"].alias("priority"))
    story = of("cfpb_complaint_csv_v1").select(key.alias("complaint_id"), t["product_area"].alias("product"), t["issue_category"].alias("issue"), text.alias("consumer_complaint_narrative"))
    plain = of("hf_schema_discipline_json_v1").select("record_id", text.alias("text"), F.to_json("target", {"ignoreNullFields": "false"}).alias("output"))
    raw = {"json_extraction": seed, "hf_it_helpdesk_ticket_v1": desk, "hf_customer_support_ticket_v1": mail, "cfpb_complaint_csv_v1": story, "hf_schema_discipline_json_v1": plain}
    return [(sources[a], df) for a, df in raw.items() if a in sources]


_VALID = " AND ".join([*(f"t.{f} IN {v}" for f, v in DOMAINS.items() if "." not in f), "coalesce(t.customer.plan_tier, 'free') IN ('free', 'pro', 'business', 'enterprise')", "t.requires_human_followup IS NOT NULL", "trim(coalesce(t.summary, '')) <> ''", "t.customer IS NOT NULL"])
_VALID += " AND len(list_filter(coalesce(t.actions_requested, []), lambda x: trim(coalesce(x, '')) = '')) = 0"
_EMPTY = "regexp_replace(coalesce(input_text, ''), '^\\s+|\\s+$', '', 'g') = ''"
_INTAKE_SQL = f"""rs AS (SELECT record_id, min(coalesce(a.dataset_name, b.dataset_name)) AS src, min(input_text) AS input_text, any_value(target) AS t FROM support_tickets_canonical c
 LEFT JOIN source_registry a ON c.source_dataset = a.dataset_name LEFT JOIN source_registry b ON c.metadata.adapter_name = b.adapter_name WHERE record_id IS NOT NULL GROUP BY 1),
x AS (SELECT record_id, dataset_name, adapter_name, NULL AS hint, CASE adapter_name WHEN 'hf_it_helpdesk_ticket_v1' THEN CASE WHEN {_EMPTY} THEN 'missing_description' END WHEN 'hf_customer_support_ticket_v1' THEN CASE WHEN {_EMPTY} THEN 'missing_body' END
 WHEN 'cfpb_complaint_csv_v1' THEN CASE WHEN {_EMPTY} THEN 'missing_consumer_complaint_narrative' END ELSE CASE WHEN {_EMPTY} OR t IS NULL THEN 'missing_text_or_output' WHEN NOT coalesce({_VALID}, false) THEN 'schema_violation' END END AS reason
 FROM rs JOIN source_registry ON src = dataset_name WHERE adapter_name IN ('hf_it_helpdesk_ticket_v1', 'hf_customer_support_ticket_v1', 'cfpb_complaint_csv_v1', 'hf_schema_discipline_json_v1')
UNION ALL SELECT record_id, dataset_name, adapter_name, lower(trim(coalesce(split, ''))), CASE WHEN NOT coalesce({_VALID}, false) THEN 'invalid_target' WHEN {_EMPTY} THEN 'missing_input_text' END
 FROM (SELECT record_id, min(split) AS split, min(input_text) AS input_text, any_value(target) AS t FROM support_tickets WHERE record_id IS NOT NULL GROUP BY 1), (SELECT dataset_name, adapter_name FROM source_registry WHERE adapter_name = 'json_extraction'))"""


def _counted(rows: DataFrame, refused: DataFrame) -> DataFrame:
    counts = rows.groupBy("source_dataset", "split").agg(F.count(F.lit(1)).alias("rows"))
    return counts.unionByName(refused.groupBy(F.col("adapter_name").alias("source_dataset"), F.col("reason").alias("split")).agg(F.count(F.lit(1)).alias("rows")))


@query(f"""WITH {_INTAKE_SQL} SELECT CASE WHEN reason IS NULL THEN dataset_name ELSE adapter_name END AS source_dataset, coalesce(reason, CASE WHEN hint IN ('train', 'training') THEN 'train' WHEN hint IN ('eval', 'evaluation', 'test', 'validation') THEN 'eval'
WHEN ('0x' || substr(sha1(dataset_name || ':' || record_id), 1, 8))::BIGINT % 1000 < 200 THEN 'eval' ELSE 'train' END) AS split, count(*) AS rows FROM x GROUP BY ALL""")
def build_intake(spark, d):
    """All sources through all adapters: accepted rows by source and split, rejects by adapter and reason."""
    from .plans.build import Profile, intake

    return _counted(*intake(raw_sources(spark, d), Profile()))


@query()
def dataset_build(spark, d):
    """The whole build over all sources that have an adapter, drawn by weight to half of the training and of the evaluation rows, reported as its composition."""
    from .plans.build import Profile, build

    raw = raw_sources(spark, d)
    half = max(1, table(spark, d, "support_tickets_canonical").where("record_id is not null").count() // 4)
    return _counted(*build(raw, Profile(train_target=half, eval_target=half // 4)))
