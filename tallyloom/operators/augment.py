"""Row-generating operators: augmented variants with lineage, and long stress variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import sampling

#: Kinds in the order in which indices are given (fixed values).
KINDS = ("paraphrase_ticket_text", "longer_noisier_ticket", "missing_field_ticket", "category_confusable_ticket", "irrelevant_prose_ticket", "ambiguous_customer_info_ticket", "correct_null_ticket")
#: What is put before and behind a text, by kind (fixed values).
BEFORE = {"paraphrase_ticket_text": "Support request rewrite:\n", "irrelevant_prose_ticket": "Hi team, thanks in advance for taking a look.\n\n"}
BEHIND = {
    "paraphrase_ticket_text": "Restated briefly: the customer wants the issue handled without changing the expected JSON facts.",
    "longer_noisier_ticket": "Additional context: this came up during an internal handoff, and the customer included several environment details that do not change the core request. Please focus on the actual support issue, not the scheduling noise.",
    "missing_field_ticket": "Some identifying details are intentionally omitted in this version, so null customer fields can be correct.",
    "category_confusable_ticket": "Clarification: there may be other minor annoyances around the account, but the primary request stays the same and should not be reclassified because of incidental mentions.",
    "irrelevant_prose_ticket": "Unrelated note: we are also updating some internal docs next week, which is not part of this ticket.",
    "ambiguous_customer_info_ticket": "The customer references their workspace indirectly here, so the extractor should prefer nulls over guesses.",
    "correct_null_ticket": "No extra customer identifiers are available beyond what is written here.",
}
HIDING = ("missing_field_ticket", "ambiguous_customer_info_ticket")
STAND_INS = {"name": "our team", "account_id": "the affected account", "plan_tier": "current plan"}
STRESS_KINDS = ("ticket_repeat_context", "multi_turn_ticket_digest", "log_attachment_stub")
SOURCE = "synthetic_hardening_v1"


def hidden(df: DataFrame, text: str, name: Column, account: Column, plan: Column) -> DataFrame:
    """Add ``__cut``: (text, drop_name, drop_account, drop_plan, changed), the first mentions replaced one after the other.

    Each step is a column of its own, so that no expression holds copies of the one before. The plan is dropped once
    anything changed, as downstream data expect.
    """
    steps = df.withColumn("__a", X.replace_first(F.col(text), name, STAND_INS["name"]))
    steps = steps.withColumn("__b", X.replace_first(F.col("__a"), account, STAND_INS["account_id"]))
    steps = steps.withColumn("__c", X.replace_first(F.col("__b"), plan, STAND_INS["plan_tier"], ignore_case=True))
    changed = F.col("__c") != F.col(text)
    cut = F.struct(F.col("__c").alias("text"), (F.col("__a") != F.col(text)).alias("drop_name"), (F.col("__b") != F.col("__a")).alias("drop_account"), (plan.isNotNull() & changed).alias("drop_plan"), changed.alias("changed"))
    return steps.withColumn("__cut", cut).drop("__a", "__b", "__c")


def augmented(df: DataFrame, most: int | None = None) -> DataFrame:
    """Every record (record_id, split, source_dataset, input_text, target, lineage_root_id) times the kinds that apply.

    Indices count all attempts in (source_dataset, record_id) order, applicable or not, and are part of the new id; with
    ``most``, generation stops after so many accepted rows. The running count is a distributed rank: rows are cut by a
    range of their position, so no task holds all rows. Null texts give no rows.
    """
    t = F.col("target")
    order = df.where(F.col("input_text").isNotNull()).withColumn("__o", F.concat_ws("\u0000", F.coalesce("source_dataset", F.lit("")), "record_id"))
    placed = hidden(_positions(order, "__o", "__at"), "input_text", t["customer"]["name"], t["customer"]["account_id"], t["customer"]["plan_tier"])
    kinds = placed.select("*", F.posexplode(F.array(*[F.lit(k) for k in KINDS])).alias("__pos", "kind"))
    rows = kinds.withColumn("index", F.col("__at") * len(KINDS) + F.col("__pos")).withColumn("__cut", F.when(F.col("kind").isin(*HIDING), F.col("__cut")))
    bare = t["customer"]["name"].isNull() & t["customer"]["account_id"].isNull() & t["customer"]["plan_tier"].isNull()
    rows = rows.where((~F.col("kind").isin(*HIDING) | F.col("__cut.changed")) & ((F.col("kind") != "correct_null_ticket") | bare))
    lookup = lambda table: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("kind")), F.lit(""))
    text = F.concat(lookup(BEFORE), F.coalesce("__cut.text", "input_text"), F.lit("\n\n"), lookup(BEHIND))
    drop = lambda flag, value: F.when(F.coalesce(F.col(f"__cut.{flag}"), F.lit(False)), F.lit(None)).otherwise(value)
    customer = F.struct(drop("drop_name", t["customer"]["name"]).alias("name"), drop("drop_account", t["customer"]["account_id"]).alias("account_id"), drop("drop_plan", t["customer"]["plan_tier"]).alias("plan_tier"))
    out = rows.select(
        F.concat("record_id", F.lit("__aug_"), F.format_string("%03d", "index")).alias("record_id"),
        "split",
        F.lit(SOURCE).alias("source_dataset"),
        text.alias("input_text"),
        t.withField("customer", customer).alias("target"),
        F.col("kind").alias("augmentation_kind"),
        F.col("record_id").alias("parent_record_id"),
        F.coalesce("lineage_root_id", "record_id").alias("lineage_root_id"),
        F.col("index").alias("augmentation_index"),
        F.sha1(text).alias("raw_hash"),
        F.lit(True).alias("synthetic"),
    )
    return out if most is None else sampling.first_n(out, ["augmentation_index"], most)


def _positions(df: DataFrame, order: str, out: str) -> DataFrame:
    """0-based positions in the total order of a column: ranges are counted, then numbered inside."""
    from pyspark.sql import Window

    parts = df.repartitionByRange(order).withColumn("__p", F.spark_partition_id())
    from ..storage import written

    parts = written(parts, "ordered")  # partition ids must not change between the count and the numbering
    before = parts.groupBy("__p").count().withColumn("__b", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")  # one row per range
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return parts.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn(out, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b", order)


def stress_notes(text: Column) -> Column:
    """The four notes that a stress text repeats, chosen by topic words (fixed values)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    always = ("The issue persisted across repeated attempts in the same support session.", "A reproducible failure pattern was reported after basic retry steps.")
    topics = (
        ("billing|invoice|payment", "The customer confirmed the request is blocking normal billing review.", "The support queue flagged the case as needing clear next-step guidance."),
        ("api|integration|connector", "The customer reported that the integration flow still failed after credential checks.", "A follow-up note mentioned that the same issue appears during connector maintenance."),
        ("login|sign|account", "The customer stated that the account issue still occurs after a fresh login attempt.", "A follow-up message requested confirmation on whether additional account review is needed."),
    )
    rest = F.array(F.lit("The customer asked for a clear support recommendation instead of a generic status update."), F.lit("The support conversation suggested that self-serve troubleshooting did not resolve the problem."))
    out = None
    for words, a, b in topics:
        pair = F.array(F.lit(a), F.lit(b))
        out = F.when(low.rlike(words), pair) if out is None else out.when(low.rlike(words), pair)
    return F.concat(F.array(*[F.lit(x) for x in always]), out.otherwise(rest))


def stress_text(text: Column, kind: Column) -> Column:
    """A long variant of a ticket around its first and last sentence (the sentences of the three templates are fixed values)."""
    base, parts = X.clean(text), X.sentences(F.coalesce(text, F.lit("")))
    head, tail = F.element_at(parts, 1), F.element_at(parts, -1)
    notes = F.array_join(F.transform(stress_notes(text), lambda n: F.concat(F.lit("- "), n)), "\n")
    line = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    repeat = line(base, "\n\nAdditional customer follow-up context:\n- Original issue summary: ", head, ".\n- The same support request was retried after standard troubleshooting.\n- Latest update from the user: ", tail, ".\n", notes, "\n")
    digest = line(base, "\n\nThread digest:\nCustomer message 1: The original issue is still active and blocks expected work.\nCustomer message 2: ", head, ".\nSupport note: Initial self-serve remediation did not resolve the issue.\nCustomer message 3: ", tail, ".\n", notes, "\n")
    stub = line(base, "\n\nSanitized incident notes:\n- Timestamped retries showed the same visible symptom.\n- The customer requested a precise next-step recommendation.\n- No durable workaround was confirmed during the same support exchange.\n- Ticket excerpt A: ", head, ".\n- Ticket excerpt B: ", tail, ".\n", notes, "\n")
    return F.when(kind == STRESS_KINDS[0], repeat).when(kind == STRESS_KINDS[1], digest).otherwise(stub)


def stress_rows(df: DataFrame, seed: int = 17) -> DataFrame:
    """One long variant per record (record_id, input_text), its kind by hash; the id of the original is kept as lineage."""
    kind = X.hash_variant(F.col("record_id"), seed, STRESS_KINDS)
    return df.withColumn("benchmark_variant", kind).select(
        F.concat_ws("-", F.col("record_id"), F.lit("stress"), F.col("benchmark_variant")).alias("record_id"), F.col("record_id").alias("lineage_record_id"), stress_text(F.col("input_text"), F.col("benchmark_variant")).alias("input_text"), "benchmark_variant"
    )
