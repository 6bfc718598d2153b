"""Adapters: raw source rows to canonical drafts, with rejects beside them.

Each adapter adds the columns record_id, split_hint, input_text, target, extras and reason; rows with a reason are the
rejects. One DataFrame transform per source; user adapters register the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.udfs import validate_payload
from ..schema import TARGET

Adapter = Callable[[DataFrame], DataFrame]
#: Answers that need no follow-up mention one of these (fixed values).
NO_FOLLOW_UP = ("help center", "documentation", "kb article")


def _get(df: DataFrame, *names: str) -> Column:
    """The first non-blank of the named columns that exist, cleaned; empty if none."""
    have = [X.blank_to_null(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(""))


def _prepared(df: DataFrame, **columns: Column) -> DataFrame:
    """Cleaned inputs as columns of their own, so that the many expressions over them stay small; raw_json is kept beside."""
    return df.withColumn("__raw", _raw_json(df)).withColumns({f"__{n}": c for n, c in columns.items()})


def _raw_json(df: DataFrame) -> Column:
    if "__raw" in df.columns:
        return F.col("__raw")
    return F.col("raw") if "raw" in df.columns else F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def _draft(df: DataFrame, prefix: str, ids: tuple[str, ...], text: Column, target: Column, extras: dict[str, Column], reason: Column) -> DataFrame:
    entries = [x for k, v in extras.items() for x in (F.lit(k), F.nullif(v, F.lit("")))]
    kept = F.map_filter(F.create_map(*entries) if entries else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda k, v: v.isNotNull())
    return df.select(
        F.coalesce(F.nullif(_get(df, *ids), F.lit("")), X.stable_id(prefix, _raw_json(df))).alias("record_id"), F.nullif(_get(df, "split"), F.lit("")).alias("split_hint"), text.alias("input_text"), target.alias("target"), kept.alias("extras"), reason.alias("reason"), _raw_json(df).alias("raw_json")
    )


def _with_subject(subject: Column, body: Column) -> Column:
    return F.when(subject != "", F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), body)).otherwise(body)


def seed_tickets(df: DataFrame) -> DataFrame:
    """Rows that already are canonical; a row whose target fails validation is rejected."""
    checked = df.withColumn("__v", validate_payload(F.to_json("target", {"ignoreNullFields": "false"})))
    return _draft(checked, "json-extraction", ("record_id",), _get(df, "input_text"), F.from_json("__v.normalized", TARGET), {}, F.when(~F.col("__v.is_valid"), "invalid_target").when(_get(df, "input_text") == "", "missing_input_text"))


def helpdesk(df: DataFrame) -> DataFrame:
    df = _prepared(df, subject=_get(df, "subject"), body=_get(df, "description"), email=_get(df, "requester_email", "requesterEmail"), level=_get(df, "priority"), kind=_get(df, "category"), plan=_get(df, "plan_tier"))
    df = df.withColumn("__text", _with_subject(F.col("__subject"), F.col("__body")))
    text = F.col("__text")
    target = X.target_from_text(X.summary_line(F.col("__subject"), F.col("__body")), text, F.col("__level"), F.col("__kind"), F.lit(""), X.name_from_email(F.col("__email")), F.lit(None).cast("string"), X.plan_tier(F.col("__plan"), text))
    return _draft(df, "it-helpdesk", ("ticket_id", "id"), text, target, {"requester_email": F.col("__email")}, F.when(F.col("__body") == "", "missing_description"))


def customer_support(df: DataFrame) -> DataFrame:
    tags = F.lit("") if "tags" not in df.columns else F.coalesce(F.array_join("tags", " "), F.lit("")) if df.schema["tags"].dataType.typeName() == "array" else _get(df, "tags")
    df = _prepared(
        df, subject=_get(df, "subject"), body=_get(df, "body", "message", "ticket_body"), queue=_get(df, "queue"), kind=_get(df, "type"), tags=tags, level=_get(df, "priority"), answer=F.lower(_get(df, "answer")), plan=_get(df, "plan_tier"), name=F.nullif(_get(df, "customer_name"), F.lit("")), account=F.nullif(_get(df, "account_id"), F.lit(""))
    )
    df = df.withColumns({"__text": _with_subject(F.col("__subject"), F.col("__body")), "__category": F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("__queue", "__kind", "__tags")])})
    target = X.target_from_text(X.summary_line(F.col("__subject"), F.col("__body")), F.col("__text"), F.col("__level"), F.col("__category"), F.col("__tags"), F.col("__name"), F.col("__account"), X.plan_tier(F.col("__plan"), F.col("__body")), ~F.col("__answer").rlike(X.pattern(NO_FOLLOW_UP)))
    return _draft(df, "support-ticket", ("ticket_id", "id"), F.col("__text"), target, {"queue": F.col("__queue"), "ticket_type": F.col("__kind"), "tags": F.col("__tags")}, F.when(F.col("__body") == "", "missing_body"))


def complaints(df: DataFrame) -> DataFrame:
    df = _prepared(df, story=_get(df, "consumer_complaint_narrative"), product=_get(df, "product"), sub=_get(df, "sub_product"), issue=_get(df, "issue"), response=_get(df, "company_response_to_consumer"))
    story, product, sub, issue = (F.col(f"__{n}") for n in ("story", "product", "sub", "issue"))
    summary = F.substring(F.concat(F.coalesce(F.nullif(product, F.lit("")), F.lit("Consumer complaint")), F.lit(": "), F.coalesce(F.nullif(issue, F.lit("")), F.lit("reported issue"))), 1, X.SUMMARY_LENGTH)
    category = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (product, sub, issue)])
    nothing = F.lit(None).cast("string")
    target = X.target_from_text(summary, story, F.lit(""), category, product, nothing, nothing, nothing, F.lit(True))
    return _draft(df, "cfpb", ("complaint_id",), story, target, {"product": product, "sub_product": sub, "issue": issue, "company_response_to_consumer": F.col("__response")}, F.when(story == "", "missing_consumer_complaint_narrative"))


def schema_discipline(df: DataFrame) -> DataFrame:
    """Generic structured-output rows; accepted only if their output is valid under this schema. ``output`` is JSON text."""
    text, output = _get(df, "text", "input", "prompt"), _get(df, "output", "target", "response")
    checked = df.withColumn("__v", validate_payload(output))
    reason = F.when((text == "") | (output == ""), "missing_text_or_output").when(~F.col("__v.is_valid"), "schema_violation")
    return _draft(checked, "schema-discipline", ("record_id", "id"), text, F.from_json("__v.normalized", TARGET), {"schema_discipline_source": F.lit("true")}, reason)


ADAPTERS: dict[str, Adapter] = {"json_extraction": seed_tickets, "hf_it_helpdesk_ticket_v1": helpdesk, "hf_customer_support_ticket_v1": customer_support, "cfpb_complaint_csv_v1": complaints, "hf_schema_discipline_json_v1": schema_discipline}


def adapt(name: str, df: DataFrame) -> DataFrame:
    if name not in ADAPTERS:
        raise ValueError(f"unknown adapter {name!r}")
    return ADAPTERS[name](df)


def rejects(drafts: DataFrame, adapter: str) -> DataFrame:
    return drafts.where("reason is not null").select(F.lit(adapter).alias("adapter_name"), F.col("record_id").alias("source_record_id"), "reason", X.excerpt(F.col("raw_json")).alias("raw_excerpt"))


def canonical(drafts: DataFrame, source, eval_ratio: float, mapping_version: str = "v1") -> DataFrame:
    """Accepted drafts as canonical rows with split and provenance; one ingest time per query."""
    ok = drafts.where("reason is null")
    meta = F.struct(
        F.lit(source.source_group).alias("source_group"), F.lit(source.source_type).alias("source_type"), F.col("record_id").alias("source_record_id"), F.lit(source.source_uri_or_path).alias("source_uri_or_path"),
        F.lit(source.adapter_name).alias("adapter_name"), F.lit(source.license_note).alias("license_note"), F.lit(False).alias("synthetic"),
        F.lit(None).cast("string").alias("augmentation_kind"),
        F.lit(None).cast("string").alias("parent_record_id"), F.col("record_id").alias("lineage_root_id"),
        F.coalesce(X.split_hint(F.col("split_hint")), F.lit("stable_hash")).alias("split_origin"), F.lit(mapping_version).alias("mapping_version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ingested_at_utc"), F.sha1("raw_json").alias("raw_hash"), F.lit(None).cast("int").alias("augmentation_index"), "extras",
    )
    return ok.select("record_id", X.hash_split(F.lit(source.dataset_name), F.col("record_id"), F.col("split_hint"), eval_ratio).alias("split"), F.lit(source.dataset_name).alias("source_dataset"), "input_text", "target", meta.alias("metadata"))
