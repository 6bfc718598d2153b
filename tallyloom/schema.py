"""Schemas, closed domains and field groups of the canonical ticket data (fixed values)."""

from __future__ import annotations

SCHEMA_NAME, SCHEMA_VERSION = "support_ticket_extraction", "1.0.0"

DOMAINS = {
    "issue_category": ("billing", "account_access", "technical_bug", "feature_request", "integration", "general_question", "other"),
    "priority": ("low", "medium", "high", "urgent"),
    "product_area": ("web_app", "mobile_app", "api", "billing_portal", "account_portal", "integrations", "other", "unknown"),
    "sentiment": ("negative", "neutral", "positive", "mixed"),
    "customer.plan_tier": ("free", "pro", "business", "enterprise"),
}
EXACT_FIELDS = ("issue_category", "priority", "product_area", "sentiment", "requires_human_followup", "customer.plan_tier")
SCALAR_FIELDS = ("issue_category", "priority", "product_area", "customer.name", "customer.account_id", "customer.plan_tier", "sentiment", "requires_human_followup")
LIST_FIELD = "actions_requested"
NULLABLE_FIELDS = ("customer.name", "customer.account_id", "customer.plan_tier")
TOP_KEYS = ("actions_requested", "customer", "issue_category", "priority", "product_area", "requires_human_followup", "sentiment", "summary")
CUSTOMER_KEYS = ("account_id", "name", "plan_tier")

#: DDL of the payload, the provenance struct, chat messages and rejects.
TARGET = ("summary string, issue_category string, priority string, product_area string, customer struct<name:string,account_id:string,plan_tier:string>, sentiment string, requires_human_followup boolean, actions_requested array<string>")
METADATA = (
    "source_group string, source_type string, source_record_id string, source_uri_or_path string, adapter_name string, license_note string, synthetic boolean, augmentation_kind string, "
    "parent_record_id string, lineage_root_id string, split_origin string, mapping_version string, ingested_at_utc string, raw_hash string, augmentation_index int, extras map<string,string>"
)
MESSAGES = "array<struct<role:string,content:string>>"
REJECT = ("adapter_name string, source_record_id string, reason string, raw_excerpt string")


def json_schema() -> dict:
    """The payload as a JSON Schema, with name and version."""
    enum = lambda f: {"type": "string", "enum": list(DOMAINS[f])}
    text, maybe = {"type": "string"}, {"type": ["string", "null"]}
    customer = {"type": "object", "additionalProperties": False, "properties": {"name": maybe, "account_id": maybe, "plan_tier": {"enum": [*DOMAINS["customer.plan_tier"], None]}}}
    properties = {"summary": text, **{f: enum(f) for f in ("issue_category", "priority", "product_area", "sentiment")}, "customer": customer, "requires_human_followup": {"type": "boolean"}, "actions_requested": {"type": "array", "items": text}}
    return {"title": SCHEMA_NAME, "version": SCHEMA_VERSION, "type": "object", "additionalProperties": False, "properties": properties, "required": sorted(k for k in TOP_KEYS if k != "actions_requested")}
