"""Text, hash and label expressions; every one is Column -> Column and stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DOMAINS, SCHEMA_NAME, SCHEMA_VERSION

#: Keyword tables of the classifiers, in the order in which they are tried (fixed values; substrings, not words).
CATEGORY_WORDS = (
    ("billing", ("invoice", "billing", "charge", "refund", "payment", "loan", "bank", "credit")),
    ("account_access", ("login", "password", "access", "locked", "mfa", "account portal", "sign in")),
    ("technical_bug", ("bug", "error", "500", "crash", "broken", "sync", "timeout", "failed", "technical")),
    ("feature_request", ("feature", "roadmap", "enhancement", "request")),
    ("integration", ("integration", "connector", "webhook", "salesforce", "api")),
    ("general_question", ("question", "help", "documentation", "how do i", "where can i")),
)
AREA_WORDS = (
    ("mobile_app", ("mobile", "ios", "android")),
    ("api", ("api", "endpoint", "webhook")),
    ("billing_portal", ("billing", "invoice", "charge", "payment")),
    ("account_portal", ("account", "mfa", "login", "password")),
    ("integrations", ("salesforce", "connector", "integration", "oauth")),
    ("web_app", ("app", "workspace", "dashboard", "browser")),
    ("unknown", ("unknown", "general")),
)
#: "mixed" needs words that already make a text positive, so it never occurs; the data rely on that.
SENTIMENT_WORDS = (
    ("positive", ("thank", "appreciate", "helpful", "love")),
    ("negative", ("frustrated", "angry", "broken", "can't", "cannot", "urgent", "complaint", "error")),
)
PRIORITY_WORDS = (
    ("urgent", ("critical",)), ("urgent", ("urgent",)), ("urgent", ("sev1",)), ("high", ("high",)), ("medium", ("medium",)), ("medium", ("normal",)), ("medium", ("moderate",)), ("low", ("low",)),
    ("high", ("can't", "cannot", "blocked", "broken", "refund", "charged twice", "error")),
)
PLAN_WORDS = (("free", ("free",)), ("free", ("starter",)), ("pro", ("pro",)), ("business", ("business",)), ("enterprise", ("enterprise",)))
SUMMARY_FALLBACK, SUMMARY_LENGTH, EXCERPT_LENGTH = "Customer support request", 140, 240

#: The instruction and the prompt around a ticket (fixed values).
SYSTEM_TEXT = (
    "You are a structured support-ticket extraction assistant.\n"
    "Return only valid JSON that follows the schema exactly.\n"
    "Use null for unknown customer fields.\n"
    "Use [] when the customer did not request any explicit action.\n"
    "Do not add keys that are not defined by the schema.\n\n"
    f"Schema name: {SCHEMA_NAME}\nSchema version: {SCHEMA_VERSION}\nTop-level JSON object fields:\n- summary: string\n"
    f"- issue_category: {' | '.join(DOMAINS['issue_category'])}\n- priority: {' | '.join(DOMAINS['priority'])}\n- product_area: {' | '.join(DOMAINS['product_area'])}\n"
    "- customer: object with fields name, account_id, plan_tier\n"
    f"- customer.plan_tier: {' | '.join(DOMAINS['customer.plan_tier'])} | null\n- sentiment: {' | '.join(DOMAINS['sentiment'])}\n"
    "- requires_human_followup: boolean\n- actions_requested: list[string]"
)
USER_TEXT = "Extract the support ticket into the schema described above.\n\nTicket text:\n"


def clean(c: Column) -> Column:
    """The text without white space (any Unicode) at its ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(clean(c), F.lit(""))


def joined_lower(*parts: Column) -> Column:
    """The non-empty parts in lower case, joined by a blank."""
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def pattern(words: tuple[str, ...]) -> str:
    """A regular expression that finds any of the words; the words hold no special characters."""
    return "|".join(words)


def first_rule(text: Column, rules, otherwise: str | None) -> Column:
    """The label of the first rule of which a keyword is a substring of the (lower-case) text."""
    out = None
    for label, words in rules:
        hit = text.rlike(pattern(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(otherwise))


def issue_category(*parts: Column) -> Column:
    return first_rule(joined_lower(*parts), CATEGORY_WORDS, "other")


def product_area(*parts: Column) -> Column:
    return first_rule(joined_lower(*parts), AREA_WORDS, "other")


def sentiment(*parts: Column) -> Column:
    return first_rule(joined_lower(*parts), SENTIMENT_WORDS, "neutral")


def priority(*parts: Column) -> Column:
    return first_rule(joined_lower(*parts), PRIORITY_WORDS, "medium")


def plan_tier(*parts: Column) -> Column:
    return first_rule(joined_lower(*parts), PLAN_WORDS, None)


def name_from_email(email: Column) -> Column:
    """The local part as capitalised words; null without an @ or a local part."""
    local = F.split_part(clean(email), F.lit("@"), F.lit(1))
    parts = F.filter(F.split(F.translate(local, "._", "  "), r"\s+"), lambda w: w != "")
    named = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000)))), " ")
    return F.when(F.contains(clean(email), F.lit("@")) & (named != ""), named)


def summary_line(subject: Column, fallback: Column) -> Column:
    text = F.coalesce(blank_to_null(subject), blank_to_null(fallback), F.lit(SUMMARY_FALLBACK))
    return F.substring(F.regexp_replace(text, r"(?U)\s+", " "), 1, SUMMARY_LENGTH)


def split_hint(hint: Column) -> Column:
    """train, eval, or null for a hint that is neither."""
    h = F.lower(clean(hint))
    return F.when(h.isin("train", "training"), "train").when(h.isin("eval", "evaluation", "test", "validation"), "eval")


def hash_split(dataset: Column, record_id: Column, hint: Column | None = None, eval_ratio: float = 0.15) -> Column:
    """The hinted split, else eval for the share ``eval_ratio`` of the SHA-1 buckets of "dataset:id"."""
    bucket = F.conv(F.substring(F.sha1(F.concat_ws(":", dataset, record_id)), 1, 8), 16, 10).cast("long") % 1000
    by_hash = F.when(bucket < int(eval_ratio * 1000), "eval").otherwise("train")
    return by_hash if hint is None else F.coalesce(split_hint(hint), by_hash)


def order_key(record_id: Column, seed: int) -> Column:
    """A fixed-width hash that orders records the same way in every layout."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), record_id), 256), 1, 16)


def hash_variant(record_id: Column, seed: int, names: tuple[str, ...]) -> Column:
    """One of the names by the 64-bit seed hash modulo their number."""
    at = F.conv(order_key(record_id, seed), 16, 10).cast("decimal(20,0)") % len(names)
    return F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int") + 1)


def stable_id(prefix: str, canonical_json: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(canonical_json), 1, 10))


def excerpt(canonical_json: Column) -> Column:
    return F.substring(canonical_json, 1, EXCERPT_LENGTH)


def strip_fences(c: Column) -> Column:
    """A text without one leading and one trailing code fence."""
    return clean(F.regexp_replace(F.regexp_replace(clean(c), r"^```(?:json)?", ""), r"```$", ""))


def word_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 in lower case, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def space_tokens(c: Column) -> Column:
    """Pieces between white space; none for null and blank texts."""
    return F.filter(F.split(clean(c), r"\s+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Pieces between full stops with white space collapsed; a text without one is its own piece."""
    flat = clean(F.regexp_replace(c, r"(?U)\s+", " "))
    parts = F.filter(F.transform(F.split(flat, r"\."), clean), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(flat))


def slug(c: Column) -> Column:
    return F.translate(c, "/ :", "___")


def user_prompt(text: Column) -> Column:
    return F.concat(F.lit(USER_TEXT), clean(text))


def prompt(text: Column) -> Column:
    return F.concat(F.lit(SYSTEM_TEXT + "\n\n"), user_prompt(text), F.lit("\n"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(text: Column, answer: Column | None = None) -> Column:
    parts = [message("system", F.lit(SYSTEM_TEXT)), message("user", user_prompt(text))]
    return F.array(*parts, *([message("assistant", answer)] if answer is not None else []))


def before_assistant(messages_: Column) -> Column:
    """The messages before the first assistant turn, roles trimmed; all of them if there is no such turn."""
    bare = F.transform(messages_, lambda m: F.struct(clean(m["role"]).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    at = F.array_position(F.transform(bare, lambda m: m["role"]), "assistant")
    return F.slice(bare, F.lit(1), F.coalesce(F.nullif(at, F.lit(0)) - 1, F.size(bare).cast("long")).cast("int"))


def request_messages(messages_: Column, text: Column) -> Column:
    """What is sent to a model: the turns before the assistant, or the rendered ticket if there are none."""
    head = before_assistant(messages_)
    return F.when(F.size(head) > 0, head).otherwise(messages(text))


def conversation(messages_: Column) -> Column:
    """(prompt, completion): all but the last message, and the last, of a conversation of at least two that ends with the assistant; else null."""
    n = F.size(messages_)
    ok = (n >= 2) & (F.element_at(messages_, -1)["role"] == "assistant")
    return F.when(ok, F.struct(F.slice(messages_, F.lit(1), n - 1).alias("prompt"), F.slice(messages_, n, F.lit(1)).alias("completion")))


def chat_text(messages_: Column) -> Column:
    return F.array_join(F.transform(messages_, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def replace_first(text: Column, found: Column, by: str, ignore_case: bool = False) -> Column:
    """The text with the first literal occurrence replaced; unchanged if there is none or ``found`` is null or empty."""
    at = F.instr(F.lower(text), F.lower(found)) if ignore_case else F.instr(text, found)
    return F.when((F.length(found) > 0) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + F.length(found), F.length(text)))).otherwise(text)


def target_from_text(summary: Column, issue: Column, priority_text: Column, category_text: Column, product_text: Column, name: Column, account: Column, plan: Column, followup: Column | None = None) -> Column:
    """The eight-field payload with labels inferred from text; each classifier reads its inputs in its own order."""
    category, level = issue_category(category_text, product_text, issue), priority(priority_text, issue, category_text)
    return F.struct(
        summary.alias("summary"),
        category.alias("issue_category"),
        level.alias("priority"),
        product_area(product_text, category_text, issue).alias("product_area"),
        F.struct(name.alias("name"), account.alias("account_id"), plan.alias("plan_tier")).alias("customer"),
        sentiment(issue, priority_text, category_text).alias("sentiment"),
        F.coalesce(followup if followup is not None else F.lit(None).cast("boolean"), (category != "general_question") | (level != "low")).alias("requires_human_followup"),
        F.array().cast("array<string>").alias("actions_requested"),
    )
