"""Arrow UDFs for what no built-in function says: lenient JSON recovery, the strict validator, difflib's ratio, byte-exact JSON."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CUSTOMER_KEYS, DOMAINS, TOP_KEYS

_text, _flag = T.StringType(), T.BooleanType()
PARSED = T.StructType([T.StructField("payload", _text), T.StructField("error", _text), T.StructField("recovered", _flag)])
_issue = T.StructType([T.StructField("path", _text), T.StructField("issue_type", _text)])
VALIDATION = T.StructType([T.StructField("is_valid", _flag), T.StructField("normalized", _text), T.StructField("issues", T.ArrayType(_issue)), T.StructField("missing", T.ArrayType(_text)), T.StructField("unexpected", T.ArrayType(_text))])


def balanced_object(text: str) -> str | None:
    """The first balanced {...} of a text, braces inside strings not counted; None if it never closes."""
    begin = text.find("{")
    depth, inside, skip = 0, False, False
    for at in range(begin, len(text)) if begin >= 0 else ():
        c = text[at]
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[begin : at + 1]
    return None


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def parse_text(text: str | None) -> tuple[str | None, str | None, bool]:
    """(payload as sorted JSON, error, recovered): the whole text without fences as an object, else its first balanced object."""
    body = (text or "").strip()
    if body.startswith("```"):
        body = body[3:].removeprefix("json").strip()
    body = body.removesuffix("```").strip()
    payload, recovered = _object(body), False
    if payload is None:
        part = balanced_object(body)
        if part is None:
            return None, "no_json_object", False
        payload, recovered = _object(part), part != body
        if payload is None:
            return None, "invalid_json_object", False
    return json.dumps(payload, sort_keys=True), None, recovered


def validate(text: str | None) -> tuple:
    """(is_valid, normalized JSON, issues, missing, unexpected) of a payload against the ticket schema."""
    payload = _object(text) if text is not None else None
    if payload is None:
        return False, None, [{"path": "", "issue_type": "not_an_object"}], [], []
    issues: list[dict] = []
    customer = payload.get("customer")
    missing = [k for k in TOP_KEYS if k not in payload and k != "actions_requested"]
    unexpected = [k for k in sorted(payload) if k not in TOP_KEYS] + ([f"customer.{k}" for k in sorted(customer) if k not in CUSTOMER_KEYS] if isinstance(customer, dict) else [])
    out: dict = {}

    def bad(path: str, kind: str) -> None:
        issues.append({"path": path, "issue_type": kind})

    for path in missing:
        bad(path, "missing")
    for path in unexpected:
        bad(path, "extra_forbidden")
    for key in ("summary", "issue_category", "priority", "product_area", "sentiment"):
        if key in payload:
            v = payload[key]
            if not isinstance(v, str):
                bad(key, "string_type")
            elif key in DOMAINS and v not in DOMAINS[key]:
                bad(key, "enum")
            elif key == "summary" and not v.strip():
                bad(key, "blank")
            else:
                out[key] = v.strip()
    if "requires_human_followup" in payload:
        if isinstance(payload["requires_human_followup"], bool):
            out["requires_human_followup"] = payload["requires_human_followup"]
        else:
            bad("requires_human_followup", "bool_type")
    if "customer" in payload:
        if not isinstance(customer, dict):
            bad("customer", "model_type")
        else:
            clean = {}
            for key in CUSTOMER_KEYS:
                v = customer.get(key)
                if v is not None and not isinstance(v, str):
                    bad(f"customer.{key}", "string_type")
                elif key == "plan_tier" and v is not None and v not in DOMAINS["customer.plan_tier"]:
                    bad("customer.plan_tier", "enum")
                else:
                    clean[key] = (v or "").strip() or None
            out["customer"] = clean
    actions = payload.get("actions_requested")
    if actions is None:
        out["actions_requested"] = []
    elif not isinstance(actions, list) or not all(isinstance(a, str) for a in actions):
        bad("actions_requested", "list_type")
    elif not all(a.strip() for a in actions):
        bad("actions_requested", "blank")
    else:
        out["actions_requested"] = [a.strip() for a in actions]
    return not issues, json.dumps(out, sort_keys=True) if not issues else None, issues, missing, unexpected


@F.pandas_udf(PARSED)
def parse_output(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_text(t) for t in text], columns=["payload", "error", "recovered"])


@F.pandas_udf(VALIDATION)
def validate_payload(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([validate(t) for t in text], columns=["is_valid", "normalized", "issues", "missing", "unexpected"])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, not symmetric; null if either side is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys, an indent of two and ASCII escapes; null for what is not JSON."""

    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t), indent=2, sort_keys=True)
        except ValueError:
            return None

    return pd.Series([one(t) for t in text], dtype="object")
