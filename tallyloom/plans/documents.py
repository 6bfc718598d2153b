"""Small driver-side documents: profiles, precedence of settings, fingerprints, checkpoint state, pointers."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import read_json_document
from ..sources.sinks import write_document
from ..storage import Batches


def overlay(base: dict, profile: str | None, strict: bool = False, aliases: dict[str, str] | None = None) -> dict:
    """The base settings with ``profiles[profile]`` merged over them, level by level. An unknown profile is ignored, or an error if ``strict``."""

    def merged(a: dict, b: dict) -> dict:
        return {k: merged(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k)) for k in [*a, *(k for k in b if k not in a)]}

    profiles = base.get("profiles") or {}
    name = (aliases or {}).get(profile, profile)
    if name is not None and name not in profiles and strict:
        raise ValueError(f"unknown profile {name!r}")
    return merged({k: v for k, v in base.items() if k != "profiles"}, profiles.get(name) or {})


def first_set(*values, default=None):
    """The first value that is not None: argument, configuration, manifest, default."""
    return next((v for v in values if v is not None), default)


def fingerprint(payload: dict, length: int = 64, algorithm: str = "sha256") -> str:
    """Hex digest of the compact JSON with sorted keys, cut to ``length``."""
    return hashlib.new(algorithm, json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:length]


def check_resume(state: dict | None, expected: str) -> None:
    """A stored run may go on only under the settings it began with."""
    if state is not None and state.get("fingerprint") != expected:
        raise ValueError("the stored run has other settings; give another folder or start anew")


def save_step(folder: str, step_id: str, payload: dict, expected: str) -> str:
    """One document per finished step, and the list of finished steps in ``state.json``; repeating a step replaces it."""
    state = read_json_document(f"{folder}/state.json") or {"fingerprint": expected, "completed_steps": []}
    check_resume(state, expected)
    name = step_id.translate(str.maketrans("/ :", "___"))
    path = write_document(f"{folder}/steps/{name}.json", {"step_id": step_id, **payload})
    done = state["completed_steps"]
    write_document(f"{folder}/state.json", {**state, "completed_steps": done if step_id in done else [*done, step_id]})
    return path


def finished_steps(folder: str) -> list[str]:
    return (read_json_document(f"{folder}/state.json") or {}).get("completed_steps", [])


def save_pointer(path: str, **entry) -> str:
    """The latest artefact of a kind, with the time it was named."""
    return write_document(path, {**entry, "updated_at_utc": datetime.now(UTC).isoformat()})


def read_pointer(path: str) -> dict | None:
    """What :func:`save_pointer` wrote last; None if nothing was."""
    return read_json_document(path)


def load_yaml(path: str) -> dict:
    """A YAML document; an empty one is an empty dict, one that is no mapping an error. JSON is YAML, so a JSON file needs no YAML library."""
    with open(path) as f:
        text = f.read()
    try:
        document = json.loads(text) if text.strip() else {}
    except ValueError:
        import yaml  # optional: only YAML proper needs it

        document = yaml.safe_load(text) or {}
    if not isinstance(document, dict):
        raise ValueError(f"{path} holds no mapping")
    return document


def load_profile(path: str, profile: str | None, strict: bool = True, aliases: dict[str, str] | None = None) -> dict:
    """The settings of a YAML document under one of its profiles."""
    return overlay(load_yaml(path), profile, strict, aliases)


def cached_rows(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """Rows that are made once per key, such as rendered and counted prompts: read where they were written before, else made, written and read."""
    batches = Batches(spark, f"{folder.rstrip('/')}/{key}", "")
    if not batches.count():
        batches.append(make())
    return spark.read.parquet(f"{batches.path}/batch=0")


def run_manifest(name: str, settings: dict, **parts) -> dict:
    """The summary document of a run: its name, settings and their fingerprint, and whatever parts are not None."""
    return {"run_name": name, "settings": settings, "fingerprint": fingerprint(settings), "created_at_utc": datetime.now(UTC).isoformat(), **{k: v for k, v in parts.items() if v is not None}}


def excerpt(document: dict | None, keys: tuple[str, ...]) -> dict:
    return {k: (document or {}).get(k) for k in keys}


def rewrite_prefix(path: str | None, prefixes: dict[str, str]) -> str | None:
    """The path with the first matching mount prefix replaced."""
    if path is None:
        return None
    return next((os.path.join(new, path[len(old) :].lstrip("/")) for old, new in prefixes.items() if path == old or path.startswith(old.rstrip("/") + "/")), path)
