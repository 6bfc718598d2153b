"""Text generation as an operator: requests in, responses out, behind a pluggable backend."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import parse_text, validate

RESPONSE = "text string, latency_ms double, first_token_ms double, payload string, parse_error string, recovered boolean, valid boolean, missing array<string>, unexpected array<string>"


class Backend(Protocol):
    """What answers requests. It is made once per task, so it may hold a model or a connection."""

    def generate_batch(self, prompts: list[str], seeds: list[int]) -> list[tuple[str, float | None]]:
        """(text, milliseconds to the first token or None) for every prompt, in order."""


class Placeholder:
    """Answers every prompt with one valid payload; for tests and dry runs."""

    def generate_batch(self, prompts: list[str], seeds: list[int]) -> list[tuple[str, float | None]]:
        answer = {
            "summary": "Placeholder summary", "issue_category": "other", "priority": "medium", "product_area": "unknown", "customer": {"name": None, "account_id": None, "plan_tier": None},
            "sentiment": "neutral", "requires_human_followup": True, "actions_requested": [],
        }
        return [(json.dumps(answer, sort_keys=True), None)] * len(prompts)


def generated(requests: DataFrame, backend: Callable[[], Backend], batch: int = 64) -> DataFrame:
    """The requests (with prompt and seed) and, in ``response``, what the backend made of each; null prompts are sent as empty.

    Rows go in batches of at most ``batch`` through one backend per task; the rows of a batch share its latency, as a
    batch call has only one.
    """
    names = requests.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live = backend()
        for frame in frames:
            out = []
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                began = time.perf_counter()
                answers = live.generate_batch([p or "" for p in part["prompt"]], [int(s) for s in part["seed"]])
                took = (time.perf_counter() - began) * 1_000
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} answers to {len(part)} requests")
                for text, first in answers:
                    payload, error, recovered = parse_text(text)
                    ok, _, _, missing, unexpected = validate(payload)
                    out.append((text, took, first, payload, error, recovered, ok, missing, unexpected))
            yield frame.assign(response=[dict(zip(_FIELDS, o, strict=True)) for o in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.select(*names).mapInPandas(run, f"{schema}, response struct<{_struct()}>")


_FIELDS = [part.split(" ")[0] for part in RESPONSE.split(", ")]


def _struct() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (part.split(" ", 1) for part in RESPONSE.split(", ")))


def prediction_rows(rows: DataFrame, stage: str, model: dict[str, str | None]) -> DataFrame:
    """The artefact of an evaluation: each row with its reference, the raw and the parsed output and what validation said of it.

    ``rows`` are generated rows with record_id, source_dataset, input_text and reference_payload; ``model`` names what
    made them and stands on every row.
    """
    r = "response"
    return rows.select(
        "record_id", F.lit(stage).alias("stage_label"), "source_dataset", "input_text", "reference_payload", F.col(f"{r}.text").alias("raw_output"), F.col(f"{r}.payload").alias("parsed_payload"), F.col(f"{r}.parse_error").alias("parse_error"),
        F.col(f"{r}.recovered").alias("json_recovery_used"), F.col(f"{r}.valid").alias("schema_is_valid"), F.col(f"{r}.missing").alias("missing_fields"), F.col(f"{r}.unexpected").alias("unexpected_fields"), F.col(f"{r}.latency_ms").alias("latency_ms"),
        *[F.lit(model.get(k)).cast("string").alias(k) for k in ("backend", "model_name_or_path", "base_model", "adapter_path", "merged_model_path")],
    )
