"""Rows of the manifests that training, preference labelling and inference read, and the exchange format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.udfs import validate_payload
from ..schema import TARGET
from ..sources.sinks import payload_json
from . import sampling

#: Settings of a generation request unless others are given (fixed values).
GENERATION = {"max_new_tokens": 256, "temperature": 0.7, "top_p": 0.95, "do_sample": True}


def _text(df: DataFrame, name: str) -> Column:
    """A column as text, empty where it is null or absent."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def named_rows(df: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Rows without an id are named by their place in the given order, from 1."""
    if "record_id" not in df.columns:
        df = df.withColumn("record_id", F.lit(None).cast("string"))
    placed = sampling.chunks(df, order, 1).withColumn("record_id", F.coalesce("record_id", F.concat(F.lit(prefix), (F.col("chunk") + 1).cast("string"))))
    return placed.drop("chunk")


def training_rows(df: DataFrame, shape: str, held_out: bool = False, percent: float | None = None, limit: int | None = None, seed: int = 17, order: list[str] | None = None) -> DataFrame:
    """The rows that a trainer reads, in one of two shapes; ``percent`` and ``limit`` draw a subset in hash order first.

    ``prompt_completion`` gives (record_id, prompt, completion), missing texts as empty strings and a held-out row's
    reference as its completion; ``messages`` gives (record_id, prompt, completion) as lists of turns, the last turn being
    the completion (null where it is not the assistant's). With ``order`` rows without an id are named row-N or eval-N.
    """
    if shape not in ("prompt_completion", "messages"):
        raise ValueError(f"unknown shape {shape!r}")
    if percent is not None:
        df = sampling.percent_subset(df, "record_id", percent, seed, limit)
    if order:
        df = named_rows(df, "eval-" if held_out else "row-", order)
    if shape == "prompt_completion":
        return df.select("record_id", _text(df, "prompt").alias("prompt"), _text(df, "reference_json" if held_out else "completion").alias("completion"))
    talk = df.withColumn("__c", X.conversation(F.col("messages")))
    return talk.select("record_id", F.col("__c.prompt").alias("prompt"), F.col("__c.completion").alias("completion"))


def preference_rows(df: DataFrame, strict: bool = True) -> DataFrame:
    """(prompt, chosen, rejected); a row with an empty part fails the query when it is read, or is left out if not ``strict``."""
    parts = df.select(*[_text(df, c).alias(c) for c in ("prompt", "chosen", "rejected")])
    whole = (F.col("prompt") != "") & (F.col("chosen") != "") & (F.col("rejected") != "")
    if not strict:
        return parts.where(whole)
    return parts.withColumn("prompt", F.when(whole, F.col("prompt")).otherwise(F.raise_error(F.lit("a preference row needs a prompt, a chosen and a rejected answer"))))


def split_rows(df: DataFrame, split: str, percent: float | None = None, limit: int | None = None, seed: int = 17) -> DataFrame:
    """The rows of a split, or an exact share of them in hash order."""
    rows = df.where(F.col("split") == split)
    return rows if percent is None and limit is None else sampling.percent_subset(rows, "record_id", percent or 1.0, seed, limit)


def to_exchange(df: DataFrame) -> DataFrame:
    """Canonical rows in the exchange format (record_id, input, output, system): the user prompt, the payload, the instruction."""
    return df.select("record_id", X.user_prompt(F.col("input_text")).alias("input"), payload_json(F.col("target"), df.schema["target"].dataType).alias("output"), F.lit(X.SYSTEM_TEXT).alias("system"))


def from_exchange(df: DataFrame, split: str = "train", source_dataset: str = "exchange") -> DataFrame:
    """Canonical rows (record_id, split, source_dataset, input_text, target, metadata, reason) of rows in the exchange format.

    The instruction is kept in the metadata as ``source_system``; an output that is no valid payload is told as ``reason``.
    """
    has = lambda c, other: F.col(c) if c in df.columns else other
    checked = df.withColumn("__v", validate_payload(F.col("output")))
    system = F.when(_text(df, "system") != "", F.create_map(F.lit("source_system"), _text(df, "system"))).otherwise(F.create_map().cast("map<string,string>"))
    own = F.coalesce(has("metadata", F.lit(None).cast("map<string,string>")), F.create_map().cast("map<string,string>"))
    return checked.select(
        "record_id", F.coalesce(has("split", F.lit(None)), F.lit(split)).alias("split"), F.coalesce(has("source_dataset", F.lit(None)), F.lit(source_dataset)).alias("source_dataset"), F.col("input").alias("input_text"),
        F.from_json("__v.normalized", TARGET).alias("target"), F.map_concat(F.map_filter(own, lambda k, _: k != "source_system"), system).alias("metadata"), F.when(~F.col("__v.is_valid"), "invalid_target").alias("reason"),
    )


def preference_placeholders(df: DataFrame) -> DataFrame:
    """One row per record that waits to be labelled: its prompt and reference, no answers yet."""
    nothing = F.lit(None).cast("string")
    return df.select("record_id", X.prompt(F.col("input_text")).alias("prompt"), payload_json(F.col("target"), df.schema["target"].dataType).alias("reference_completion"), nothing.alias("chosen"), nothing.alias("rejected"), F.lit("todo").alias("labeling_status"))


def labelled(df: DataFrame) -> DataFrame:
    """Pairs (record_id, prompt, chosen, rejected) as labelled rows; the chosen answer is the reference."""
    return df.select("record_id", "prompt", F.col("chosen").alias("reference_completion"), "chosen", "rejected", F.lit("labeled").alias("labeling_status"))


def prompt_text(df: DataFrame) -> Column:
    """The text that was sent for a row: its prompt if it is not blank, else the contents of its messages in lines, else the input text."""
    none = F.lit(None).cast("string")
    prompt = F.when(X.clean(F.col("prompt")) != "", F.col("prompt")) if "prompt" in df.columns else none
    told = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n") if "messages" in df.columns else none
    return F.coalesce(prompt, told, F.col("input_text") if "input_text" in df.columns else none, F.lit(""))


def requests(df: DataFrame, rounds: int, base_seed: int, prompt_source: str = "prompt", generation: dict | None = None) -> DataFrame:
    """Every row times ``rounds`` generation requests: candidate_index from 0 and the seed that goes with it.

    ``messages`` go along only if they are the prompt source; the settings of the generation stand beside the prompt.
    """
    settings = {**GENERATION, **(generation or {})}
    turns = F.col("messages") if prompt_source == "messages" else F.lit(None).cast("array<struct<role:string,content:string>>")
    out = df.select("record_id", F.col("prompt"), turns.alias("messages"), F.explode(F.sequence(F.lit(0), F.lit(max(1, rounds) - 1))).alias("candidate_index"))
    return out.withColumns({"seed": F.col("candidate_index") + base_seed, "prompt_source": F.lit(prompt_source), **{k: F.lit(v) for k, v in settings.items()}})
