"""Prompt sets for serving benchmarks and training telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import augment, profile, sampling

COLUMNS = ("record_id", "lineage_record_id", "input_text", "prompt_token_length", "bucket_label", "length_family", "benchmark_variant")


def promptset(records: DataFrame, natural: int, stress: int, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """Natural prompts in hash order with a length bucket, and long variants of short and medium ones.

    ``tokens`` counts the tokens of ``input_text``; white-space pieces of the rendered prompt unless given. Bucket cutoffs
    come from the natural prompts; a variant longer than the upper cutoff is labelled stress_long.
    """
    count = tokens if tokens is not None else F.size(X.space_tokens(X.prompt(F.col("input_text"))))
    base = sampling.hash_top_n(records.where(F.col("input_text").isNotNull()).select("record_id", "input_text"), "record_id", seed, natural).withColumn("prompt_token_length", count)
    bucketed = profile.length_buckets(base, "prompt_token_length")
    rows = bucketed.select("record_id", F.col("record_id").alias("lineage_record_id"), "input_text", "prompt_token_length", "bucket_label", F.lit("natural").alias("length_family"), F.lit(None).cast("string").alias("benchmark_variant"))
    picked = sampling.hash_top_n(bucketed.where(F.col("bucket_label").isin("short", "medium")).select("record_id", "input_text"), "record_id", seed, stress)
    high = profile.ordered_value(base, [], "prompt_token_length", profile.rank_floor(0.66), "__high")
    longer = augment.stress_rows(picked, seed).withColumn("prompt_token_length", count).crossJoin(F.broadcast(high))  # one row
    label = F.when(F.col("prompt_token_length") > F.col("__high"), "stress_long").otherwise("stress_short")
    return rows.unionByName(longer.select("record_id", "lineage_record_id", "input_text", "prompt_token_length", label.alias("bucket_label"), F.lit("stress").alias("length_family"), "benchmark_variant"))


def median_and_p90(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The interpolating median and the floored 90 % index per key."""
    return df.groupBy(*keys).agg(F.median(value).alias("median")).join(profile.ordered_value(df, keys, value, profile.rank_floor(0.9), "p90"), keys)


def telemetry(history: DataFrame, batch: int, accumulation: int, mean_tokens: float) -> DataFrame:
    """Examples and tokens seen at every step of a training log."""
    seen = F.col("step") * batch * accumulation
    return history.withColumns({"examples_seen": seen, "tokens_seen": seen * mean_tokens})


def training_series(log: DataFrame) -> DataFrame:
    """(step, metric, value): loss, or train_loss where there is none and no eval_loss; eval_loss; learning rate."""
    from .serving import history

    num = lambda c: F.col(c).try_cast("double")
    rows = log.select("step", F.coalesce(num("loss"), F.when(num("eval_loss").isNull(), num("train_loss"))).alias("loss"), num("eval_loss").alias("eval_loss"), num("learning_rate").alias("learning_rate"))
    return history(rows, "step", ["loss", "eval_loss", "learning_rate"])
