"""Analytics of request logs and experiment plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import profile


def workload_summary(requests: DataFrame, keys: list[str], latency: str, success: str, elapsed: Column | None = None) -> DataFrame:
    """Counts, success rate, throughput (all requests, and successful ones, per second) and nearest-rank percentiles of successful requests."""
    counts = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("request_count"), F.count_if(F.col(success)).alias("success_count"), *([elapsed.alias("elapsed_s")] if elapsed is not None else []))
    ranks = profile.ordered_values(requests.where(F.col(success)), keys, latency, {"p50": profile.rank_ceil(0.5), "p90": profile.rank_ceil(0.9), "p99": profile.rank_ceil(0.99)}).withColumnsRenamed({k: f"__{k}" for k in keys})
    out = counts.join(ranks, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys]) if keys else counts.crossJoin(F.broadcast(ranks))
    out = out.withColumns({"success_rate": F.round(F.col("success_count") / F.col("request_count"), 6), "tail_inflation": F.round(F.try_divide(F.col("p99"), F.col("p50")), 6)})
    if elapsed is not None:
        out = out.withColumns({"throughput_rps": F.coalesce(F.try_divide(F.col("request_count"), F.col("elapsed_s")), F.lit(0.0)), "success_rps": F.coalesce(F.try_divide(F.col("success_count"), F.col("elapsed_s")), F.lit(0.0))})
    return out


def correctness(requests: DataFrame, sample: DataFrame, fields: list[str]) -> DataFrame:
    """Parse, schema and per-field match rates of sampled successes; null matches do not count."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return requests.join(sample, "record_id", "left_semi").agg(F.count(F.lit(1)).alias("sampled"), F.coalesce(mean("parses"), F.lit(0.0)).alias("json_parse_pass_rate"), F.coalesce(mean("valid"), F.lit(0.0)).alias("schema_pass_rate"), *[mean(f).alias(f) for f in fields])


def tuned_config(rows: DataFrame, floor_ratio: float) -> DataFrame:
    """Of the configurations with at least ``floor_ratio`` of the best throughput the one with the least short p99."""
    best = F.max(F.coalesce("throughput_rps", F.lit(0.0))).over(Window.partitionBy())  # one row per configuration
    fit = rows.withColumn("__best", best).where(F.coalesce("throughput_rps", F.lit(0.0)) >= F.col("__best") * floor_ratio)
    return fit.orderBy(F.coalesce("short_p99_ms", F.lit(1e18)), F.desc("throughput_rps"), "max_num_batched_tokens", "max_num_seqs").limit(1).drop("__best")


def plan(spark, **axes: list) -> DataFrame:
    """The product of small literal axes."""
    out = None
    for name, values in axes.items():
        side = spark.createDataFrame([(v,) for v in values], [name])
        out = side if out is None else out.crossJoin(side)
    return out


def remaining(plan_rows: DataFrame, done: DataFrame, step: str = "step_id") -> DataFrame:
    return plan_rows.join(done, step, "left_anti")


def request_ids(rows: DataFrame, experiment: str, order: str) -> DataFrame:
    """Sequential request ids of one workload (a bounded set of prompts)."""
    n = F.row_number().over(Window.partitionBy(F.lit(experiment)).orderBy(order)) - 1
    return rows.withColumn("request_id", F.format_string("%s-%05d", F.lit(experiment), n))


def context_budget(prompt_tokens: Column, user_tokens: Column, max_len: int = 2048, margin: int = 32, least: int = 96, wanted: int = 256, head_share: float = 0.55) -> Column:
    """(kept, head, tail, output_tokens, trimmed, reason) for a prompt of so many tokens of which so many are the user's."""
    room = F.lit(max_len - margin) - prompt_tokens
    most = F.greatest(F.lit(0), F.lit(max_len - margin - least) - (prompt_tokens - user_tokens))
    head = F.floor(most * F.lit(head_share)).cast("int")
    fits, shrinks = room >= least, user_tokens <= most
    kept = F.when(fits | shrinks, user_tokens).otherwise(most)
    after = F.greatest(F.lit(1), F.lit(max_len - margin) - (prompt_tokens - user_tokens + kept))
    output = F.when(fits, F.greatest(F.lit(1), F.least(F.lit(wanted), room))).when(shrinks, F.greatest(F.lit(1), F.least(F.lit(wanted), F.lit(least)))).otherwise(F.greatest(F.lit(1), F.least(F.lit(wanted), after)))
    reason = F.when(fits, F.lit(None).cast("string")).when(shrinks, "output_shrunk_to_minimum").otherwise("trimmed_user_ticket_text")
    return F.struct(kept.cast("int").alias("kept"), F.when(fits | shrinks, user_tokens).otherwise(head).cast("int").alias("head"), F.when(fits | shrinks, F.lit(0)).otherwise(most - head).cast("int").alias("tail"), output.cast("int").alias("output_tokens"), (user_tokens - kept).cast("int").alias("trimmed"), reason.alias("reason"))


def cut_tokens(tokens: Column, budget: Column) -> Column:
    """The head and tail tokens that a budget keeps."""
    whole = budget["trimmed"] == 0
    tail = F.when(budget["tail"] > 0, F.slice(tokens, -budget["tail"], budget["tail"])).otherwise(F.slice(tokens, F.lit(1), F.lit(0)))
    return F.when(whole, tokens).otherwise(F.concat(F.slice(tokens, F.lit(1), budget["head"]), tail))


def history(log: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    """(step, metric, value) of a log, values that are no numbers left out."""
    return log.select(F.col(step).cast("double").alias("step"), *[F.col(m).try_cast("double").alias(m) for m in metrics]).unpivot("step", metrics, "metric", "value").where("value is not null")
