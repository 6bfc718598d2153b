"""Markdown reports of results that are small by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import markdown_table


def single_run(name: str, rates: DataFrame, prf: DataFrame, buckets: DataFrame, failures: DataFrame, examples: int = 5) -> str:
    """Rates, per-field metrics, failure buckets and the first ``examples`` failures by record id."""
    first = failures.select("record_id").distinct().orderBy("record_id").limit(examples)
    parts = [("Rates", rates), ("Fields", prf.orderBy("field")), ("Failure buckets", buckets.orderBy("bucket")), (f"First {examples} failures", first)]
    return f"# Run {name}\n\n" + "\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts)


def comparison(deltas: DataFrame, evidence: DataFrame, matrix: DataFrame) -> str:
    parts = [("Field F1 by stage", deltas.orderBy(deltas.columns[0])), ("Evidence", evidence.orderBy("evidence", "place")), ("Failure buckets by stage", matrix.orderBy("bucket"))]
    return "# Comparison of stages\n\n" + "\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts)


def experiment_summary(summary: DataFrame, buckets: DataFrame, experiment: str) -> DataFrame:
    """A wide row per experiment: its summary with the p99 of every length bucket, and the ratio of short to long."""
    wide = buckets.groupBy(experiment).pivot("bucket_label", ["short", "medium", "long"]).agg(F.first("p99"))
    named = wide.select(experiment, *[F.col(b).alias(f"{b}_p99_ms") for b in ("short", "medium", "long")])
    return summary.join(named, experiment, "left").withColumn("short_to_long_p99_ratio", F.round(F.try_divide("short_p99_ms", "long_p99_ms"), 6))


def failures_by_experiment(requests: DataFrame, experiment: str, k: int = 10) -> DataFrame:
    """The k experiments with most failed requests, ties by name."""
    return requests.where(~F.col("success")).groupBy(experiment).agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), experiment).limit(k)


def best_row(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """The row with the greatest metric, of equal ones the first by ``tie``."""
    return df.orderBy(F.desc_nulls_last(metric), tie).limit(1)


def composition_table(composition: DataFrame) -> DataFrame:
    """The saved composition lines as a table of rates of four decimals."""
    return composition.select("source_dataset", "split", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("synthetic_row_count", F.lit(0)).alias("synthetic_row_count"), F.round(F.coalesce("synthetic_row_rate", F.lit(0.0)), 4).alias("synthetic_row_rate"))


def stage_summary(rates: DataFrame, prf: DataFrame, macro: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """(stage, syntax, semantic, latency): one row per stage with its metrics as structs, from the stage's rates, micro and macro scores and latency figures."""
    micro = prf.where("field = 'micro'").select("stage", F.col("f1").alias("micro_f1"))
    out = rates.join(micro, "stage", "left").join(macro.select("stage", "macro_f1"), "stage", "left")
    names = [c for c in rates.columns if c.startswith("exact_")]
    syntax = F.struct("json_validity_rate", "schema_pass_rate", "hallucinated_rate")
    semantic = F.struct("micro_f1", "macro_f1", F.struct(*names).alias("exact_match"))
    out = out.select("stage", "rows", syntax.alias("syntax"), semantic.alias("semantic"))
    if latency is None:
        return out.withColumn("latency", F.lit(None).cast("struct<mean:double,p50:double,p95:double>"))
    return out.join(latency.select("stage", F.struct("mean", "p50", "p95").alias("latency")), "stage", "left")


def stage_table(summary: DataFrame, order: tuple[str, ...] = ("baseline", "sft", "dpo")) -> DataFrame:
    """The table of a report: eight rounded columns per stage, stages in their fixed order, absent ones left out."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    four = lambda c: F.round(c, 4).alias(c.split(".")[-1])
    rows = summary.where(place > 0).orderBy(place)
    return rows.select("stage", *[four(c) for c in ("syntax.json_validity_rate", "syntax.schema_pass_rate", "syntax.hallucinated_rate", "semantic.micro_f1", "semantic.macro_f1")], F.round("latency.mean", 2).alias("latency_mean_ms"), F.round("latency.p95", 2).alias("latency_p95_ms"))


def bundle(stages: dict[str, dict[str, DataFrame | None]], shared: dict[str, DataFrame | None]) -> tuple[dict[str, DataFrame], list[tuple[str, str, bool]]]:
    """(frames by "stage/kind", availability rows) of the parts of a report that were found; what is absent is told, not an error."""
    parts = {f"{stage}/{kind}": df for stage, kinds in stages.items() for kind, df in kinds.items()} | {f"all/{kind}": df for kind, df in shared.items()}
    return {k: df for k, df in parts.items() if df is not None}, [(*k.split("/", 1), df is not None) for k, df in parts.items()]


def final_report(composition: DataFrame, stages: DataFrame, deltas: DataFrame, matrix: DataFrame, cases: DataFrame, available: list[tuple[str, str, bool]] = ()) -> str:
    """The closing report: data, stages, what changed between them, failures, cases, and which parts were missing."""
    parts = [("Data", composition.orderBy("source_dataset", "split")), ("Stages", stages), ("Field F1 by stage", deltas.orderBy(deltas.columns[0])), ("Failure buckets by stage", matrix.orderBy("bucket")), ("Case studies", cases.orderBy("category", "place"))]
    missing = [f"- {stage}: {kind}" for stage, kind, there in available if not there]
    text = "# Final report\n\n" + "\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts)
    return text + ("\n## Not available\n\n" + "\n".join(missing) + "\n" if missing else "")
