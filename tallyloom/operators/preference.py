"""Preference pairs: ranking, de-duplication, choice and gates over candidates of a record.

A candidate row has record_id, candidate_index, dedupe_key, text_key and the scorecard columns of evaluate.scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rationale
from ..functions.udfs import sequence_ratio
from ..sources.sinks import write_jsonl

GAPS = {
    "numeric_score_gap": ("numeric_score", 1), "parses_json_gap": ("parses", 1), "schema_valid_gap": ("valid", 1), "hallucinated_key_reduction": ("extra", -1), "structured_field_match_gap": ("matches", 1),
    "actions_f1_gap": ("actions_f1", 1), "summary_faithfulness_gap": ("summary_f1", 1), "null_handling_gap": ("null_errors", -1), "concision_gap": ("concise", 1), "summary_word_reduction": ("words", -1),
}
CARD = ("candidate_index", "parses", "valid", "extra", "matches", "actions_f1", "summary_f1", "null_errors", "words", "concise", "numeric_score", "failure_mode", "text_key")


def rank_key() -> Column:
    """The eleven ranking parts, better first; structs compare part by part."""
    minus = lambda c: -F.col(c).cast("double")
    return F.struct(
        (-F.col("parses").cast("int")).alias("a"), (-F.col("valid").cast("int")).alias("b"), (-(F.col("extra") == 0).cast("int")).alias("c"), F.col("extra").alias("d"), minus("matches").alias("e"), minus("actions_f1").alias("f"),
        minus("summary_f1").alias("g"), F.col("null_errors").alias("h"), F.col("words").alias("i"), minus("concise").alias("j"), F.col("text_key").alias("k"),
    )


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """Of equal candidates of a record the one with the least index."""
    rest = [c for c in candidates.columns if c not in ("record_id", "dedupe_key", "candidate_index")]
    best = candidates.groupBy("record_id", "dedupe_key").agg(F.min_by(F.struct("candidate_index", *rest), "candidate_index").alias("x"))
    return best.select("record_id", "dedupe_key", "x.*")


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Ranks 1..n per record. A record has as many candidates as generation rounds, so its window is small."""
    w = Window.partitionBy("record_id").orderBy("rank_key", "candidate_index")
    return candidates.withColumn("rank_key", rank_key()).withColumn("rank", F.row_number().over(w))


def pairs(ranked: DataFrame) -> DataFrame:
    """(record_id, n, chosen, second, rejected): rank 1, rank 2, and the last candidate that parses below rank 1, else the last."""
    card = F.struct(*CARD, "rank_key", "rank")
    return ranked.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("rank") == 1, card)).alias("chosen"),
        F.max(F.when(F.col("rank") == 2, card)).alias("second"),
        F.max_by(F.when(F.col("rank") > 1, card), F.when(F.col("rank") > 1, F.struct("parses", "rank"))).alias("rejected"),
    )


def skip_reason() -> Column:
    """Why a record gives no pair; null if it may."""
    same = lambda a, b: F.col(f"{a}.rank_key").eqNullSafe(F.col(f"{b}.rank_key"))
    return (
        F.when(F.col("n") < 2, "insufficient_distinct_candidates").when(~F.col("chosen.valid"), "no_schema_valid_candidate").when(same("chosen", "second"), "non_unique_top_candidate").when(F.col("rejected").isNull(), "insufficient_distinct_candidates").when(same("chosen", "rejected"), "no_strict_score_gap")
    )


def gated(df: DataFrame, minimum_gap: float = 0.0, max_similarity: float = 1.0, chosen_text: str | None = None, rejected_text: str | None = None, same_mode: bool = True) -> DataFrame:
    """Add ``skip_reason``: the choice's own reason, then the gates in order. The text similarity, a Python UDF, runs only on rows that passed the gate before it."""
    rows = df.withColumn("skip_reason", skip_reason())
    gap = F.col("chosen.numeric_score") - F.col("rejected.numeric_score")
    rows = rows.withColumn("skip_reason", F.coalesce("skip_reason", F.when(gap < minimum_gap, "score_gap_below_threshold")))
    if chosen_text and rejected_text:
        live = rows.where("skip_reason is null").withColumn("similarity_ratio", sequence_ratio(chosen_text, rejected_text))
        live = live.withColumn("skip_reason", F.when(F.col("similarity_ratio") >= max_similarity, "chosen_rejected_too_similar"))
        rows = live.unionByName(rows.where("skip_reason is not null").withColumn("similarity_ratio", F.lit(None).cast("double")))
    mode = (F.col("chosen.failure_mode") == F.col("rejected.failure_mode")) & (F.col("chosen.failure_mode") != "clean")
    return rows.withColumn("skip_reason", F.coalesce("skip_reason", F.when(mode & F.lit(same_mode), "same_failure_mode"), F.when(~F.col("chosen.valid"), "chosen_not_schema_valid")))


def gaps(df: DataFrame) -> DataFrame:
    """Ten component gaps of chosen over rejected, positive where chosen is better."""
    part = lambda side, c: F.col(f"{side}.{c}").cast("double")
    return df.select("*", *[((part("chosen", c) - part("rejected", c)) * sign).alias(name) for name, (c, sign) in GAPS.items()])


def mean_gaps(df: DataFrame) -> DataFrame:
    return gaps(df).agg(*[F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(n) for n in GAPS])


def pair_quality(df: DataFrame, source: str) -> DataFrame:
    """(source, rows, pairs, emission_rate), "overall" first by GROUPING SETS."""
    out = df.groupingSets([[], [F.col(source)]], source).agg(F.grouping(source).alias("g"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("skip_reason").isNull()).alias("pairs"))
    return out.select(F.when(F.col("g") == 1, "overall").otherwise(F.col(source)).alias(source), "rows", "pairs", F.round(F.col("pairs") / F.col("rows"), 6).alias("emission_rate"))


def completion_text(payload: Column, raw: Column) -> Column:
    """What is kept of a candidate: its normalised payload, or its raw text if there is none."""
    return F.coalesce(payload, raw)


def audit(ranked: DataFrame, gated_rows: DataFrame, generated: DataFrame) -> DataFrame:
    """One row per record with all its candidates in rank order, the choice, the gaps, and why it was made or not.

    ``generated`` is (record_id, generated): how many candidates there were before equal ones were dropped. A record has
    as many candidates as generation rounds, so the list is short.
    """
    shown = F.struct("rank", *CARD)
    per = ranked.groupBy("record_id").agg(
        F.sort_array(F.collect_list(shown)).alias("candidates"), F.count(F.lit(1)).alias("distinct_candidates"), F.count_if("parses").alias("parseable_json_count"), F.count_if("valid").alias("schema_valid_count")
    )
    emitted = F.col("skip_reason").isNull()
    told = gaps(gated_rows).withColumn("score_gap", F.when(emitted, F.struct(*GAPS))).withColumns({"chosen_index": F.when(emitted, F.col("chosen.candidate_index")), "rejected_index": F.when(emitted, F.col("rejected.candidate_index"))})
    why = F.when(emitted, rationale(F.col("chosen"), F.col("rejected"))).otherwise(F.concat(F.lit("Skipped because "), F.replace("skip_reason", F.lit("_"), F.lit(" ")), F.lit(".")))
    rows = told.select("record_id", "skip_reason", "chosen_index", "rejected_index", "score_gap", why.alias("decision_rationale"))
    return per.join(rows, "record_id").join(generated, "record_id").withColumn("dominant_failure_modes", F.transform("candidates", lambda c: c["failure_mode"]))


def run_summary(candidates: DataFrame, gated_rows: DataFrame, source: str) -> DataFrame:
    """(scope, rows, pairs, emission_rate, skipped, chosen_valid_rate, rejected_valid_rate, candidates, json_valid_rate, schema_pass_rate): the whole run ("overall") and each source.

    ``candidates`` are all that were generated, equal ones included, with the source.
    """
    live = F.col("skip_reason").isNull()
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    scope = lambda df: df.withColumn("scope", F.explode(F.array(F.lit("overall"), F.coalesce(F.col(source), F.lit("unknown")))))
    runs = scope(gated_rows).groupBy("scope").agg(F.count(F.lit(1)).alias("rows"), F.count_if(live).alias("pairs"), F.count_if(live & F.col("chosen.valid")).alias("__c"), F.count_if(live & F.col("rejected.valid")).alias("__r"))
    made = scope(candidates).groupBy("scope").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("parses").alias("__p"), F.count_if("valid").alias("__v"))
    return runs.join(made, "scope", "left").select(
        "scope", "rows", "pairs", rate(F.col("pairs"), F.col("rows")).alias("emission_rate"), (F.col("rows") - F.col("pairs")).alias("skipped"), rate(F.col("__c"), F.col("pairs")).alias("chosen_valid_rate"), rate(F.col("__r"), F.col("pairs")).alias("rejected_valid_rate"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"), rate(F.col("__p"), F.col("candidates")).alias("json_valid_rate"), rate(F.col("__v"), F.col("candidates")).alias("schema_pass_rate"),
    )


def write_artifacts(directory: str, pairs_rows: DataFrame, audit_rows: DataFrame, summary_rows: DataFrame) -> dict[str, str]:
    """Pairs and audit rows as folders of JSON lines, the summary, a row per source, as one folder of JSON lines."""
    paths = {k: f"{directory}/{k}" for k in ("pairs", "audit", "summary")}
    for k, df, order in (("pairs", pairs_rows, "record_id"), ("audit", audit_rows, "record_id"), ("summary", summary_rows, "scope")):
        write_jsonl(df, paths[k], [order])
    return paths
