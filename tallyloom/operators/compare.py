"""Comparison of evaluation stages: joins by record, evidence, case studies, regressions, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def staged(scored: DataFrame, stage: str, name: str, score: str = "penalised_score") -> DataFrame:
    """(record_id, {name}_score, _syntax, _exact, _output): one row per record of a stage, the last by ``ordinal`` if there is one."""
    cols = [F.col(score).alias("score"), F.col("syntax").alias("syntax"), F.col("exact").alias("exact"), F.col("raw_output").alias("output")]
    rows = scored.where(F.col("stage") == stage)
    order = F.col("ordinal") if "ordinal" in scored.columns else F.lit(0)
    last = rows.groupBy("record_id").agg(F.max(F.struct(order.alias("o"), *cols)).alias("x"))
    return last.select("record_id", *[F.col(f"x.{c}").alias(f"{name}_{c}") for c in ("score", "syntax", "exact", "output")])


def three_way(scored: DataFrame, stages: tuple[str, str, str] = ("baseline", "sft", "dpo"), score: str = "penalised_score") -> DataFrame:
    """The records that all three stages predicted, side by side (prefixes b, s, d).

    An inner join of three filters of one table is one aggregation by record: the table is read once and exchanged once,
    and of repeated records of a stage the last by ``ordinal`` counts, as in :func:`staged`.
    """
    cols = {"score": F.col(score), "syntax": F.col("syntax"), "exact": F.col("exact"), "output": F.col("raw_output")}
    order = F.col("ordinal") if "ordinal" in scored.columns else F.lit(0)
    row = F.struct(order.alias("o"), *[c.alias(n) for n, c in cols.items()])
    sides = scored.groupBy("record_id").agg(*[F.max(F.when(F.col("stage") == st, row)).alias(n) for st, n in zip(stages, "bsd", strict=True)])
    return sides.where("record_id is not null and b is not null and s is not null and d is not null").select("record_id", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "bsd" for c in cols])


def evidence(joined: DataFrame, k: int = 3) -> DataFrame:
    """The k clearest records per class; a record is in the first class that fits."""
    up, down = F.col("d_score") > F.col("s_score") + EPS, F.col("d_score") + EPS < F.col("s_score")
    better, worse = F.col("d_syntax") > F.col("s_syntax"), F.col("d_syntax") < F.col("s_syntax")
    kind = F.when(up & ~worse, "semantic_gain").when(better & ~up & ~down, "syntax_gain_only").when(down, "semantic_regression").when(worse | ~F.col("d_output").eqNullSafe(F.col("s_output")), "mixed_result")
    delta = F.col("d_score") - F.col("s_score")
    code = F.col("d_syntax.a") * 4 + F.col("d_syntax.b") * 2 + F.col("d_syntax.c")
    first = F.when(kind == "semantic_gain", -delta).when(kind == "syntax_gain_only", -code.cast("double")).otherwise(delta)
    second = F.when(kind == "syntax_gain_only", F.col("d_score")).when(kind == "mixed_result", code.cast("double")).otherwise(F.lit(0.0))
    rows = joined.withColumns({"evidence": kind, "__a": F.round(first, 9), "__b": F.round(second, 9)}).where("evidence is not null")
    return top_per(rows, "evidence", ["__a", "__b", "record_id"], k, "place").select("evidence", "place", "record_id", F.round(F.col("s_score"), 4).alias("s_score"), F.round(F.col("d_score"), 4).alias("d_score"))


def case_studies(joined: DataFrame, k: int = 3) -> DataFrame:
    """The k strongest records in each of five categories; a record may stand in several."""
    b, s, d = F.col("b_score"), F.col("s_score"), F.col("d_score")
    clean = F.struct(F.lit(1).alias("a"), F.lit(1).alias("b"), F.lit(1).alias("c"))
    good = (F.col("s_syntax") >= clean) & (s >= 0.75)
    fell = F.col("d_syntax") < F.col("s_syntax")
    rose = F.col("d_syntax") > F.col("s_syntax")
    weak = (b < 0.5) & (s < 0.5) & (d < 0.5) & ~F.col("b_exact") & ~F.col("s_exact") & ~F.col("d_exact")
    case = lambda ok, name, weight: F.when(ok, F.struct(F.lit(name).alias("category"), F.round(weight, 9).alias("weight")))
    cases = F.array_compact(
        F.array(
            case(~F.col("b_exact") & F.col("s_exact"), "baseline_bad_to_sft_good", s - b),
            case(good & (d > s + EPS) & (F.col("d_syntax") >= F.col("s_syntax")), "sft_good_to_dpo_better", d - s),
            case(good & ((d + EPS < s) | fell), "sft_good_to_dpo_worse", s - d + fell.cast("int")),
            case(rose & (F.abs(d - s) <= EPS), "syntax_cleaned_up_semantics_unchanged", F.lit(1.0)),
            case(weak, "unchanged_hard_failures", 1.5 - F.greatest(b, s, d)),
        )
    )
    rows = joined.select("record_id", F.explode(cases).alias("c")).select("record_id", "c.category", "c.weight").withColumn("__a", -F.col("weight"))
    return top_per(rows, "category", ["__a", "record_id"], k, "place").select("category", "place", "record_id", F.round("weight", 6).alias("weight"))


def top_per(df: DataFrame, key: str, order: list[str], k: int, out: str) -> DataFrame:
    """The first k rows per key. Spark keeps only k rows per key and partition before the shuffle (window group limit)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(out) <= k)


def regressions(joined: DataFrame, k: int = 5, prior: str = "s", current: str = "d") -> DataFrame:
    """The k records that lost most against the prior stage, in syntax or score."""
    delta = F.col(f"{current}_score") - F.col(f"{prior}_score")
    worse = (F.col(f"{current}_syntax") < F.col(f"{prior}_syntax")) | (F.col(f"{current}_score") + EPS < F.col(f"{prior}_score"))
    rows = joined.where(worse).withColumn("delta", F.round(delta, 6))
    return rows.orderBy("delta", f"{current}_syntax", "record_id").limit(k).select("record_id", "delta")


def stage_deltas(metrics: DataFrame, key: str, value: str, stages: tuple[str, ...] = ("baseline", "sft", "dpo")) -> DataFrame:
    """One row per key of the first stage, a column per stage, and differences; null where a stage lacks the key."""
    wide = metrics.groupBy(key).pivot("stage", list(stages)).agg(F.first(value)).where(F.col(stages[0]).isNotNull())
    gap = lambda a, b: F.round(F.col(b) - F.col(a), 6)
    return wide.withColumns({"sft_minus_baseline": gap(stages[0], stages[1]), "dpo_minus_sft": gap(stages[1], stages[2]), "dpo_minus_baseline": gap(stages[0], stages[2])})


def bucket_matrix(counts: DataFrame, stages: tuple[str, ...] = ("baseline", "sft", "dpo")) -> DataFrame:
    """All bucket labels of any stage, missing counts as 0."""
    return counts.groupBy("bucket").pivot("stage", list(stages)).agg(F.sum("rows")).na.fill(0)


def zip_join(left: DataFrame, right: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows of equal ordinal side by side; different lengths are an error, as a strict zip's."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows against {b}")
    return left.join(right, ordinal)


def struct_code(s: Column) -> Column:
    return s["a"] * 4 + s["b"] * 2 + s["c"]
