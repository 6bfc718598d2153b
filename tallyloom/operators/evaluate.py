"""Evaluation of predictions against references.

A prediction row has ``p`` and ``r`` structs with the eight scalar fields (dots in names become underscores) and the
action lists, and the flags parses, valid and extra (number of unexpected keys). All metrics read it in one pass each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..schema import EXACT_FIELDS, LIST_FIELD, NULLABLE_FIELDS, SCALAR_FIELDS


def column(field: str) -> str:
    return field.replace(".", "_")


def flat_payload(target: Column) -> Column:
    """The payload struct as one level of columns; booleans as "True" and "False" so that fields share a type."""
    text = lambda f: F.when(target["requires_human_followup"], "True").when(~target["requires_human_followup"], "False") if f == "requires_human_followup" else target["customer"][f.split(".")[1]] if "." in f else target[f]
    return F.struct(*[text(f).alias(column(f)) for f in SCALAR_FIELDS], target["actions_requested"].alias(LIST_FIELD), target["summary"].alias("summary"))


def matches(p: Column, r: Column) -> Column:
    """How many scalar fields agree; missing and null are the same here."""
    out = F.lit(0)
    for f in SCALAR_FIELDS:
        out = out + p[column(f)].eqNullSafe(r[column(f)]).cast("int")
    return out


def null_mistakes(p: Column, r: Column) -> Column:
    return S.null_errors({f: p[column(f)] for f in NULLABLE_FIELDS}, {f: r[column(f)] for f in NULLABLE_FIELDS})


def differs(p: Column, r: Column) -> Column:
    return (matches(p, r) < len(SCALAR_FIELDS)) | ~p[LIST_FIELD].eqNullSafe(r[LIST_FIELD]) | ~p["summary"].eqNullSafe(r["summary"])


def scored(df: DataFrame) -> DataFrame:
    """Add matches, null_errors, actions_f1, summary_f1, words, concise, numeric_score, failure_mode, semantic_score, penalised_score, syntax, exact, labels."""
    p, r = F.col("p"), F.col("r")
    both = df.withColumns({"matches": matches(p, r), "null_errors": null_mistakes(p, r), "actions_f1": S.set_f1(p[LIST_FIELD], r[LIST_FIELD]), "__pt": _tokens(p), "__rt": _tokens(r), "__diff": differs(p, r)})
    both = both.withColumns({"summary_f1": S.bag_f1(F.col("__pt"), F.col("__rt")), "words": F.size("__pt"), "concise": S.concision(F.size("__pt"))})
    flag = lambda c: F.col(c).cast("int")
    return both.withColumns(
        {
            "numeric_score": S.rubric(F.col("parses"), F.col("valid"), F.col("extra"), F.col("matches"), F.col("actions_f1"), F.col("summary_f1"), F.col("null_errors"), F.col("concise")),
            "failure_mode": S.failure_mode(F.col("parses"), F.col("valid"), F.col("extra"), F.col("null_errors"), F.col("matches"), F.col("actions_f1")),
            "semantic_score": S.semantic_score(F.col("matches"), F.col("actions_f1")),
            "penalised_score": S.semantic_score(F.col("matches"), F.col("actions_f1"), F.col("null_errors")),
            "syntax": F.struct(flag("parses").alias("a"), flag("valid").alias("b"), (F.col("extra") == 0).cast("int").alias("c")),
            "exact": F.col("parses") & F.col("valid") & (F.col("extra") == 0) & ~F.col("__diff"),
            "labels": S.bucket_labels(F.col("parses"), F.col("valid"), F.col("extra"), F.col("__diff"), F.col("null_errors"), p[LIST_FIELD], r[LIST_FIELD]),
        }
    ).drop("__pt", "__rt", "__diff")


def _tokens(side: Column) -> Column:
    from ..functions.text import word_tokens

    return word_tokens(side["summary"])


def failures(df: DataFrame) -> DataFrame:
    """Rows that do not parse, are not valid or differ from the reference."""
    return df.where(~F.col("parses") | ~F.col("valid") | differs(F.col("p"), F.col("r")))


def field_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, field, tp, fp, fn) per field, "micro" over all fields, by one explode and GROUPING SETS."""
    p, r = F.col("p"), F.col("r")

    def one(f: str) -> Column:
        a, b = p[column(f)], r[column(f)]
        same = a.eqNullSafe(b)
        return F.struct(F.lit(f).alias("field"), same.cast("int").alias("tp"), (~same & a.isNotNull()).cast("int").alias("fp"), (~same & b.isNotNull()).cast("int").alias("fn"))

    listed = S.set_counts(p[LIST_FIELD], r[LIST_FIELD])
    actions = F.struct(F.lit(LIST_FIELD).alias("field"), listed["tp"].alias("tp"), listed["fp"].alias("fp"), listed["fn"].alias("fn"))
    keys = keys or []
    flat = df.select(*keys, F.inline(F.array(*[one(f) for f in SCALAR_FIELDS], actions)))
    grouped = flat.groupingSets([[*map(F.col, keys), F.col("field")], [*map(F.col, keys)]], *keys, "field")
    return grouped.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).withColumn("field", F.coalesce("field", F.lit("micro")))


def prf(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and support."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": F.round(S.ratio(tp, tp + fp), 6), "recall": F.round(S.ratio(tp, tp + fn), 6), "f1": F.round(S.f1(tp, fp, fn), 6), "support": tp + fn})


def macro(counts: DataFrame, keys: list[str]) -> DataFrame:
    rows = prf(counts).where("field <> 'micro'")
    return rows.groupBy(*keys).agg(F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def rates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Validity, schema pass, hallucination and exact-match rates; 0 where there are no rows."""
    mean = lambda c, n: F.round(F.coalesce(F.avg(c.cast("int")), F.lit(0.0)), 6).alias(n)
    p, r = F.col("p"), F.col("r")
    exact = [mean(p[column(f)].eqNullSafe(r[column(f)]), f"exact_{column(f)}") for f in EXACT_FIELDS]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), mean(F.col("parses"), "json_validity_rate"), mean(F.col("valid"), "schema_pass_rate"), mean(F.col("extra") > 0, "hallucinated_rate"), *exact)


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, reference, predicted, rows) of the exact-match fields; null is written None."""
    p, r = F.col("p"), F.col("r")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(r[column(f)], F.lit("None")).alias("reference"), F.coalesce(p[column(f)], F.lit("None")).alias("predicted")) for f in EXACT_FIELDS])
    return df.select(*keys, F.inline(cells)).groupBy(*keys, "field", "reference", "predicted").agg(F.count(F.lit(1)).alias("rows"))


def field_errors(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, missing, mismatch, null_handling_mistake); action lists mismatch when their order differs."""
    p, r = F.col("p"), F.col("r")

    def one(f: str) -> Column:
        a, b = p[column(f)], r[column(f)]
        null = b.isNull() & a.isNotNull() & (a != "") if f in NULLABLE_FIELDS else F.lit(False)
        return F.struct(F.lit(f).alias("field"), (b.isNotNull() & a.isNull()).alias("m"), (~a.eqNullSafe(b)).alias("x"), null.alias("n"))

    flat = df.select(*keys, F.inline(F.array(*[one(f) for f in [*SCALAR_FIELDS, LIST_FIELD]])))
    return flat.groupBy(*keys, "field").agg(F.count_if("m").alias("missing"), F.count_if("x").alias("mismatch"), F.count_if("n").alias("null_handling_mistake"))


def bucket_counts(scored_rows: DataFrame, keys: list[str]) -> DataFrame:
    return scored_rows.select(*keys, F.explode("labels").alias("bucket")).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("rows"))


def path_token(variant: Column, path: str) -> Column:
    """A token of the value at a JSON path: null if the path is missing, "path=null" for JSON null, so that true and 1 differ."""
    v = F.try_variant_get(variant, path, "variant")
    return F.when(v.isNotNull() | F.is_variant_null(v), F.concat(F.lit(path + "="), F.coalesce(F.to_json(v), F.lit("null"))))


def document(df: DataFrame, keys: list[str], latency: str | None = None) -> DataFrame:
    """One row per key with everything an evaluation tells: rows, rates, scores per field, micro and macro scores, bucket counts, latency.

    Four aggregations of the same rows that meet on the key; each is small.
    """
    counts = field_counts(df, keys)
    scores = prf(counts)
    fields = scores.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.struct("tp", "fp", "fn", "precision", "recall", "f1", "support").alias("s"))))).alias("fields"))
    buckets = bucket_counts(scored(df), keys).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "rows")))).alias("buckets"))
    out = rates(df, keys).join(fields, keys, "left").join(macro(counts, keys), keys, "left").join(buckets, keys, "left")
    if latency:
        from . import profile

        figures = df.groupBy(*keys).agg(F.avg(latency).alias("latency_mean"), F.min(latency).alias("latency_min"), F.max(latency).alias("latency_max"))
        ranks = profile.ordered_values(df, keys, latency, {"latency_p50": profile.rank_round(0.5), "latency_p95": profile.rank_round(0.95)})
        out = out.join(figures, keys, "left").join(ranks, keys, "left")
    return out
