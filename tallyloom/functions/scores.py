"""Scores and labels of predicted payloads against references, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NULLABLE_FIELDS, SCALAR_FIELDS


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return ratio(2 * p * r, p + r)


def list_items(c: Column) -> Column:
    """Distinct trimmed non-empty items; an empty list for null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("None")))), lambda x: x != ""))


def set_counts(predicted: Column, reference: Column) -> Column:
    """(tp, fp, fn) of two lists as sets."""
    p, r = list_items(predicted), list_items(reference)
    return F.struct(F.size(F.array_intersect(p, r)).alias("tp"), F.size(F.array_except(p, r)).alias("fp"), F.size(F.array_except(r, p)).alias("fn"))


def set_f1(predicted: Column, reference: Column) -> Column:
    """F1 of two lists as sets; 0 if both are empty."""
    n = set_counts(predicted, reference)
    return f1(n["tp"], n["fp"], n["fn"])


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token lists."""
    count = lambda xs, k: F.size(F.filter(xs, lambda x: x == k))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, k: acc + F.least(count(a, k), count(b, k)))


def bag_f1(a: Column, b: Column) -> Column:
    n = bag_overlap(a, b)
    return f1(n, F.size(a) - n, F.size(b) - n)


def concision(words: Column) -> Column:
    return F.when(words <= 32, F.lit(1.0)).otherwise(F.lit(32.0) / words)


def semantic_score(matches: Column, actions_f1: Column, penalty: Column | None = None) -> Column:
    """(matching fields + F1 of actions - penalty) / 9; with a penalty it is the variant that counts null hallucinations."""
    return (matches + actions_f1 - (penalty if penalty is not None else F.lit(0))) / F.lit(9.0)


def rubric(parses: Column, valid: Column, extra: Column, matches: Column, actions_f1: Column, summary_f1: Column, null_errors: Column, concise: Column) -> Column:
    one = lambda c: c.cast("int").cast("double")
    return 5.0 * one(parses) + 5.0 * one(valid) - 2.0 * extra + 1.5 * matches + 2.0 * actions_f1 + 1.5 * summary_f1 - 1.5 * null_errors + 0.5 * concise


def failure_mode(parses: Column, valid: Column, extra: Column, null_errors: Column, matches: Column, actions_f1: Column) -> Column:
    """The first thing that is wrong with a candidate. A perfect answer without actions has an actions F1 of 0 and counts as a mismatch."""
    return (
        F.when(~parses, "parse_failure").when(~valid, "schema_failure").when(extra > 0, "hallucinated_keys").when(null_errors > 0, "null_handling_mistake").when((matches < len(SCALAR_FIELDS)) | (actions_f1 < 1.0), "semantic_mismatch").otherwise("clean")
    )


def null_errors(predicted: dict[str, Column], reference: dict[str, Column]) -> Column:
    """How many nullable fields are filled although the reference has null."""
    out = F.lit(0)
    for f in NULLABLE_FIELDS:
        out = out + (reference[f].isNull() & predicted[f].isNotNull() & (predicted[f] != "")).cast("int")
    return out


def bucket_labels(parses: Column, valid: Column, extra: Column, differs: Column, null_mistakes: Column, predicted_actions: Column, reference_actions: Column) -> Column:
    p, r = list_items(predicted_actions), list_items(reference_actions)
    both = F.size(F.array_intersect(p, r))
    partial = (both > 0) & (both < F.size(r))
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(~parses | ~valid, "syntax_failures"),
                F.when(extra > 0, "hallucinated_keys"),
                F.when(parses & differs, "semantic_failures"),
                F.when(null_mistakes > 0, "null_handling_mistakes"),
                F.when(partial, "partial_action_extraction"),
            )
        )
    )


def schema_points(missing: Column, unexpected: Column, other: Column) -> Column:
    """100 less 25 per missing, 10 per unexpected and 15 per other issue, at least 0."""
    return F.greatest(F.lit(0), 100 - 25 * missing - 10 * unexpected - 15 * other)


#: Why a chosen candidate beat a rejected one, in the order in which it is told (fixed values): (what decides, sentence, unit of the two numbers).
REASONS = (
    ("parses", "Chosen parsed into a JSON object while rejected did not.", None),
    ("valid", "Chosen passed full schema validation while rejected did not.", None),
    ("extra", "Chosen contained fewer hallucinated keys than rejected", ""),
    ("matches", "Chosen matched more structured gold fields than rejected", ""),
    ("actions_f1", "Chosen matched the requested actions more accurately than rejected", ""),
    ("null_errors", "Chosen respected nullable customer fields better than rejected", " mistakes"),
    ("summary_f1", "Chosen summary stayed closer to the gold summary than rejected", ""),
    ("words", "Chosen summary was more concise than rejected on an otherwise-tied semantic score", " words"),
)
LAST_REASON = "Chosen won the final stable text tie-break after all higher-priority rubric checks tied."
#: Of these the smaller number is better, and these are shown with four decimals.
SMALLER, DECIMAL = ("extra", "null_errors", "words"), ("actions_f1", "summary_f1")


def rationale(c: Column, r: Column) -> Column:
    """Why a chosen candidate beat a rejected one, from structs with the scorecard's fields; null handling is told before summaries."""
    out = None
    for field, sentence, unit in REASONS:
        a, b = c[field], r[field]
        if unit is None:
            won, told = a & ~b, F.lit(sentence)
        else:
            won = a < b if field in SMALLER else a > b
            shown = [F.format_string("%.4f", x) if field in DECIMAL else x.cast("string") for x in (a, b)]
            told = F.concat(F.lit(f"{sentence} ("), shown[0], F.lit(" vs "), shown[1], F.lit(f"{unit})."))
        out = F.when(won, told) if out is None else out.when(won, told)
    return out.otherwise(LAST_REASON)
