"""Mixing sources to target weights (problem 5).

Records (or their tokens) are added up by membership pattern: the source their ``source_dataset`` names exactly or,
failing that, the one their ``adapter_name`` names, plus any further source that the other witness names. Two min-cost
flows route the uses of each pattern to the quotas of the sources, the first use free, every repetition dearer; each pair
of pattern and source has its own capacity, the pattern's units times the repetitions that the source's line allows. In
the first network a source's requirement is met by its own patterns or, at a cost, by a slack arc: what runs there is
its shortfall. In the second there is no slack, and what a source lacks is spread over the others so that the mix keeps
its size. Which records are used, and which are repeated, is decided by a seeded hash.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranking import ranked, unit_hash
from .flow import INF, Network, apportion, slices

REPORT = T.StructType(
    [
        T.StructField("mix_name", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("target_share", T.DoubleType()),
        T.StructField("max_repeats", T.IntegerType()),
        T.StructField("records", T.LongType()),
        T.StructField("target_rows", T.DoubleType()),
        T.StructField("mixed_rows", T.LongType()),
        T.StructField("actual_share", T.DoubleType()),
        T.StructField("short_rows", T.LongType()),
        T.StructField("lacking_rows", T.LongType()),
    ]
)
ROUTE = T.StructType(
    [
        T.StructField("mix_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("first_use", T.LongType()),
        T.StructField("last_use", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
#: More sources than this are refused: the registry is a table of fixed size.
MOST_SOURCES = 2_000
#: Patterns are sets of registry sources; so many of them are refused rather than cut off. For a mix those that name the
#: same of its sources are one kind, and the flow takes so many kinds.
MOST_PATTERNS, MOST_KINDS = 200_000, 2_000
KIND = T.StructType([T.StructField("mix_name", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("kind", T.StringType())])


def memberships(canonical: DataFrame, registry: DataFrame, size: Column | None = None) -> DataFrame:
    """(record_id, pattern, size): one row per distinct record that has a source.

    ``pattern`` is the source (of several, all that rows of the record name, sorted and joined by a bar), and after a
    semicolon those that only a further witness names. ``size`` is what a record adds to a mix, such as its tokens (1 if
    not given, the largest if its rows differ, nothing for null or less than 0). Rows with a null id or without a source
    drop out.
    """
    entries = registry.where("dataset_name is not null").select("dataset_name", "adapter_name").distinct().limit(MOST_SOURCES + 1).collect()
    if len(entries) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the registry")
    names = sorted({r[0] for r in entries})
    by_adapter = {r[1]: r[0] for r in sorted(entries, key=str) if r[1]}
    spark = canonical.sparkSession
    # Nulls in either column are kept out of the lookups by the equality of the join.
    named = F.broadcast(spark.createDataFrame([(n,) for n in names], "by_name string"))
    adapted = F.broadcast(spark.createDataFrame(sorted(by_adapter.items()), "adapter string, by_adapter string"))
    found = (
        canonical.select("record_id", "source_dataset", F.col("metadata.adapter_name").alias("a"), (F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) if size is not None else F.lit(1)).cast("long").alias("size"))
        .where("record_id is not null")
        .join(named, F.col("source_dataset") == F.col("by_name"), "left")
        .join(adapted, F.col("a") == F.col("adapter"), "left")
        .select("record_id", "size", F.coalesce("by_name", "by_adapter").alias("first"), "by_adapter")
        .where("first is not null")
    )
    sets = found.groupBy("record_id").agg(F.array_sort(F.collect_set("first")).alias("p"), F.array_sort(F.collect_set("by_adapter")).alias("q"), F.max("size").alias("size"))
    other = F.array_except("q", "p")
    return sets.select("record_id", F.concat(F.array_join("p", "|"), F.when(F.size(other) > 0, F.concat(F.lit(";"), F.array_join(other, "|"))).otherwise(F.lit(""))).alias("pattern"), "size")


def _sources(pattern: str) -> tuple[list[str], list[str]]:
    first, _, more = pattern.partition(";")
    return first.split("|"), more.split("|") if more else []


def kinds(patterns: dict[str, tuple[int, int]], wanted: set[str]) -> dict[str, tuple[list[str], list[str], int, int, list[str]]]:
    """kind -> (sources, further sources, records, units, patterns): the patterns of a mix by the wanted sources they name."""
    out: dict[str, tuple] = {}
    for p, (n, units) in sorted(patterns.items()):
        first, more = ([s for s in part if s in wanted] for part in _sources(p))
        if first or more:
            name = "|".join(first) + (";" + "|".join(more) if more else "")
            _, _, m, u, of = out.get(name, (first, more, 0, 0, []))
            out[name] = (first, more, m + n, u + units, [*of, p])
    if len(out) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of memberships in one mix")
    return out


def _network(of: dict, caps: dict[str, int], further: bool) -> tuple[Network, dict]:
    """The uses of every kind, convex in their number, on arcs to its sources with the capacity that the source's cap allows."""
    net, used = Network(), {}
    for k, (first, more, _, units, _) in of.items():
        mine = first + more if further else first
        i, most = 0, sum(caps[s] for s in mine)
        while i < most:  # one arc per repetition, from the 33rd on for twice as many each time
            step = min(most - i, max(1, i // 32))
            net.arc("S", ("k", k), units * step, 4 * i * i)
            i += step
        for s in mine:
            used[k, s] = net.arc(("k", k), ("s", s), units * caps[s], 0 if s in first else 3)
    return net, used


def route(of: dict, lines: dict[str, tuple[float, int]], rows: int) -> tuple[dict, dict, dict]:
    """(uses by (kind, source), short rows by source, quota by source) of one mix; ``lines``: share and cap by source."""
    order = sorted(lines)
    caps = {s: lines[s][1] for s in order}
    net, _ = _network(of, caps, False)
    dear, slack = 8 * (1 + max(caps.values(), default=0) * len(order)) ** 2, {}
    for s in order:
        slack[s] = net.arc("slack", ("s", s), INF, dear)
        net.arc(("s", s), "T", math.ceil(lines[s][0] * rows))
    net.arc("S", "slack", INF)
    net.send("S", "T", INF >> 2)
    short = {s: net.flow(h) for s, h in slack.items()}
    net, used = _network(of, caps, True)
    want = dict(zip(order, apportion([lines[s][0] for s in order], rows), strict=True))
    for s in order:
        net.arc(("s", s), "T", want[s])
        cost = dear
        for piece in slices(max(1, want[s])):
            net.arc(("s", s), "T", piece, cost)
            cost *= 2
        net.arc(("s", s), "T", INF, cost * 2)
    net.send("S", "T", rows)
    return {k: f for k, h in used.items() if (f := net.flow(h))}, short, want


def plan(members: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, routes, kinds) for a target table of fixed size. Sources that no line names get nothing.

    ``short_rows`` is what a source's own records cannot give of its share within the allowed repetitions, ``lacking_rows``
    what the mix as routed holds less of the source than its quota.
    """
    spark = members.sparkSession
    patterns = {r[0]: (r[1], r[2]) for r in members.groupBy("pattern").agg(F.count(F.lit(1)), F.sum("size")).limit(MOST_PATTERNS + 1).collect()}
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    mixes: dict[str, dict] = defaultdict(dict)
    for r in sorted(targets.where("mix_name is not null and source_dataset is not null").select("mix_name", "source_dataset", "target_share", "max_repeats", "mix_rows").collect(), key=str):
        mixes[r[0]].setdefault(r[1], (float(r[2] or 0), max(0, int(r[3] or 0)), int(r[4] or 0)))
    report, routes, named = [], [], []
    for mix, lines in sorted(mixes.items()):
        rows = max(n for _, _, n in lines.values())
        of = kinds(patterns, set(lines))
        uses, short, want = route(of, {s: (a, b) for s, (a, b, _) in lines.items()}, rows)
        got: dict[str, int] = defaultdict(int)
        reach: dict[str, int] = defaultdict(int)
        for (k, s), f in sorted(uses.items()):
            got[s] += f
            routes.append((mix, k, s, reach[k], reach[k] + f, of[k][3]))
            reach[k] += f
        named += [(mix, p, k) for k in of for p in of[k][4]]
        total = sum(got.values()) or 1
        count = {s: sum(n for first, _, n, _, _ in of.values() if s in first) for s in lines}
        report += [(mix, s, a, b, count[s], a * n, got[s], got[s] / total, short[s], max(0, want[s] - got[s])) for s, (a, b, n) in sorted(lines.items())]
    return spark.createDataFrame(report, REPORT), spark.createDataFrame(routes, ROUTE), spark.createDataFrame(named, KIND)


def mixed(members: DataFrame, routes: DataFrame, named: DataFrame, seed: str = "mix") -> DataFrame:
    """(mix_name, source_dataset, record_id, repeats): how often each chosen record stands in the mix for the source.

    The uses of a kind are dealt in turn over its records in hash order, a record taking as many units as its size: use t
    goes to the record that holds unit t modulo all units, so no record is used a second time before all have been used
    once. A record is in if its first unit is, so a source's total is met to within one record.
    """
    w = ranked(members.where("size > 0").join(F.broadcast(named), "pattern").withColumn("u", unit_hash("mix_name", "record_id", seed=seed)), ["mix_name", "kind"], "u", "record_id", "start", weight="size")
    upto = lambda edge: F.floor((F.col(edge) - 1 - F.col("start")) / F.col("n")) + 1  # noqa: E731  uses below the edge
    return (
        w.join(F.broadcast(routes), ["mix_name", "kind"])
        .withColumn("repeats", (F.greatest(upto("last_use"), F.lit(0)) - F.greatest(upto("first_use"), F.lit(0))).cast("long"))
        .where("repeats > 0")
        .groupBy("mix_name", "source_dataset", "record_id")
        .agg(F.sum("repeats").alias("repeats"))
    )


def totals(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, mixed_rows, lines_over_cap): the size of each mix, and lines that repeat a record more often than allowed."""
    lines = targets.groupBy("mix_name", "source_dataset").agg(F.max("max_repeats").alias("cap"))
    by_line = mix.groupBy("mix_name", "source_dataset").agg(F.sum("repeats").alias("n"), F.max("repeats").alias("most")).join(F.broadcast(lines), ["mix_name", "source_dataset"])
    return by_line.groupBy("mix_name").agg(F.sum("n").alias("mixed_rows"), F.count_if(F.col("most") > F.col("cap")).alias("lines_over_cap"))


def short_lines(report: DataFrame) -> DataFrame:
    """Lines whose share cannot be reached within the allowed repetitions."""
    return report.where("short_rows > 0").select("mix_name", "source_dataset")


def composition_witness(composition: DataFrame) -> DataFrame:
    """(source_dataset, claimed_rows, builds): what the builds believed they held, by the spelling they used."""
    w = Window.partitionBy("source_dataset")
    return composition.select("source_dataset", "row_count", F.size(F.collect_set("build_label").over(w)).alias("builds")).groupBy("source_dataset", "builds").agg(F.sum("row_count").alias("claimed_rows"))


def witnessed(report: DataFrame, canonical: DataFrame, members: DataFrame, registry: DataFrame, composition: DataFrame) -> DataFrame:
    """The report with what the further witnesses say of each source.

    ``claimed_rows`` is what the builds believed they held, case, blanks and hyphens of the spelling settled and a
    beginning that fits one source only taken for it; ``unnamed_rows`` (the same on every line) are claims that name no
    source. ``group_records`` and ``other_group_records`` are records of the source whose source_group is, or is not,
    the registry's; records that name no group of the registry are in neither.
    """
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    entries = registry.where("dataset_name is not null").select("dataset_name", key("dataset_name").alias("k"), key("source_group").alias("g")).distinct()
    claims = composition_witness(composition).select(key("source_dataset").alias("spelt"), "claimed_rows").groupBy("spelt").agg(F.sum("claimed_rows").alias("rows"))
    fits = (F.col("spelt") == F.col("k")) | ((F.col("spelt") != "") & F.col("k").startswith(F.col("spelt")))
    met = claims.join(F.broadcast(entries), fits, "left").groupBy("spelt", "rows").agg(F.max(F.when(F.col("spelt") == F.col("k"), F.col("dataset_name"))).alias("exact"), F.min("dataset_name").alias("first"), F.count_distinct("dataset_name").alias("n"))
    named = met.select(F.coalesce("exact", F.when(F.col("n") == 1, F.col("first"))).alias("source_dataset"), "rows")
    claimed = named.where("source_dataset is not null").groupBy("source_dataset").agg(F.sum("rows").alias("claimed_rows"))
    unnamed = named.where("source_dataset is null").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("unnamed_rows"))
    groups = canonical.select("record_id", key("metadata.source_group").alias("said")).join(F.broadcast(entries.select(F.col("g").alias("said")).distinct()), "said").distinct()
    of = members.select("record_id", F.explode(F.split(F.substring_index("pattern", ";", 1), r"\|")).alias("source_dataset"))
    votes = of.join(groups, "record_id").join(F.broadcast(entries.select(F.col("dataset_name").alias("source_dataset"), "g")), "source_dataset").groupBy("source_dataset", "record_id").agg(F.max(F.col("said") == F.col("g")).alias("same"))
    agreed = votes.groupBy("source_dataset").agg(F.count_if("same").alias("group_records"), F.count_if(~F.col("same")).alias("other_group_records"))
    out = report.join(F.broadcast(claimed), "source_dataset", "left").join(F.broadcast(agreed), "source_dataset", "left").crossJoin(F.broadcast(unnamed))
    return out.select(*report.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("claimed_rows", "unnamed_rows", "group_records", "other_group_records")])
