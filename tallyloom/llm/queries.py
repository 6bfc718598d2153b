"""The queries of problems 1 to 10 on a data directory, with SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..storage import scratch, shared_dir, written
from . import encoding, leakage, mixing, neardup, overlap, packing, permanent, pii, quota_sample, splits

#: Key of the pseudonyms in the queries unless ``spark.tallyloom.pseudonym.key`` is set; a deployment sets its own.
DEMO_KEY = "pseudonyms of the example queries"


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    tickets, prompts = table(spark, d, "support_tickets"), table(spark, d, "support_tickets_sft_prompt_completion")
    names, key = pii.fit_names(tickets), spark.conf.get("spark.tallyloom.pseudonym.key", DEMO_KEY).encode()
    a = pii.redacted(tickets, names, key, "support_tickets", "record_id", "input_text")
    return a.unionByName(pii.redacted(prompts, names, key, "support_tickets_sft_prompt_completion", "record_id", "prompt"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _redacted(spark, d).select("table_name", "record_id", "text", "items")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.types_found(_redacted(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.short_cells(quota_sample.plan(table(spark, d, "support_tickets"), table(spark, d, "sample_targets")))


def p2_plan(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.plan(table(spark, d, "support_tickets"), table(spark, d, "sample_targets"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.totals(p2_plan(spark, d))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    tickets = table(spark, d, "support_tickets")
    return quota_sample.sample(tickets, quota_sample.plan(tickets, table(spark, d, "sample_targets")))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return splits.with_seed_marks(splits.related(table(spark, d, "support_tickets_canonical")), table(spark, d, "support_tickets"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(_marked(spark, d), table(spark, d, "split_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_splits(spark, d).where("torn").select("record_id", "group_id")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.shares(p3_splits(spark, d), table(spark, d, "split_targets")).drop("records", "actual_share")


def _near(spark: SparkSession, d: str):
    for name, text in (("support_tickets_canonical", "input_text"), ("support_tickets", "target.summary")):
        members, sets = neardup.classes(table(spark, d, name), "record_id", text)
        yield name, members, neardup.similar_classes(sets)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (neardup.record_pairs(m, s).select(F.lit(name).alias("table_name"), "record_id_a", "record_id_b") for name, m, s in _near(spark, d))
    return a.unionByName(b)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    a, b = (neardup.linked_classes(m, s).select(F.lit(name).alias("table_name"), "record_id", "group_id", "copies", "links") for name, m, s in _near(spark, d))
    return a.unionByName(b)


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return p4_groups(spark, d).select("table_name", "record_id", "group_id")


def _mix(spark: SparkSession, d: str):
    members = mixing.memberships(table(spark, d, "support_tickets_canonical"), table(spark, d, "source_registry"))
    return members, *mixing.plan(members, table(spark, d, "mix_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_lines(_mix(spark, d)[1])


def p5_short(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].select("mix_name", "source_dataset", "records", "short_rows")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    members, report, _, _ = _mix(spark, d)
    return mixing.witnessed(report, table(spark, d, "support_tickets_canonical"), members, table(spark, d, "source_registry"), table(spark, d, "support_tickets_dataset_composition"))


def p5_mix(spark: SparkSession, d: str) -> DataFrame:
    members, _, routes, kinds = _mix(spark, d)
    return mixing.mixed(members, routes, kinds)


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    return mixing.totals(p5_mix(spark, d), table(spark, d, "mix_targets"))


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    canonical, manifest = table(spark, d, "support_tickets_canonical"), table(spark, d, "support_tickets_eval_manifest")
    held = overlap.texts(canonical.where("split = 'eval'"), "record_id", "input_text", overlap.HELD).unionByName(overlap.texts(manifest, "record_id", "input_text", overlap.HELD))
    members, sets = overlap.classes(held.unionByName(overlap.texts(canonical.where("split = 'train'"), "record_id", "input_text", overlap.TRAIN)))
    return members, overlap.similar_texts(sets)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.record_overlaps(*_overlaps(spark, d))
    return pairs.select(F.least("held_id", "train_id").alias("record_id_a"), F.greatest("held_id", "train_id").alias("record_id_b")).distinct()


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return overlap.linked_records(*_overlaps(spark, d))


def _sourced(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """The rows with the source a record names (of several, the least)."""
    canonical, manifest = table(spark, d, "support_tickets_canonical"), table(spark, d, "support_tickets_eval_manifest")
    source = F.coalesce(F.lower(F.trim("source_dataset")), F.lit("unknown"))
    of = canonical.select("record_id", source.alias("s")).unionByName(manifest.select("record_id", source.alias("s"))).where("record_id is not null").groupBy("record_id").agg(F.min("s").alias("source_dataset"))
    return rows.join(of, "record_id", "left")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Records with a partner on the other side by split and source."""
    return _sourced(spark, d, p6_records(spark, d)).groupBy("side", "source_dataset").agg(F.count(F.lit(1)).alias("records"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The same with how many have partners of the same words, and how much of their text is covered."""
    return _sourced(spark, d, p6_records(spark, d)).groupBy("side", "source_dataset").agg(F.count_if(F.col("same") > 0).alias("same"), F.count_if(F.col("same") == 0).alias("near_only"), F.round(F.avg("coverage"), 4).alias("coverage"))


def _registry(spark: SparkSession, d: str) -> permanent.NumberRegistry:
    """The registry of a data directory: below the folder named in ``spark.tallyloom.registry``, else in the shared folder."""
    at = spark.conf.get("spark.tallyloom.registry", None) or f"{shared_dir(spark)}/registry"
    return permanent.NumberRegistry(spark, f"{at}/{hashlib.sha1(d.encode()).hexdigest()[:16]}")


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return permanent.permanent_sample(table(spark, d, "support_tickets_canonical"), "record_id", table(spark, d, "sample_rates"), _registry(spark, d))


def p7_builds(spark: SparkSession, d: str) -> DataFrame:
    """(sample_name, build_label, sampled, lost): two builds of the sample, the second after the last build's records have come and under another seed.

    A record counts in the first build that names it; ``lost`` are records of the first sample that the second lacks. The
    history is played in a folder of its own, so every call gives the same.
    """
    canonical, rates = table(spark, d, "support_tickets_canonical"), table(spark, d, "sample_rates")
    first = canonical.where("record_id is not null").groupBy("record_id").agg(F.min(F.col("metadata.extras")["build_label"]).alias("build_label"))
    last = first.agg(F.max("build_label").alias("last"))
    old = first.join(F.broadcast(last), F.col("build_label") < F.col("last"), "left_semi").select("record_id")  # one row
    path = scratch(spark, "history")
    before = permanent.permanent_sample(old, "record_id", rates, permanent.NumberRegistry(spark, path))
    after = permanent.permanent_sample(canonical, "record_id", rates, permanent.NumberRegistry(spark, path, "permanent of a later day"))
    both = after.withColumn("now", F.lit(1)).join(before.withColumn("then", F.lit(1)), ["sample_name", "record_id"], "full")
    return both.join(first, "record_id").groupBy("sample_name", "build_label").agg(F.count("now").alias("sampled"), F.count_if(F.col("now").isNull()).alias("lost"))


def _bins(spark: SparkSession, d: str) -> DataFrame:
    sizes = written(packing.token_counts(table(spark, d, "documents"), packing.default_vocabulary()), "sizes")
    return packing.windows_of(sizes, table(spark, d, "context_windows"))


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    return _bins(spark, d)


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(_bins(spark, d), table(spark, d, "context_windows"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    return packing.wholeness(_bins(spark, d), table(spark, d, "context_windows"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Runs, whole short items and passages most of whose words stand near their place."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark_items"), near_share=0.8)


def p9_runs(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark_items")).where("kind = 'run'").select("doc_id", "item_id", "run_words").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_runs(spark, d).select("doc_id", "item_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return encoding.repaired(documents, encoding.fit(documents)).select("doc_id", "restored", "damaged_runs", "open_runs", "channel")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return encoding.repaired(documents, encoding.fit(documents), keep_text=False).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}
    return dict(sorted(found.items(), key=lambda x: (int(x[0][1:].partition("_")[0]), x[0])))


_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"


def _alike(rows: str, allowed: str) -> str:
    """Pairs of rows (id, side, text) that share seven tenths of their distinct words."""
    return f"""
    WITH t AS MATERIALIZED (SELECT DISTINCT id, side, text FROM ({rows}) WHERE id IS NOT NULL AND text IS NOT NULL),
    s AS MATERIALIZED (SELECT row_number() OVER () AS k, id, side, {_WORDS.format('text')} AS w FROM t),
    e AS MATERIALIZED (SELECT k, id, side, len(w) AS n, unnest(w) AS x FROM s),
    c AS (SELECT a.k AS ka, b.k AS kb, any_value(a.id) AS ia, any_value(b.id) AS ib, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
          FROM e a JOIN e b ON a.x = b.x AND a.k <> b.k AND a.id <> b.id AND {allowed} AND a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7 GROUP BY ALL HAVING true)
    SELECT DISTINCT ia, ib, least(ia, ib) AS record_id_a, greatest(ia, ib) AS record_id_b FROM c WHERE o * 17 >= 7 * (na + nb)"""


_LABEL = "CASE WHEN regexp_replace(lower(trim({0})), '[\\s\\-]+', '_', 'g') IN ({1}) THEN regexp_replace(lower(trim({0})), '[\\s\\-]+', '_', 'g') END"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
_ID = "nullif(lower(trim({0}, ' \t\n\r')), '')"
_GRAMS = r"""
        d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        b AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark_items WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
        bg AS (SELECT item_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13))"""
_OF_SOURCE = """s AS (SELECT DISTINCT record_id, coalesce(a.dataset_name, b.dataset_name) AS source_dataset FROM support_tickets_canonical c
             LEFT JOIN source_registry a ON c.source_dataset = a.dataset_name LEFT JOIN source_registry b ON c.metadata.adapter_name = b.adapter_name WHERE record_id IS NOT NULL),
        n AS (SELECT source_dataset, count(*) AS n FROM s WHERE source_dataset IS NOT NULL GROUP BY 1)"""
_MARK = "coalesce(lower(trim({0}, ' \t\n\r')) IN ({1}), false)"


def oracle_sql() -> dict[str, str]:
    train, held = _quoted(splits.TRAIN_MARKS), _quoted(splits.HELD_MARKS)
    p4 = [
        f"SELECT DISTINCT '{name}' AS table_name, record_id_a, record_id_b FROM ({_alike(f'SELECT record_id AS id, 0 AS side, {text} AS text FROM {name}', 'a.k < b.k')})"
        for name, text in (("support_tickets_canonical", "input_text"), ("support_tickets", "target.summary"))
    ]
    sides = """SELECT record_id AS id, 1 AS side, input_text AS text FROM support_tickets_eval_manifest UNION ALL SELECT record_id, 1, input_text FROM support_tickets_canonical WHERE split = 'eval'
               UNION ALL SELECT record_id, 2, input_text FROM support_tickets_canonical WHERE split = 'train'"""
    across = _alike(sides, "a.side = 1 AND b.side = 2")
    return {
        "p2_found": f"""
        WITH r AS (SELECT record_id, min(struct_pack(c := c, p := p)) AS l FROM (
               SELECT record_id, {_LABEL.format('target.issue_category', _quoted(quota_sample.CATEGORIES))} AS c, {_LABEL.format('target.priority', _quoted(quota_sample.PRIORITIES))} AS p FROM support_tickets)
             WHERE record_id IS NOT NULL AND c IS NOT NULL AND p IS NOT NULL GROUP BY 1),
        n AS (SELECT l.c AS issue_category, l.p AS priority, count(*) AS n FROM r GROUP BY ALL)
        SELECT request_name, issue_category, priority FROM sample_targets t LEFT JOIN n USING (issue_category, priority)
        WHERE coalesce(n, 0) < target_share * sample_rows OR coalesce(n, 0) < min_rows""",
        "p2_totals": f"""
        WITH r AS (SELECT record_id, min(struct_pack(c := c, p := p)) AS l FROM (
               SELECT record_id, {_LABEL.format('target.issue_category', _quoted(quota_sample.CATEGORIES))} AS c, {_LABEL.format('target.priority', _quoted(quota_sample.PRIORITIES))} AS p FROM support_tickets)
             WHERE record_id IS NOT NULL AND c IS NOT NULL AND p IS NOT NULL GROUP BY 1),
        n AS (SELECT l.c AS issue_category, l.p AS priority, count(*) AS n FROM r GROUP BY ALL)
        SELECT request_name, count(*) AS cells, least(max(sample_rows), sum(coalesce(n, 0)))::BIGINT AS quota_rows, count_if(coalesce(n, 0) < target_share * sample_rows OR coalesce(n, 0) < min_rows) AS short_cells
        FROM sample_targets t LEFT JOIN n USING (issue_category, priority) GROUP BY 1""",
        "p3_shares": "SELECT split_name, target_share, true AS near_target, 0::BIGINT AS broken_groups FROM split_targets",
        "p3_found": f"""
        WITH RECURSIVE rows_ AS (SELECT record_id, {_ID.format('record_id')} AS node, {_ID.format('metadata.lineage_root_id')} AS root, {_ID.format('metadata.parent_record_id')} AS parent,
               {_MARK.format('split', train)} AS train, {_MARK.format('split', held)} AS held FROM support_tickets_canonical WHERE record_id IS NOT NULL),
        e AS (SELECT DISTINCT node AS a, x AS b FROM (SELECT node, unnest([root, parent]) AS x FROM rows_) WHERE x IS NOT NULL AND x <> node),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        walk AS (SELECT a AS node, a AS seen FROM u UNION SELECT w.node, u.b FROM walk w JOIN u ON w.seen = u.a),
        comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1),
        hints AS (SELECT {_ID.format('record_id')} AS node, {_MARK.format('split', train)} AS train, {_MARK.format('split', held)} AS held FROM support_tickets),
        rec AS (SELECT record_id, node, coalesce(component, node) AS component FROM (SELECT DISTINCT record_id, node FROM rows_) LEFT JOIN comp USING (node)),
        mark AS (SELECT node, train, held FROM rows_ UNION ALL SELECT node, train, held FROM hints),
        g AS (SELECT component, min(record_id) AS group_id, bool_or(train) AS t, bool_or(held) AS h FROM rec JOIN mark USING (node) GROUP BY 1)
        SELECT record_id, group_id FROM rec JOIN g USING (component) WHERE t AND h""",
        "p4_found": " UNION ALL ".join(p4),
        "p4_members": f"""
        WITH RECURSIVE p AS MATERIALIZED ({' UNION ALL '.join(p4)}), u AS MATERIALIZED (SELECT table_name, record_id_a AS a, record_id_b AS b FROM p UNION SELECT table_name, record_id_b, record_id_a FROM p),
        walk AS (SELECT table_name, a AS record_id, a AS seen FROM u UNION SELECT w.table_name, w.record_id, u.b FROM walk w JOIN u ON w.table_name = u.table_name AND w.seen = u.a)
        SELECT table_name, record_id, min(seen) AS group_id FROM walk GROUP BY ALL""",
        "p5_short": f"""
        WITH {_OF_SOURCE} SELECT mix_name, source_dataset, coalesce(n, 0) AS records, greatest(0, ceil(target_share * mix_rows) - max_repeats * coalesce(n, 0))::BIGINT AS short_rows FROM mix_targets LEFT JOIN n USING (source_dataset)""",
        "p5_totals": f"""
        WITH {_OF_SOURCE} SELECT mix_name, least(max(mix_rows), sum(max_repeats * coalesce(n, 0)))::BIGINT AS mixed_rows, 0::BIGINT AS lines_over_cap FROM mix_targets LEFT JOIN n USING (source_dataset) GROUP BY 1""",
        "p5_found": f"""
        WITH {_OF_SOURCE}
        SELECT mix_name, source_dataset FROM mix_targets LEFT JOIN n USING (source_dataset) WHERE target_share * mix_rows > max_repeats * coalesce(n, 0)""",
        "p6_found": f"SELECT DISTINCT record_id_a, record_id_b FROM ({across})",
        "p6_report": f"""
        WITH p AS MATERIALIZED ({across}), r AS (SELECT DISTINCT 'held_out' AS side, ia AS record_id FROM p UNION SELECT DISTINCT 'train', ib FROM p),
        s AS (SELECT record_id, min(coalesce(lower(trim(source_dataset)), 'unknown')) AS source_dataset FROM (SELECT record_id, source_dataset FROM support_tickets_canonical UNION ALL SELECT record_id, source_dataset FROM support_tickets_eval_manifest) WHERE record_id IS NOT NULL GROUP BY 1)
        SELECT side, source_dataset, count(*) AS records FROM r LEFT JOIN s USING (record_id) GROUP BY ALL""",
        "p7_sample": """
        SELECT sample_name, record_id FROM (SELECT DISTINCT record_id FROM support_tickets_canonical WHERE record_id IS NOT NULL), sample_rates
        WHERE ('0x' || substr(sha256('permanent:' || record_id), 1, 13))::BIGINT / 4503599627370496.0 < rate""",
        "p7_builds": """
        WITH f AS (SELECT record_id, min(metadata.extras['build_label']) AS build_label FROM support_tickets_canonical WHERE record_id IS NOT NULL GROUP BY 1),
        u AS (SELECT *, ('0x' || substr(sha256(CASE WHEN build_label < (SELECT max(build_label) FROM f) THEN 'permanent:' ELSE 'permanent of a later day:' END || record_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM f)
        SELECT sample_name, build_label, count(*) AS sampled, 0::BIGINT AS lost FROM u, sample_rates WHERE u < rate GROUP BY ALL""",
        "p8_whole": """
        SELECT window_name, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0::BIGINT AS cut_needlessly, 0::BIGINT AS overfull, 0::BIGINT AS overlapping FROM context_windows""",
        "p9_runs": f"""
        WITH {_GRAMS}, hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)),
        x AS (SELECT h.doc_id, h.item_id, unnest(d.w) AS t, unnest(range(len(d.w))) AS i FROM hit h JOIN d USING (doc_id)),
        y AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS j FROM b),
        m AS (SELECT x.doc_id, x.item_id, i - j AS shift, i, row_number() OVER (PARTITION BY x.doc_id, x.item_id, i - j ORDER BY i) AS r FROM x JOIN y ON x.item_id = y.item_id AND x.t = y.t)
        SELECT doc_id, item_id, max(n)::INT AS run_words FROM (SELECT doc_id, item_id, count(*) AS n FROM m GROUP BY doc_id, item_id, shift, i - r) GROUP BY ALL""",
        "p9_found": f"WITH {_GRAMS} SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)",
    }
