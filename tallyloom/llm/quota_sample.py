"""Samples that follow target shares over two crossed labels (problem 2).

Only the counts of the cross-classification reach the driver: at most categories x priorities numbers per request. Two
min-cost flows read them, each with the margins of both labels as arcs. In the first every cell has its requirement (its
share, or its floor) to pass, over a supply arc of what is there or, at a cost, over a slack arc; what runs over slack
arcs is the list of cells that cannot be met. The second draws the quotas: its integer targets come from a seeded random
controlled rounding, which keeps the mean of every cell and rounds the margins with the cells; floors are arcs that pay,
units beyond a cell's target cost more the further they go, and a margin that has to give way does so over a dear slack
arc that the plan reports. Records are then drawn at random within each cell.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranking import ranked, unit_hash
from .flow import INF, Network, slices

#: The closed domains of the two labels (fixed values).
CATEGORIES = ("billing", "account_access", "technical_bug", "feature_request", "integration", "general_question", "other")
PRIORITIES = ("low", "medium", "high", "urgent")

PLAN = T.StructType(
    [
        T.StructField("request_name", T.StringType()),
        T.StructField("issue_category", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("available", T.LongType()),
        T.StructField("target_rows", T.DoubleType()),
        T.StructField("min_rows", T.LongType()),
        T.StructField("quota", T.LongType()),
        T.StructField("short_of_share", T.LongType()),
        T.StructField("short_of_floor", T.LongType()),
        T.StructField("category_over", T.LongType()),
        T.StructField("priority_over", T.LongType()),
    ]
)


def settled(label: Column, domain: tuple[str, ...]) -> Column:
    """The enum value that a spelling means: blanks around it, letter case, and hyphen or blank for underscore are ignored; null if none."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[\s\-]+", "_")
    return F.when(plain.isin(*domain), plain)


def cells(tickets: DataFrame) -> DataFrame:
    """(record_id, issue_category, priority): one row per distinct record that has both labels.

    A record repeated with different labels counts once, in the least (category, priority) of its complete rows. Records
    with a null, blank or unknown label, or a null id, belong to no cell.
    """
    return (
        tickets.select(
            "record_id",
            settled(F.col("target.issue_category"), CATEGORIES).alias("issue_category"),
            settled(F.col("target.priority"), PRIORITIES).alias("priority"),
        )
        .where("record_id is not null and issue_category is not null and priority is not null")
        .groupBy("record_id")
        .agg(F.min(F.struct("issue_category", "priority")).alias("c"))
        .select("record_id", "c.issue_category", "c.priority")
    )


def shortfalls(need: dict, have: dict) -> dict:
    """Units of each cell's requirement that only its slack arc can give, in the network of cells and margins."""
    rows, cols = _margins(need)
    net, slack = Network(), {}
    for i, n in rows.items():
        net.arc("S", ("row", i), n)
    for j, n in cols.items():
        net.arc(("col", j), "T", n)
    for (i, j), n in need.items():
        net.arc(("row", i), (i, j), n)
        net.arc((i, j), ("col", j), have.get((i, j), 0))
        slack[i, j] = net.arc((i, j), ("col", j), INF, 1)
    net.send("S", "T", sum(need.values()))
    return {cell: net.flow(h) for cell, h in slack.items()}


def _margins(counts: dict) -> tuple[dict, dict]:
    rows, cols = defaultdict(int), defaultdict(int)
    for (i, j), n in counts.items():
        rows[i] += n
        cols[j] += n
    return rows, cols


def rounded(shares: dict, size: int, seed: str) -> dict:
    """Integers next to ``share * size``, drawn so that every cell keeps its mean and both margins and the total are rounded too.

    Cells that are no integers form cycles through rows and columns, an extra row and column taking what the margins lack.
    Each step moves a cycle up or down by as much as makes one of its cells whole, the direction drawn so that no mean
    changes. The same seed draws the same.
    """
    rnd = random.Random(seed)
    at = {c: Fraction(str(x)) * size for c, x in sorted(shares.items())}
    rows, cols = _margins(at)
    total = sum(at.values())
    table = dict(at)
    table |= {(i, None): math.ceil(n) - n for i, n in rows.items()} | {(None, j): math.ceil(n) - n for j, n in cols.items()}
    table[None, None] = total - math.floor(total)
    while cycle := _cycle({c for c, x in table.items() if x.denominator > 1}):
        up, down = cycle[0::2], cycle[1::2]
        part = lambda c: table[c] - math.floor(table[c])
        most = min(min(1 - part(c) for c in up), min(part(c) for c in down))
        least = min(min(part(c) for c in up), min(1 - part(c) for c in down))
        step = most if rnd.random() * (most + least) < least else -least
        for c in up:
            table[c] += step
        for c in down:
            table[c] -= step
    return {c: int(table[c]) for c in shares}


def _cycle(cells_: set) -> list:
    """A closed walk that leaves rows and columns in turn by different cells; empty if there are no cells."""
    if not cells_:
        return []
    by_row, by_col = defaultdict(list), defaultdict(list)
    for c in sorted(cells_, key=str):
        by_row[c[0]].append(c)
        by_col[c[1]].append(c)
    path, seen, cell, along_row = [], {}, min(cells_, key=str), True
    while (node := (along_row, cell[not along_row])) not in seen:
        seen[node] = len(path)
        cell = next(c for c in (by_row if along_row else by_col)[node[1]] if not path or c != path[-1])
        path.append(cell)
        along_row = not along_row
    return path[seen[node] :]


def quotas(targets: dict, floors: dict, have: dict, size: int, seed: str = "quota") -> tuple[dict, dict, dict]:
    """Integer quotas per (category, priority) cell, at most ``have``, that add up to ``size`` if there are so many records, and by how much each row and column margin was overrun."""
    want = rounded(targets, size, seed)
    rows, cols = _margins(want)
    net, arcs = Network(), defaultdict(list)
    for i, n in rows.items():
        net.arc("S", ("row", i), n)
    for j, n in cols.items():
        net.arc(("col", j), "T", n)
    over_row = {i: net.arc("S", ("row", i), INF, 40) for i in rows}
    over_col = {j: net.arc(("col", j), "T", INF, 40) for j in cols}
    for c in sorted(targets):
        i, j = c
        free = have.get(c, 0)
        at_floor = min(floors.get(c, 0), free)
        to_target = max(0, min(want[c], free) - at_floor)
        arcs[c].append(net.arc(("row", i), ("col", j), at_floor, -10_000))
        arcs[c].append(net.arc(("row", i), ("col", j), to_target, -1_000))
        beyond, cost = free - at_floor - to_target, 1
        for piece in slices(min(beyond, max(1, want[c]))):
            arcs[c].append(net.arc(("row", i), ("col", j), piece, cost))
            beyond, cost = beyond - piece, cost * 2
        arcs[c].append(net.arc(("row", i), ("col", j), max(0, beyond), cost * 2))
    net.send("S", "T", min(size, sum(have.get(c, 0) for c in targets)))
    return {c: sum(net.flow(h) for h in arcs[c]) for c in targets}, {i: net.flow(h) for i, h in over_row.items()}, {j: net.flow(h) for j, h in over_col.items()}


def plan(tickets: DataFrame, targets: DataFrame, seed: str = "quota") -> DataFrame:
    """One row per line of ``targets`` with availability, quota, shortfalls and what its two margins were overrun by.

    ``targets`` is a request table of fixed size; a line with an unknown label has no available records. Of repeated
    lines the first in order of their values counts.
    """
    have = {(r[0], r[1]): r[2] for r in cells(tickets).groupBy("issue_category", "priority").count().collect()}
    requests: dict[str, dict] = defaultdict(dict)
    lines = targets.select("request_name", "issue_category", "priority", "target_share", "min_rows", "sample_rows").where("request_name is not null and issue_category is not null and priority is not null")
    for r in sorted(lines.collect(), key=str):
        requests[r[0]].setdefault((r[1], r[2]), (float(r[3] or 0), int(r[4] or 0), int(r[5] or 0)))
    out = []
    for name, lines_of in sorted(requests.items()):
        size = max(n for _, _, n in lines_of.values())
        share_rows = {c: s * n for c, (s, _, n) in lines_of.items()}
        floors = {c: f for c, (_, f, _) in lines_of.items()}
        by_share = shortfalls({c: math.ceil(x) for c, x in share_rows.items()}, have)
        by_floor = shortfalls(floors, have)
        chosen, over_row, over_col = quotas({c: s for c, (s, _, _) in lines_of.items()}, floors, have, size, f"{seed}:{name}")
        out += [(name, *c, have.get(c, 0), share_rows[c], floors[c], chosen[c], by_share[c], by_floor[c], over_row[c[0]], over_col[c[1]]) for c in sorted(lines_of)]
    return tickets.sparkSession.createDataFrame(out, PLAN)


def short_cells(plan_rows: DataFrame) -> DataFrame:
    """The cells in which target share or floor could not be met."""
    return plan_rows.where("short_of_share > 0 or short_of_floor > 0").select("request_name", "issue_category", "priority")


def totals(plan_rows: DataFrame) -> DataFrame:
    """(request_name, cells, quota_rows, short_cells): what a request comes to."""
    short = F.count_if((F.col("short_of_share") > 0) | (F.col("short_of_floor") > 0))
    return plan_rows.groupBy("request_name").agg(F.count(F.lit(1)).alias("cells"), F.sum("quota").alias("quota_rows"), short.alias("short_cells"))


def sample(tickets: DataFrame, plan_rows: DataFrame, seed: str = "quota") -> DataFrame:
    """(request_name, record_id, issue_category, priority): the quota of each cell, drawn by a seeded hash of request and id.

    Ranks within a cell are computed in buckets, so one cell may hold any share of the records. The plan has at most the
    fixed number of request lines, and is broadcast.
    """
    drawn = (
        cells(tickets)
        .join(F.broadcast(plan_rows.where("quota > 0").select("request_name", "issue_category", "priority", "quota")), ["issue_category", "priority"])
        .withColumn("u", unit_hash("request_name", "record_id", seed=seed))
    )
    return ranked(drawn, ["request_name", "issue_category", "priority"], "u", "record_id").where("rank < quota").select("request_name", "record_id", "issue_category", "priority")
