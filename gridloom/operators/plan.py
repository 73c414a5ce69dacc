"""Corpus planning: coverage, pairing, quotas and roles.

Counts of a plan are as many as its categories, phenomena and roles; they are worked out
on the driver. Members, as many as records, stay in DataFrames and find their partner and
role by rank.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ranking import ranked_in_order

# Roles and categories in order, and the name under which members are ordered.
ROLES = ("train", "development", "holdout")
CATEGORIES = ("exact_keep", "hard_keep", "single_minimal_edit", "complex_correction")
PAIRING = "component-first-family-pairing-2026.08.12.7"


def expand_coverage(coverage: DataFrame) -> DataFrame:
    """One row per request: (category, gate_label, phenomenon, role, ordinal).

    coverage: (category, gate_label, phenomenon, requested_count, train_count,
    development_count, holdout_count). Counts must add up; a row whose counts don't raises
    an error. Null and negative counts are 0.
    """
    n = lambda r: F.greatest(F.coalesce(F.col(f"{r}_count").cast("int"), F.lit(0)), F.lit(0))
    fits = n("train") + n("development") + n("holdout") == F.coalesce(F.col("requested_count").cast("int"), F.lit(0))
    checked = coverage.withColumn("category", F.when(fits, F.col("category")).otherwise(F.raise_error(F.concat(F.lit("counts of coverage differ: "), F.coalesce("phenomenon", F.lit("null"))))))
    entries = F.array(*[F.struct(F.lit(r).alias("role"), n(r).alias("n")) for r in ROLES])
    rows = checked.select("category", "gate_label", "phenomenon", F.inline(entries)).where("n > 0")
    return rows.select("category", "gate_label", "phenomenon", "role", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"))


def category_rank(c: Column) -> Column:
    out = F.lit(len(CATEGORIES))
    for i, name in enumerate(CATEGORIES):
        out = F.when(c == name, i).otherwise(out)
    return out


def quotas(requests: DataFrame) -> DataFrame:
    return requests.groupBy("category", "phenomenon", "role").agg(F.count("*").alias("n"))


def order_key(category: Column, phenomenon: Column, ordinal: Column) -> Column:
    """Digest of the canonical JSON of a member: its stable place in its category."""
    return F.sha2(F.to_json(F.struct(category.alias("category"), F.lit(PAIRING).alias("namespace"), ordinal.cast("int").alias("ordinal"), phenomenon.alias("phenomenon"))), 256)


def stable_order(members: DataFrame, within: list[str], position: list[str]) -> DataFrame:
    """``members`` with ordinal (of its phenomenon, in ``position``), key and rank by key, within groups."""
    nth = ranked_in_order(members, [*within, "category", "phenomenon"], position, "ordinal")
    keyed = nth.withColumn("key", order_key(F.col("category"), F.col("phenomenon"), F.col("ordinal")))
    return ranked_in_order(keyed, [*within, "category"], ["key"])


def pair_zip(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """The k-th row of ``left`` with the k-th of ``right``, by ``order`` within groups: (on, pair_index, left id, right id); rows without partner are left out."""
    side = lambda df, name: ranked_in_order(df.select(*on, F.col(order).alias(name)), on, [name], "pair_index")
    return side(left, "left_id").join(side(right, "right_id"), [*on, "pair_index"])


def select_flow(edges: dict[tuple[str, str], int], left: dict[str, int], right: dict[str, int]) -> dict[tuple[str, str], int]:
    """How many of each edge to take so that every left and right demand is met exactly.

    A maximum flow over a matrix of what is left of each pipe between source, left names,
    right names and sink; each round a breadth-first wave over its rows reaches the sink by
    fewest pipes, names in order. A graph of phenomena is small. Raises ValueError if the
    demands differ or cannot be met.
    """
    if sum(left.values()) != sum(right.values()):
        raise ValueError("the two sides' demands differ")
    a, b = sorted({h for h, _ in edges} | set(left)), sorted({e for _, e in edges} | set(right))
    row, col = {n: 1 + i for i, n in enumerate(a)}, {n: 1 + len(a) + i for i, n in enumerate(b)}
    end = 1 + len(a) + len(b)
    room = np.zeros((end + 1, end + 1), dtype=np.int64)
    for name, n in left.items():
        room[0, row[name]] = n
    for name, n in right.items():
        room[col[name], end] = n
    for (h, e), n in edges.items():
        room[row[h], col[e]] = n
    given = room.copy()
    while room[0].any():
        came = np.full(end + 1, -1)
        came[0] = 0
        wave = [0]
        while wave and came[end] < 0:
            reached = []
            for at in wave:
                new = np.flatnonzero((room[at] > 0) & (came < 0))
                came[new] = at
                reached += new.tolist()
            wave = reached
        if came[end] < 0:
            raise ValueError("the edges cannot meet the demands")
        to = [end]
        while to[-1]:
            to.append(int(came[to[-1]]))
        ways = list(zip(to[1:], to))
        n = min(room[w] for w in ways)
        for x, y in ways:
            room[x, y] -= n
            room[y, x] += n
    return {(h, e): int(given[row[h], col[e]] - room[row[h], col[e]]) for h, e in edges}


def role_edges(requests: DataFrame, keep: str = "hard_keep", edit: str = "single_minimal_edit") -> DataFrame:
    """(role, hard, edit, n): how often each pair of phenomena meets when the members of each role are paired in stable order."""
    ordered = stable_order(requests.where(F.col("category").isin(keep, edit)), ["role"], ["ordinal"])
    a = ordered.where(F.col("category") == keep).select("role", "rank", F.col("phenomenon").alias("hard"))
    b = ordered.where(F.col("category") == edit).select("role", "rank", F.col("phenomenon").alias("edit"))
    return a.join(b, ["role", "rank"]).groupBy("role", "hard", "edit").agg(F.count("*").alias("n"))


def pair_members(requests: DataFrame, keep: str = "hard_keep", edit: str = "single_minimal_edit") -> DataFrame:
    """Counterfactual pairs (edge, hard, edit, hard_rank, edit_rank, edge_rank): members of the two categories drawn for each edge in stable order.

    Pairing within roles decides how often each edge of phenomena occurs; members carry no
    role. Raises ValueError if the categories' counts differ in a role.
    """
    spark = requests.sparkSession
    rows = requests.where(F.col("category").isin(keep, edit))
    counts = {(r["role"], r["category"]): r["n"] for r in rows.groupBy("role", "category").agg(F.count("*").alias("n")).collect()}
    if any(counts.get((r, keep), 0) != counts.get((r, edit), 0) for r, _ in counts):
        raise ValueError("the two categories' counts differ in a role")
    edges = {(r.hard, r.edit): r.n for r in role_edges(rows, keep, edit).groupBy("hard", "edit").agg(F.sum("n").alias("n")).collect()}
    used_a: dict[str, int] = {}
    used_b: dict[str, int] = {}
    ranges = []
    for h, e in sorted(edges):
        ranges.append((len(ranges), h, e, used_a.get(h, 0), used_b.get(e, 0), edges[h, e]))
        used_a[h] = used_a.get(h, 0) + edges[h, e]
        used_b[e] = used_b.get(e, 0) + edges[h, e]
    table = spark.createDataFrame(ranges, "edge int, hard string, edit string, hard_from int, edit_from int, n int")
    pairs = table.select("edge", "hard", "edit", "hard_from", "edit_from", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return pairs.select("edge", "hard", "edit", (F.col("hard_from") + F.col("k")).alias("hard_rank"), (F.col("edit_from") + F.col("k")).alias("edit_rank"), F.col("k").alias("edge_rank"))


def assign_roles(pairs: DataFrame, singles: DataFrame, requests: DataFrame) -> DataFrame:
    """(family_id, role): pairs (family_id, hard, edit) and singles (family_id, category, phenomenon) under the quotas of ``requests``.

    Per role a flow chooses how many pairs of each edge it takes; the last role gets the
    rest. Where the flows of earlier roles leave a later one without, each role takes of
    every edge as many as the pairing within roles counted. Families take roles in order
    of id, by rank against cumulative quotas.
    """
    spark = pairs.sparkSession
    q = {(r.category, r.phenomenon, r.role): r.n for r in quotas(requests).collect()}
    whole = {(r.hard, r.edit): r.n for r in pairs.groupBy("hard", "edit").agg(F.count("*").alias("n")).collect()}
    demand = lambda role, c: {p: n for (cat, p, r), n in q.items() if cat == c and r == role}
    left, took = dict(whole), {}
    try:
        for role in ROLES[:-1]:
            took[role] = select_flow(left, demand(role, "hard_keep"), demand(role, "single_minimal_edit"))
            left = {e: n - took[role][e] for e, n in left.items()}
        took[ROLES[-1]] = select_flow(left, demand(ROLES[-1], "hard_keep"), demand(ROLES[-1], "single_minimal_edit"))
    except ValueError:
        counted = {(r.role, (r.hard, r.edit)): r.n for r in role_edges(requests).collect()}
        took = {role: {e: counted.get((role, e), 0) for e in whole} for role in ROLES}
        if any(sum(took[role][e] for role in ROLES) != n for e, n in whole.items()):
            raise
    at = dict.fromkeys(whole, 0)
    ranges = []
    for role in ROLES:
        for edge in sorted(whole):
            if n := took[role][edge]:
                ranges.append((edge[0], edge[1], role, at[edge], at[edge] + n))
                at[edge] += n
    by_edge = spark.createDataFrame(ranges, "hard string, edit string, role string, lo int, hi int")
    placed = ranked_in_order(pairs.select("family_id", "hard", "edit"), ["hard", "edit"], ["family_id"])
    first = placed.join(by_edge, ["hard", "edit"]).where("rank >= lo and rank < hi").select("family_id", "role")
    single_ranges, seen = [], {}
    for category, phenomenon, role in sorted(q, key=lambda k: (k[0], k[1], ROLES.index(k[2]))):
        lo = seen.get((category, phenomenon), 0)
        seen[category, phenomenon] = lo + q[category, phenomenon, role]
        single_ranges.append((category, phenomenon, role, lo, seen[category, phenomenon]))
    by_kind = spark.createDataFrame(single_ranges, "category string, phenomenon string, role string, lo int, hi int")
    placed = ranked_in_order(singles.select("family_id", "category", "phenomenon"), ["category", "phenomenon"], ["family_id"])
    second = placed.join(by_kind, ["category", "phenomenon"], "left").where("role is null or (rank >= lo and rank < hi)")
    second = second.select("family_id", F.coalesce("role", F.raise_error(F.lit("a family has no quota"))).alias("role"))
    return first.unionByName(second)

