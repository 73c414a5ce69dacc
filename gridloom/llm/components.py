"""Splits that keep related records together.

Groups are connected components, found by hooking and shortcutting over a parent array
held as a table: each round hooks every root onto the least root it meets through a
shared key and then shortcuts every parent to its grandparent. Roles for whole groups are
chosen by subset-sum bitsets over the multiplicities of group sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import pick
from gridloom.functions.ranking import ranked
from gridloom.functions.text import fold_key
from gridloom.operators.nested import latest
from gridloom.session import cut

#: Keys that stand for no key, and prefixes that don't count for that.
FILLERS = ("", "n/a", "none", "unknown")
PREFIX = r"^(?:document-|pair-)"
KEYS = ("document_cluster_id", "counterfactual_pair_id", "generative_family_key")


def link_key(c: Column) -> Column:
    """A key folded for comparison, or null if it is a filler and links nothing."""
    key = fold_key(c)
    bare = fold_key(F.regexp_replace(key, PREFIX, ""))
    return F.when(~key.isin(*FILLERS) & ~bare.isin(*FILLERS) & ~bare.rlike("^0+$"), key)


def key_links(records: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(sample, key): the linking keys of each sample's latest revision; a key links within its own field only."""
    last = latest(pick(records, "sample_id", "revised_at", "identity").select("sample_id", "revised_at", *[F.col(f"identity.{k}").alias(k) for k in keys]), "sample_id", "revised_at", list(keys))
    entries = F.array(*[F.struct(link_key(F.col(k)).alias("v"), F.lit(str(i)).alias("f")) for i, k in enumerate(keys)])
    return last.select(F.col("sample_id").alias("sample"), F.inline(entries)).where("v is not null").select("sample", F.concat("f", F.lit(":"), "v").alias("key"))


def components(links: DataFrame) -> DataFrame:
    """(sample, root): each sample of ``links`` with the least sample of its group.

    Two samples with a key in common are in one group. A key held by a third of all
    samples is one row: links are aggregated to the least sample per key before any
    shuffle, and no pairs within a key are formed. Samples without links don't occur.
    """
    # A key of one sample links nothing; a star to the least sample stands for all pairs.
    hubs = links.groupBy("key").agg(F.min("sample").alias("hub"), F.max("sample").alias("last")).where("hub < last")
    edges = links.join(hubs.select("key", "hub"), "key").where("sample != hub").select("sample", "hub").distinct()
    edges = cut(edges)
    parent = cut(edges.select("sample", F.col("hub").alias("root")).unionByName(edges.select(F.col("hub").alias("sample"), F.col("hub").alias("root"))).groupBy("sample").agg(F.min("root").alias("root")))
    while True:  # ends: roots only ever become less
        # Hook: across each edge, the greater root learns of the lesser. A hub's samples are
        # taken together by root first, so that a hot hub meets its own root in few rows.
        a = edges.join(parent.select("sample", F.col("root").alias("ra")), "sample").select("hub", "ra").distinct()
        ends = a.join(parent.select(F.col("sample").alias("hub"), F.col("root").alias("rb")), "hub").where("ra != rb")
        hooks = ends.groupBy(F.greatest("ra", "rb").alias("sample")).agg(F.min(F.least("ra", "rb")).alias("to"))
        hooked = parent.join(hooks, "sample", "left").select("sample", F.col("root").alias("was"), F.least("root", "to").alias("root"))
        # Shortcut: the parent's parent. The root before is carried along, to see what changed.
        up = hooked.where("root != sample").select(F.col("sample").alias("root"), F.col("root").alias("up"))
        jumped = cut(hooked.join(up, "root", "left").select("sample", "was", F.least("root", "up").alias("root")))
        parent = jumped.select("sample", "root")
        if jumped.where("root != was").isEmpty():
            return parent


def choose_sizes(sizes: dict[int, int], shares: dict[str, float]) -> dict[str, dict[int, int]]:
    """How many groups of each size go to each role: role -> size -> number.

    sizes: size -> number of groups of that size; there are at most about the square root
    of twice the number of samples. For each role but the one with the greatest share,
    least share first: every size gives its share of groups, what is lacking is shared out
    again among sizes that still fit, and a bitset of reachable totals (bit t set if t
    samples can be reached) over the groups left, their multiplicities split into powers
    of two, closes the small rest. If that misses the target, a bitset over all groups
    finds the total closest to it. The last role gets the rest. The greatest bitset has
    two bits for each sample wanted; a few of that length are held at a time.
    """
    total = sum(s * n for s, n in sizes.items())
    weight = sum(shares.values()) or 1.0
    roles = sorted(shares, key=lambda r: (shares[r], r))
    left, chosen = dict(sizes), {}
    for role in roles[:-1]:
        want = round(total * shares[role] / weight)
        here = sum(s * n for s, n in left.items())
        share = want / here if here else 0.0
        picked = _fill(left, {s: int(n * share) for s, n in left.items()}, want)
        if sum(s * n for s, n in picked.items()) != want:
            whole = subset_sum(left, want)
            picked = min(picked, whole, key=lambda p: abs(want - sum(s * n for s, n in p.items())))
        for size, n in picked.items():
            left[size] -= n
        chosen[role] = picked
    if roles:
        chosen[roles[-1]] = {s: n for s, n in left.items() if n}
    return chosen


def _fill(left: dict[int, int], base: dict[int, int], want: int) -> dict[int, int]:
    """``base`` and further groups of ``left``, with a total close to ``want``."""
    picked = {s: n for s, n in base.items() if n}
    gap = want - sum(s * n for s, n in picked.items())
    free = {s: n - picked.get(s, 0) for s, n in left.items()}
    while True:  # each time at most one group of each size is lacking; ends as the gap shrinks
        fits = {s: n for s, n in free.items() if n and s <= gap}
        held = sum(s * n for s, n in fits.items())
        more = {s: k for s, n in fits.items() if (k := n * min(gap, held) // held)}
        if not more:
            break
        for s, k in more.items():
            picked[s] = picked.get(s, 0) + k
            free[s] -= k
            gap -= s * k
    for s, k in subset_sum({s: n for s, n in free.items() if n and s <= gap}, gap).items():
        picked[s] = picked.get(s, 0) + k
    return picked


def _reach(pieces: list[int], limit: int) -> int:
    """The bitset of totals of some of the pieces, up to ``limit``."""
    bits, mask = 1, (1 << (limit + 1)) - 1
    for p in pieces:
        if p <= limit:
            bits = (bits | (bits << p)) & mask
    return bits


def _mirrored(bits: int, at: int) -> int:
    """Bit t of ``bits`` as bit at - t, for t up to ``at``."""
    n = at // 8 + 1
    table = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
    turned = int.from_bytes((bits & ((1 << (at + 1)) - 1)).to_bytes(n, "little").translate(table)[::-1], "little")
    return turned >> (8 * n - 1 - at)


def _choose(pieces: list[int], at: int) -> list[int]:
    """Places of pieces that sum to ``at``, which some do. By halves: a total of one half that the other completes; so no more than a few bitsets are held."""
    out, todo = [], [(0, len(pieces), at)]
    while todo:
        lo, hi, at = todo.pop()
        if not at:
            continue
        if hi - lo == 1:
            out.append(lo)
            continue
        mid = (lo + hi) // 2
        both = _reach(pieces[lo:mid], at) & _mirrored(_reach(pieces[mid:hi], at), at)
        first = both.bit_length() - 1
        todo += [(lo, mid, first), (mid, hi, at - first)]
    return out


def subset_sum(sizes: dict[int, int], want: int) -> dict[int, int]:
    """A choice size -> number, within the multiplicities, whose total is closest to ``want``; of two equally close the lesser."""
    parts = []  # (size, how many of it together), powers of two
    for size in sorted(sizes, reverse=True):
        n, part = sizes[size], 1
        while n > 0:
            parts.append((size, min(part, n)))
            n -= min(part, n)
            part *= 2
    pieces = [size * take for size, take in parts]
    # Nothing above twice the target is closer than nothing at all.
    reach = _reach(pieces, min(2 * want, sum(pieces)))
    at = (reach & ((1 << (want + 1)) - 1)).bit_length() - 1
    above = reach >> want
    if above:
        up = (above & -above).bit_length() - 1
        if up < want - at:
            at = want + up
    picked: dict[int, int] = {}
    for k in _choose(pieces, at):
        size, take = parts[k]
        picked[size] = picked.get(size, 0) + take
    return picked


def assign_roles(samples: DataFrame, groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample, group_first, group_size, role): a role for each sample, the same for a whole group.

    samples: (sample), each once; groups: from ``components``; samples in no group are
    groups of their own. targets: (role, share), as many rows as roles; shares are scaled
    to sum to one, null or negative ones count as zero. Without targets, role is null.
    The histogram of group sizes that is gathered on the driver has at most
    sqrt(2 x samples) entries.
    """
    spark = samples.sparkSession
    grouped = samples.join(groups, "sample", "left").select("sample", F.coalesce("root", "sample").alias("group_first"))
    sized = cut(grouped.groupBy("group_first").agg(F.count("*").alias("group_size")))
    sizes = {r[0]: r[1] for r in sized.groupBy("group_size").count().collect()}
    shares = {r.role: max(0.0, r.share or 0.0) for r in targets.select("role", "share").where("role is not null").collect()}
    picks = choose_sizes(sizes, shares)
    ranges = []
    for size in sizes:
        at = 0
        for role in sorted(picks):
            n = picks[role].get(size, 0)
            if n:
                ranges.append((size, role, at, at + n))
                at += n
    table = spark.createDataFrame(ranges, "group_size bigint, role string, lo bigint, hi bigint")
    placed = ranked(sized, "group_size", ["group_first"]).join(F.broadcast(table) if len(ranges) < 10000 else table, "group_size", "left").where("role is null or (rank >= lo and rank < hi)")
    return grouped.join(placed.select("group_first", "group_size", "role"), "group_first").select("sample", "group_first", "group_size", "role")
