"""Tree edit distance between nested schemas, and the scripts read off its mappings.

A schema is a set of leaf paths; its tree has an inner node per object and a leaf per
path. Leaves with the same path in both schemas map to themselves, so equal subtrees are
dropped first and only what changed is compared. Between the changed trees the
constrained edit distance for unordered trees (Zhang, 1996) is computed: disjoint
subtrees map to disjoint subtrees, children are matched by maximum-gain assignment. A
leaf maps only to one with which the caller has evidence of equal values, so only pairs
of nodes above such leaves are ever looked at, deepest first. A subtree that the mapping
leaves out but whose values stand elsewhere is moved: the distance is taken again between
what is left. Sizes are those of schemas, not of data.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Cost of a changed name, beside 1 for a node deleted or inserted; less likeness of names, at most this.
RENAME, LIKENESS = 1.0, 1e-3


@dataclass
class Tree:
    """Nodes by number, the root is 0; ``kids`` in order of name. A name may be both a leaf and an object."""

    names: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    kids: list[list[int]] = field(default_factory=lambda: [[]])
    weight: list[int] = field(default_factory=lambda: [1])
    leaf: dict[str, int] = field(default_factory=dict)
    path: dict[int, str] = field(default_factory=dict)

    def add(self, parent: int, name: str) -> int:
        node = len(self.names)
        self.names.append(name)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kids.append([])
        self.weight.append(1)
        self.kids[parent].append(node)
        return node

    def above(self, node: int) -> Iterable[int]:
        """The node and those above it."""
        while node >= 0:
            yield node
            node = self.parent[node]


def schema_tree(paths: Iterable[str]) -> Tree:
    tree, inner = Tree(), {}
    for path in sorted(paths):
        parts = path.split(".")
        at = 0
        for part in parts[:-1]:
            if (at, part) not in inner:
                inner[at, part] = tree.add(at, part)
            at = inner[at, part]
        tree.leaf[path] = tree.add(at, parts[-1])
        tree.path[tree.leaf[path]] = path
    for node in range(len(tree.names) - 1, 0, -1):
        tree.weight[tree.parent[node]] += tree.weight[node]
    return tree


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total gain, each row and column once (shortest augmenting paths with potentials); pairs without gain are left out."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], col = i, 0
        least, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while row_of[col]:
            seen[col] = True
            r = row_of[col]
            c = cost[r - 1] - u[r] - v[1:]
            better = ~seen[1:] & (c < least[1:])
            least[1:][better] = c[better]
            way[1:][better] = col
            open_ = np.where(seen, np.inf, least)
            open_[0] = np.inf
            to = int(open_.argmin())
            step = open_[to]
            u[row_of[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            col = to
        while col:
            row_of[col] = row_of[way[col]]
            col = way[col]
    pairs = [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    pairs = [(j, i) if turned else (i, j) for i, j in pairs]
    return sorted((i, j) for i, j in pairs if gain[i, j] > 0)


def _match(pairs: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The pairs of greatest total gain, each node once; nodes that no pairs connect are matched apart."""
    of_left: dict[int, list[int]] = {}
    of_right: dict[int, list[int]] = {}
    for a, b in pairs:
        of_left.setdefault(a, []).append(b)
        of_right.setdefault(b, []).append(a)
    out, seen = [], set()
    for first in of_left:
        if first in seen:
            continue
        left, right, todo = {first}, set(), [first]
        while todo:
            for b in of_left[todo.pop()]:
                if b not in right:
                    right.add(b)
                    new = [a for a in of_right[b] if a not in left]
                    left.update(new)
                    todo += new
        seen |= left
        rows, cols = sorted(left), sorted(right)
        if len(rows) == len(cols) == 1:
            out.append((rows[0], cols[0]))
            continue
        gain = np.zeros((len(rows), len(cols)))
        col_at = {b: j for j, b in enumerate(cols)}
        for i, a in enumerate(rows):
            for b in of_left[a]:
                gain[i, col_at[b]] = pairs[a, b]
        out += [(rows[i], cols[j]) for i, j in assign(gain)]
    return out


def _likeness(a: str, b: str) -> float:
    """The share of two names that is the same at their ends."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return (head + tail) / max(len(a), len(b), 1)


def distance(old: Iterable[str], new: Iterable[str], same: set[tuple[str, str]]) -> tuple[float, list[tuple[str, str, bool]]]:
    """(cost, mapping) between the trees over leaf paths old and new.

    Cost: the nodes deleted and inserted, and RENAME for each mapped node whose name
    changes. Mapping: (old path, new path, whether the objects around them are mapped to
    each other) of the leaves mapped, all of them in ``same``.

    Gains stand for costs: what a mapping saves against deleting one subtree and inserting
    the other. Pairs without evidence below them gain nothing and don't occur.
    """
    a, b = schema_tree(old), schema_tree(new)
    leaf_pairs = {(a.leaf[p], b.leaf[q]) for p, q in same}
    relevant = {(x, y) for s, t in leaf_pairs for x in a.above(s) for y in b.above(t)}
    below_a: dict[tuple[int, int], list[int]] = {}
    below_b: dict[tuple[int, int], list[int]] = {}
    for x, y in relevant:
        if x and (a.parent[x], y) in relevant:
            below_a.setdefault((a.parent[x], y), []).append(x)
        if y and (x, b.parent[y]) in relevant:
            below_b.setdefault((x, b.parent[y]), []).append(y)
    tree: dict[tuple[int, int], tuple[float, tuple]] = {}
    forest: dict[tuple[int, int], tuple[float, tuple]] = {}
    for x, y in sorted(relevant, key=lambda p: (-a.depth[p[0]] - b.depth[p[1]], p)):
        changed = 0.0 if a.names[x] == b.names[y] else RENAME - LIKENESS * _likeness(a.names[x], b.names[y])
        xs, ys = sorted(below_a.get((x, y), ())), sorted(below_b.get((x, y), ()))
        if x in a.path or y in b.path:
            mapped = (2.0 - changed, ("map",)) if (x, y) in leaf_pairs else (0.0, ("none",))
        else:
            kids = {(i, j): tree[i, j][0] for i in xs for j in ys if (i, j) in tree and tree[i, j][0] > 0}
            matched = _match(kids)
            tries = [(sum(kids[p] for p in matched), ("kids", matched))]
            tries += [(forest[x, j][0], ("forest", x, j)) for j in ys if (x, j) in forest] + [(forest[i, y][0], ("forest", i, y)) for i in xs if (i, y) in forest]
            forest[x, y] = max(tries, key=lambda t: t[0])
            mapped = (2.0 - changed + forest[x, y][0], ("map",)) if forest[x, y][0] > 0 else (0.0, ("none",))
        tries = [mapped] + [(tree[x, j][0], ("tree", x, j)) for j in ys] + [(tree[i, y][0], ("tree", i, y)) for i in xs]
        tree[x, y] = max(tries, key=lambda t: t[0])
    saved, found, inner = 0.0, [], {}
    if (0, 0) in relevant:
        saved = forest[0, 0][0]  # the roots are always mapped
        inner[0] = 0
        todo = [("forest", 0, 0)]
        while todo:
            kind, x, y = todo.pop()
            how = (tree if kind == "tree" else forest)[x, y][1]
            if kind == "tree" and how[0] == "map":
                if x in a.path:
                    found.append((x, y))
                else:
                    inner[x] = y
                    todo.append(("forest", x, y))
            elif how[0] == "kids":
                todo += [("tree", i, j) for i, j in how[1]]
            elif how[0] in ("tree", "forest"):
                todo.append(how)
    cost = a.weight[0] + b.weight[0] - 2 - saved
    return cost, sorted((a.path[x], b.path[y], inner.get(a.parent[x]) == b.parent[y]) for x, y in found)


def edit_script(old: dict[str, str], new: dict[str, str], same: set[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """Minimum-cost script from schema old to new (path -> type): (op, old path, new path), read off the mapping of their trees.

    A path in both schemas maps to itself: ``retype`` if its type differs. A leaf mapped
    to another path is a ``rename`` if the objects around both are mapped to each other,
    else a ``move``; so are the leaves mapped when the distance is taken again between what
    the mapping left out. Leaves never mapped are ``delete`` and ``add``. same: pairs of a
    vanished and a new path that hold equal values; each path is mapped once at most.
    """
    script = [("retype", p, p) for p in sorted(old.keys() & new.keys()) if old[p] != new[p]]
    gone, came = set(old) - set(new), set(new) - set(old)
    left = {(p, q) for p, q in same if p in gone and q in came}
    first = True
    while left:
        for p, q, around in distance(gone, came, left)[1]:
            script.append(("rename" if first and around else "move", p, q))
            gone.discard(p)
            came.discard(q)
        left = {(p, q) for p, q in left if p in gone and q in came}
        first = False
    return script + [("delete", p, "") for p in sorted(gone)] + [("add", "", q) for q in sorted(came)]
