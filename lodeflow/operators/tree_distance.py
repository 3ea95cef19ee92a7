"""Edit scripts between unordered labelled trees: keep, rename, move, insert, delete at minimum cost.

The distance is the constrained edit distance of unordered trees (disjoint
subtrees go to disjoint subtrees, K. Zhang 1996), which, unlike the
unconstrained one, is found in polynomial time: bottom-up over pairs of nodes,
with a minimum-cost assignment between the children of each pair. A leaf that
the constraint makes a deletion here and an insertion there, because it went
below another parent, is then joined to a move where that is cheaper.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

INSERT, DELETE, MOVE = 1.0, 1.0, 0.2
#: Costs more than any delete and insert together.
NEVER = 4.0


@dataclass
class Node:
    """A node: the last part of its path, the whole path, what the cost function needs, and its children."""

    name: str
    path: str
    data: object = None
    children: list[Node] = field(default_factory=list)
    nodes: int = 0

    def size(self) -> int:
        """Nodes of the subtree; a tree doesn't change once it is asked for."""
        if not self.nodes:
            self.nodes = 1 + sum(c.size() for c in self.children)
        return self.nodes

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def tree_of(leaves: dict[str, object]) -> Node:
    """The tree of dotted paths; leaves carry their data."""
    root = Node("", "")
    inner = {"": root}
    for path in sorted(leaves):
        at, parts = root, path.split(".")
        for i, part in enumerate(parts):
            here = ".".join(parts[: i + 1])
            if i == len(parts) - 1:
                at.children.append(Node(part, path, leaves[path]))
            else:
                if here not in inner:
                    inner[here] = Node(part, here)
                    at.children.append(inner[here])
                at = inner[here]
    return root


def assign(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns (no fewer columns than rows), by shortest augmenting paths."""
    if not cost:
        return []
    n, m = len(cost), len(cost[0])
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]


class _Distance:
    """Distances and mappings of all pairs of nodes of two trees."""

    def __init__(self, rename: Callable[[Node, Node], float]) -> None:
        self.rename = rename
        self.trees: dict[tuple[int, int], tuple[float, list]] = {}
        self.forests: dict[tuple[int, int], tuple[float, list]] = {}

    def _relabel(self, a: Node, b: Node) -> float:
        if not a.path or not b.path:
            return 0.0 if a.path == b.path else NEVER
        if bool(a.children) != bool(b.children):
            return NEVER
        if a.children:
            return 0.0 if a.name == b.name else 0.5
        return self.rename(a, b)

    def tree(self, a: Node, b: Node) -> tuple[float, list]:
        """Cost and mapped pairs of nodes for the subtrees below a and b."""
        key = id(a), id(b)
        if not a.children and not b.children and a.path and b.path:
            c = self.rename(a, b)
            return (c, [(a, b)]) if c < DELETE + INSERT else (DELETE + INSERT, [])
        if not a.path and not b.path:
            # Roots stand for the files themselves.
            cost, pairs = self.forest(a, b)
            return cost, [(a, b), *pairs]
        if key not in self.trees:
            cost, pairs = self.forest(a, b)
            found = [(cost + self._relabel(a, b), [(a, b), *pairs])]
            # a is deleted, or b inserted, and the rest goes on with one child.
            found += [(DELETE * (a.size() - c.size()) + self.tree(c, b)[0], self.tree(c, b)[1]) for c in a.children]
            found += [(INSERT * (b.size() - c.size()) + self.tree(a, c)[0], self.tree(a, c)[1]) for c in b.children]
            found.append((DELETE * a.size() + INSERT * b.size(), []))
            self.trees[key] = min(found, key=lambda x: x[0])
        return self.trees[key]

    def forest(self, a: Node, b: Node) -> tuple[float, list]:
        """Cost and mapped pairs of nodes for the children of a and of b."""
        key = id(a), id(b)
        if key not in self.forests:
            gone, new = DELETE * (a.size() - 1), INSERT * (b.size() - 1)
            found = [self._children(a, b)]
            for c in a.children:
                if c.children:
                    cost, pairs = self.forest(c, b)
                    found.append((gone - DELETE * (c.size() - 1) + cost, pairs))
            for c in b.children:
                if c.children:
                    cost, pairs = self.forest(a, c)
                    found.append((new - INSERT * (c.size() - 1) + cost, pairs))
            self.forests[key] = min(found, key=lambda x: x[0])
        return self.forests[key]

    def _children(self, a: Node, b: Node) -> tuple[float, list]:
        """The best assignment of children to children, of which any may be left over."""
        cost, pairs = 0.0, []
        by_name = {c.name: c for c in b.children}
        left, right = [], {id(c): c for c in b.children}
        for c in a.children:
            other = by_name.get(c.name)
            # Equal leaves cost nothing together and are settled first.
            if other is not None and not c.children and not other.children and self._relabel(c, other) == 0.0:
                pairs.append((c, other))
                del right[id(other)]
            else:
                left.append(c)
        others = list(right.values())
        # What has no partner that is cheaper than to delete the one and insert the other takes no part in the assignment.
        near = [[self.tree(x, y)[0] < DELETE * x.size() + INSERT * y.size() for y in others] for x in left]
        used = [any(row[j] for row in near) for j in range(len(others))]
        cost += DELETE * sum(x.size() for x, row in zip(left, near, strict=True) if not any(row)) + INSERT * sum(y.size() for y, u in zip(others, used, strict=True) if not u)
        left, others = [x for x, row in zip(left, near, strict=True) if any(row)], [y for y, u in zip(others, used, strict=True) if u]
        n, m = len(left), len(others)
        if n and m:
            far = NEVER * 1000
            table = [[self.tree(x, y)[0] for y in others] + [DELETE * x.size() if k == i else far for k in range(n)] for i, x in enumerate(left)]
            table += [[INSERT * y.size() if k == j else far for k, y in enumerate(others)] + [0.0] * n for j in range(m)]
            taken = set()
            for i, j in assign(table):
                if i < n:
                    cost += table[i][j]
                    if j < m:
                        pairs += self.tree(left[i], others[j])[1]
                        taken.add(j)
            cost += sum(INSERT * y.size() for j, y in enumerate(others) if j not in taken)
        return cost, pairs


def distance(a: Node, b: Node, rename: Callable[[Node, Node], float]) -> float:
    """The constrained edit distance, without moves."""
    return _Distance(rename).tree(a, b)[0]


def edit_script(a: Node, b: Node, rename: Callable[[Node, Node], float]) -> tuple[float, list[tuple[str, str | None, str | None]]]:
    """Cost, and (operation, path in a, path in b) for every leaf: keep, rename, move, delete or insert.

    rename(x, y): the cost of calling leaf x what leaf y is called, 0 for the
    same name, DELETE + INSERT or more where they can't be the same. A move may
    change the name as well.
    """
    cost, pairs = _Distance(rename).tree(a, b)
    pairs = [(x, y) for x, y in pairs if x.path and y.path and not x.children and not y.children and rename(x, y) < DELETE + INSERT]
    mapped, reached = {x.path for x, _ in pairs}, {y.path for _, y in pairs}
    lost = [x for x in a.walk() if x.path and not x.children and x.path not in mapped]
    new = [y for y in b.walk() if y.path and not y.children and y.path not in reached]
    movable = [x for x in lost if any(rename(x, y) + MOVE < DELETE + INSERT for y in new)]
    if movable:
        table = [[rename(x, y) + MOVE for y in new] + [DELETE + INSERT] * len(movable) for x in movable]
        for i, j in assign(table):
            if j < len(new) and table[i][j] < DELETE + INSERT:
                pairs.append((movable[i], new[j]))
                cost += table[i][j] - DELETE - INSERT
    out = []
    for x, y in pairs:
        parents = x.path.rpartition(".")[0], y.path.rpartition(".")[0]
        out.append(("move" if parents[0] != parents[1] else "keep" if x.name == y.name else "rename", x.path, y.path))
    mapped, reached = {x.path for x, _ in pairs}, {y.path for _, y in pairs}
    out += [("delete", x.path, None) for x in lost if x.path not in mapped] + [("insert", None, y.path) for y in new if y.path not in reached]
    return cost, out
