"""Matching the nodes of two trees, phase by phase, and the mapping it gives.

Each phase only adds matches between nodes that have none. The phases of one pair depend on each other, so
a pair is matched in one call; pairs are independent, so a frame of pairs is matched where it lies.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import languages as L
from palimpsest.operators import ted
from palimpsest.operators.alignment import TREE_EDITS, common_subsequence, weighted_subsequence
from palimpsest.operators.trees import Tree, build

#: Nodes left over on a side beyond which edit distances give way to sequences.
EXPENSIVE = 5000
#: Cells of one weighted alignment, and of one edit distance; beyond these, sequences of hashes are aligned.
CELLS = 250_000
DISTANCE_CELLS = 40_000


@dataclass(frozen=True)
class Config:
    """Heuristics that may be switched, and the limits that matching keeps to."""

    match_imports: bool = False
    match_flow_control: bool = False
    bottom_up: bool = False
    moved_subtrees: bool = True
    exact: bool = True
    min_depth: int = 0
    min_subtree_size: int = 45
    block_cost_ratio: float = 0.8
    block_min_children: int = 2
    block_min_size: int = 4
    dice: float = 0.9
    flow_similarity: float = 0.75
    import_similarity: float = 0.5
    flat_children: int = 50
    flat_recurse: int = 20
    min_move_size: int = 4
    max_nodes: int = 16_000
    #: Stop before edit distances: what is left over may be looked at first, and matched later without this.
    paused: bool = False


#: What a pair of partners weighs against unmatched pairs in a slot, and the size from which a slot's subtrees must share a node.
SLOT_ANCHOR = 10_000.0
LARGE_SLOT = 20


def alike(x: str, y: str, least: float = 0.6) -> bool:
    """Whether two leaves are equal or share enough pairs of neighbouring characters."""
    if x == y:
        return True
    p, q = {x[k : k + 2] for k in range(len(x) - 1)}, {y[k : k + 2] for k in range(len(y) - 1)}
    return bool(p and q) and 2 * len(p & q) / (len(p) + len(q)) >= least


@dataclass
class Match:
    reason: str
    source: str | None = None


class Matching:
    """The state of matching one pair: partners on both sides, and why."""

    def __init__(self, before: Tree, after: Tree, config: Config):
        self.b, self.a, self.config = before, after, config
        self.to_a: dict[int, int] = {}
        self.to_b: dict[int, int] = {}
        self.why: dict[tuple[int, int], Match] = {}

    def add(self, i: int, j: int, reason: str, source: str | None = None) -> bool:
        if i in self.to_a or j in self.to_b or not ted.compatible(self.b.kind[i], self.a.kind[j], self.b.language):
            return False
        self.to_a[i], self.to_b[j] = j, i
        self.why[i, j] = Match(reason, source)
        return True

    # ---- building blocks

    def lockstep(self, i: int, j: int, reason: str, hashes: tuple[list[int], list[int]]) -> None:
        """Match two subtrees of equal hash node by node; where children of a container are in another order, by hash and then by kind."""
        stack = [(i, j)]
        hb, ha = hashes
        while stack:
            x, y = stack.pop()
            self.add(x, y, reason)
            cb, ca = self.b.children[x], self.a.children[y]
            if [hb[c] for c in cb] == [ha[c] for c in ca]:
                stack += zip(cb, ca, strict=True)
                continue
            left: dict[int, list[int]] = defaultdict(list)
            for c in ca:
                left[ha[c]].append(c)
            for c in cb:
                if left[hb[c]]:
                    stack.append((c, left[hb[c]].pop(0)))

    def by_hash(self, hb: list[int], ha: list[int], nodes: Iterable[int], reason: str, smallest: int = 1) -> None:
        """Nodes in order take the nearest free node of equal hash."""
        index: dict[int, list[int]] = defaultdict(list)
        for j in range(self.a.n):
            if self.a.size[j] >= smallest:
                index[ha[j]].append(j)
        for i in nodes:
            if i in self.to_a:
                continue
            free = [j for j in index.get(hb[i], ()) if j not in self.to_b]
            if free:
                j = min(free, key=lambda j: (abs(self.a.start[j] - self.b.start[i]), j))
                self.lockstep(i, j, reason, (hb, ha))

    def greedy(self, pairs: Iterable[tuple[float, int, int]], most: float, accept: Callable[[int, int], None]) -> None:
        """Cheapest pairs first, each node once."""
        for cost, i, j in sorted(pairs, key=lambda p: (p[0], self.b.start[p[1]], self.a.start[p[2]])):
            if cost <= most and i not in self.to_a and j not in self.to_b:
                accept(i, j)

    def nearest(self, tree: Tree, mapped: dict[int, int], i: int) -> tuple[int | None, tuple[str, ...]]:
        """The nearest matched ancestor, and the kinds on the way to it."""
        path = []
        for x in tree.ancestors(i):
            if x in mapped:
                return x, tuple(path)
            path.append(tree.kind[x])
        return None, tuple(path)

    def child_cost(self, i: int, j: int) -> float:
        """What children without an equal one on the other side weigh, as a share of both subtrees."""
        b, a = self.b, self.a
        cb, ca = b.children[i], a.children[j]
        if {b.full[c] for c in cb}.isdisjoint(a.full[c] for c in ca) and len(cb) * len(ca) <= CELLS:
            pairs = []
        elif len(cb) * len(ca) > CELLS:
            pairs = common_subsequence([b.value[c] for c in cb], [a.value[c] for c in ca], TREE_EDITS) or []
        else:
            pairs = weighted_subsequence(len(cb), len(ca), lambda x, y: float(b.size[cb[x]]) if b.full[cb[x]] == a.full[ca[y]] else 0.0)
        kept = sum(b.size[cb[x]] + a.size[ca[y]] for x, y in pairs)
        whole = b.size[i] + a.size[j] - 2
        return (whole - kept) / (whole + 2)

    # ---- phases

    def phase_hashes(self) -> None:
        b, a, c = self.b, self.a, self.config
        chosen = lambda t: sorted((i for i in range(t.n) if t.anchor[i] or (t.depth[i] >= c.min_depth and t.size[i] >= c.min_subtree_size)), key=lambda i: (-t.size[i], t.start[i], i))
        self.by_hash(b.value, a.value, chosen(b), "IdenticalHash")
        self.by_hash(b.only, a.only, [i for i in chosen(b) if b.anchor[i] and b.size[i] > 2], "IdenticalShape", 3)

    def phase_comments(self) -> None:
        """A comment before a matched node matches the equal one before its partner."""
        for i, j in sorted(self.to_a.items()):
            x, y = self.before(self.b, i), self.before(self.a, j)
            if x is not None and y is not None and self.b.comment[x] and self.a.comment[y] and self.b.text(x) == self.a.text(y):
                self.add(x, y, "PrecedingComment")

    @staticmethod
    def before(t: Tree, i: int) -> int | None:
        p, s = t.parent[i], t.sib[i]
        return t.children[p][s - 1] if p >= 0 and s > 0 else None

    def phase_diagnostics(self) -> None:
        """Calls that only report match equal ones, in order, the largest first."""

        def calls(t: Tree) -> list[int]:
            return [i for i in range(t.n) if t.kind[i] in L.CALLS.get(t.language, ()) and any(w in t.text(i).split("(")[0].rpartition(".")[2].lower() for w in L.DIAGNOSTIC_WORDS)]

        self.by_hash(self.b.full, self.a.full, sorted(calls(self.b), key=lambda i: (-self.b.size[i], i)), "DiagnosticStatement")

    def qualified(self, t: Tree, i: int) -> str:
        return "::".join([*(t.name[x] for x in reversed(list(t.ancestors(i))) if t.name[x]), t.name[i] or ""])

    def phase_names(self) -> None:
        """Declarations of one kind and qualified name match, the most alike first."""
        groups: dict[tuple, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        for side, t, mapped in ((0, self.b, self.to_a), (1, self.a, self.to_b)):
            for i in range(t.n):
                if t.name[i] and i not in mapped:
                    groups[t.kind[i], self.qualified(t, i)][side].append(i)
        pairs = [((self.child_cost(i, j) if len(x) * len(y) > 1 else 0.0), i, j) for x, y in groups.values() for i in x for j in y]
        self.greedy(pairs, float("inf"), lambda i, j: self.add(i, j, "QualifiedName"))

    def phase_imports(self) -> None:
        """Imports whose names overlap enough."""

        def names(t: Tree, mapped: dict[int, int]) -> list[tuple[int, frozenset]]:
            return [(i, frozenset(t.text(c) for c in t.children[i])) for i in range(t.n) if t.kind[i] in L.IMPORTS.get(t.language, ()) and i not in mapped]

        other = names(self.a, self.to_b)
        index: dict[str, list[int]] = defaultdict(list)
        for k, (_, s) in enumerate(other):
            for x in s:
                index[x].append(k)
        pairs = []
        for i, s in names(self.b, self.to_a):
            for k in {k for x in s for k in index[x]}:
                j, r = other[k]
                pairs.append((1 - len(s & r) / len(s | r), i, j))
        self.greedy(pairs, 1 - self.config.import_similarity, lambda i, j: self.add(i, j, "ImportList"))

    def phase_blocks(self) -> None:
        """Blocks below partners, by the same way of kinds, that keep enough of their children."""
        groups: dict[tuple, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        for side, t, mapped in ((0, self.b, self.to_a), (1, self.a, self.to_b)):
            for i in range(t.n):
                if i not in mapped and t.kind[i] in L.BLOCKS.get(t.language, ()) and len(t.children[i]) >= self.config.block_min_children and t.size[i] >= self.config.block_min_size:
                    up, way = self.nearest(t, mapped, i)
                    if up is not None:
                        groups[self.to_a[up] if side == 0 else up, way, t.kind[i]][side].append(i)
        pairs = [(self.child_cost(i, j), i, j) for x, y in groups.values() for i in x for j in y]
        self.greedy(pairs, self.config.block_cost_ratio, lambda i, j: self.add(i, j, "AnchorBlock"))

    def phase_flow(self) -> None:
        """Branches of one family whose arms say much the same."""

        def found(t: Tree, mapped: dict[int, int]):
            family = L.FLOW.get(t.language, {})
            return [(family[t.kind[i]], i, frozenset(t.text(c).strip() for c in t.children[i] if t.leaf(c) or t.size[c] < 20) - {"", "_"}) for i in range(t.n) if t.kind[i] in family and i not in mapped]

        pairs = []
        after = found(self.a, self.to_b)
        for f, i, s in found(self.b, self.to_a):
            pairs += [(1 - len(s & r) / len(s | r), i, j) for g, j, r in after if f == g and s & r]
        self.greedy(pairs, 1 - self.config.flow_similarity, lambda i, j: self.add(i, j, "FlowControl"))

    def phase_bottom_up(self) -> None:
        """A node whose children mostly match children of one node matches that node."""
        b, a = self.b, self.a
        for i in sorted((i for i in range(b.n) if i not in self.to_a and len(b.children[i]) >= 2 and b.size[i] >= 4), key=lambda i: (-b.depth[i], i)):
            votes: dict[int, int] = defaultdict(int)
            for c in b.children[i]:
                if c in self.to_a and a.parent[self.to_a[c]] >= 0:
                    votes[a.parent[self.to_a[c]]] += 1
            free = {j: v for j, v in votes.items() if j not in self.to_b}
            if not free:
                continue
            j = max(free, key=lambda j: (free[j], -j))
            shared = sum(1 for x in b.subtree(i) if x in self.to_a and j < self.to_a[x] < j + a.size[j])
            if 2 * shared / max(1, b.size[i] + a.size[j] - 2) >= self.config.dice:
                self.add(i, j, "BottomUp")

    def phase_flat(self) -> None:
        """Wide sequences below partners are aligned by the hashes of their children; few left over are looked at closely."""
        for i, j in sorted(self.to_a.items()):
            cb = [c for c in self.b.children[i] if c not in self.to_a]
            ca = [c for c in self.a.children[j] if c not in self.to_b]
            if min(len(cb), len(ca)) >= self.config.flat_children:
                self.sequence(cb, ca, "FlatSequence")

    def sequence(self, cb: list[int], ca: list[int], reason: str) -> None:
        for x, y in common_subsequence([self.b.full[c] for c in cb], [self.a.full[c] for c in ca], TREE_EDITS) or []:
            self.lockstep(cb[x], ca[y], reason, (self.b.full, self.a.full))

    def roots_left(self, t: Tree, mapped: dict[int, int]) -> list[int]:
        """Nodes without a partner whose parent has one, or that have no parent."""
        return [i for i in range(t.n) if i not in mapped and (t.parent[i] < 0 or t.parent[i] in mapped)]

    def phase_residual(self) -> None:
        """Edit distance between what partners have left below them, or sequences where there is too much of it."""
        b, a = self.b, self.a
        if 0 not in self.to_a and 0 not in self.to_b:
            self.add(0, 0, "Root")
        left = max(b.n - len(self.to_a), a.n - len(self.to_b))
        if left > EXPENSIVE or not self.config.exact:
            self.sequence(self.roots_left(b, self.to_a), self.roots_left(a, self.to_b), "Fallback")
            return
        todo = sorted(self.to_a.items())
        while todo:
            i, j = todo.pop(0)
            # forests of nodes without partners; what hangs below a matched node is not theirs
            free_b = lambda x: [c for c in b.children[x] if c not in self.to_a]
            free_a = lambda x: [c for c in a.children[x] if c not in self.to_b]
            rb, ra = free_b(i), free_a(j)
            if not rb or not ra:
                continue
            self.sequence(rb, ra, "EqualSibling")
            rb, ra = free_b(i), free_a(j)
            if not rb or not ra:
                continue
            fb, fa = ted.Forest(rb, free_b), ted.Forest(ra, free_a)
            if len(fb.node) * len(fa.node) > DISTANCE_CELLS:
                continue
            _, pairs = ted.distance(fb, fa, self.cost)
            for x, y in sorted(pairs):
                if self.cost(x, y) < ted.FORBIDDEN and self.allowed(x, y) and self.add(x, y, "EditDistance", "residual"):
                    pass

    def cost(self, i: int, j: int) -> float:
        b, a = self.b, self.a
        return ted.change_cost(b.kind[i], a.kind[j], b.text(i) if b.leaf(i) else None, a.text(j) if a.leaf(j) else None, b.language)

    def allowed(self, i: int, j: int) -> bool:
        """A match may not stand between partners whose places it contradicts: below one, it must be below the other; signs need matched parents."""
        b, a = self.b, self.a
        up = next((x for x in b.ancestors(i) if x in self.to_a), None)
        if up is not None:
            y = self.to_a[up]
            if not y <= j < y + a.size[y]:
                return False
        if b.leaf(i) and b.text(i) != a.text(j) and (b.kind[i] in L.GENERIC or a.kind[j] in L.GENERIC):
            return self.to_a.get(b.parent[i]) == a.parent[j]
        return True

    def phase_moves(self) -> None:
        """Whole subtrees that were removed here and put in there, the largest first, to the earliest place."""
        b, a, least = self.b, self.a, self.config.min_move_size

        def whole(t: Tree, mapped: dict[int, int]) -> list[int]:
            upto = [0, *accumulate(i in mapped for i in range(t.n))]  # partners before each place
            return [i for i in range(t.n) if t.size[i] >= least and upto[i + t.size[i]] == upto[i]]

        target: dict[int, list[int]] = defaultdict(list)
        for j in whole(a, self.to_b):
            target[a.full[j]].append(j)
        for i in sorted(whole(b, self.to_a), key=lambda i: (-b.size[i], i)):
            if i in self.to_a:
                continue
            j = next((j for j in target.get(b.full[i], ()) if j not in self.to_b), None)
            if j is not None:
                self.lockstep(i, j, "MovedSubtree", (b.full, a.full))

    def phase_context(self) -> None:
        """Leaves that edit distance put together although their texts differ need matched parents, or texts that are alike."""
        for (i, j), why in list(self.why.items()):
            if why.reason != "EditDistance" or not (self.b.leaf(i) and self.a.leaf(j)):
                continue
            x, y = self.b.text(i), self.a.text(j)
            if x != y and self.to_a.get(self.b.parent[i]) != self.a.parent[j] and not alike(x, y):
                del self.to_a[i], self.to_b[j], self.why[i, j]

    def phase_slots(self) -> None:
        """Children of partners that stand in the same place between partners, and are of one kind, match; no partners are crossed for it."""
        b, a = self.b, self.a
        todo = sorted(self.to_a.items())
        while todo:
            i, j = todo.pop(0)
            cb, ca = b.children[i], a.children[j]
            if not any(c not in self.to_a for c in cb) or not any(c not in self.to_b for c in ca) or len(cb) * len(ca) > CELLS:
                continue

            def weight(x: int, y: int) -> float:
                p, q = cb[x], ca[y]  # noqa: B023
                if self.to_a.get(p) == q:
                    return SLOT_ANCHOR
                if p in self.to_a or q in self.to_b or b.kind[p] != a.kind[q] or b.leaf(p) != a.leaf(q) or b.kind[p] in L.GENERIC:
                    return 0.0
                if max(b.size[p], a.size[q]) > LARGE_SLOT and not set(b.full[p : p + b.size[p]]) & set(a.full[q : q + a.size[q]]):
                    return 0.0
                return 2.0 if not b.leaf(p) or alike(b.text(p), a.text(q)) else 1.0

            for x, y in weighted_subsequence(len(cb), len(ca), weight):
                if cb[x] not in self.to_a and ca[y] not in self.to_b and self.add(cb[x], ca[y], "Slot"):
                    todo.append((cb[x], ca[y]))

    def run(self) -> Matching:
        c = self.config
        self.phase_hashes()
        self.phase_comments()
        self.phase_diagnostics()
        self.phase_names()
        if c.match_imports:
            self.phase_imports()
        self.phase_blocks()
        if c.match_flow_control:
            self.phase_flow()
        if c.bottom_up:
            self.phase_bottom_up()
        if 0 not in self.to_a and 0 not in self.to_b:
            self.add(0, 0, "Root")
        self.phase_flat()
        if c.paused:
            return self
        self.phase_residual()
        self.phase_context()
        self.phase_comments()
        if c.moved_subtrees:
            self.phase_moves()
        if c.exact:
            self.phase_slots()
        return self

    # ---- the mapping

    def rows(self) -> Iterator[dict]:
        """Each node of both sides once: with its partner, or alone."""
        b, a = self.b, self.a
        for i in range(b.n):
            j = self.to_a.get(i)
            if j is None:
                yield {"b_pre": i, "a_pre": None, "op": "Delete", "reason": None, "source": None, "cost": ted.DELETE}
                continue
            why = self.why[i, j]
            if b.full[i] == a.full[j]:
                op, cost = "Identical", 0
            elif b.leaf(i) and a.leaf(j):
                op, cost = "Update", int(min(self.cost(i, j), ted.LITERAL_UPDATE)) or 1
            else:
                own = b.kind[i] != a.kind[j] or "".join(b.gaps(i)).split() != "".join(a.gaps(j)).split() or sorted(b.value[c] for c in b.children[i]) == sorted(a.value[c] for c in a.children[j])
                op, cost = "MatchButNotIdentical", int(own)
            yield {"b_pre": i, "a_pre": j, "op": op, "reason": why.reason, "source": why.source, "cost": cost}
        for j in range(a.n):
            if j not in self.to_b:
                yield {"b_pre": None, "a_pre": j, "op": "Insert", "reason": None, "source": None, "cost": ted.INSERT}


def match(before: Tree, after: Tree, config: Config = Config()) -> Matching:  # noqa: B008
    return Matching(before, after, config).run()


MAPPING = "b_pre int, a_pre int, op string, reason string, source string, cost int, b_path string, a_path string, b_kind string, a_kind string, b_size int, a_size int, b_text string, a_text string"


def mappings(pairs: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """(pair_id, mapping columns) of (pair_id, before, after, language): a row for each node of each side; none for pairs without two trees."""
    schema = T.StructType([pairs.schema["pair_id"], *T.StructType.fromDDL(MAPPING).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for batch in batches:
            for key, x, y, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b, a = build(x or "", lang), build(y or "", lang)
                if b is None or a is None:
                    continue
                rows = list(match(b, a, config).rows())
                paths = b.paths(), a.paths()
                for r in rows:
                    for side, t, p in (("b", b, paths[0]), ("a", a, paths[1])):
                        k = r[f"{side}_pre"]
                        r |= {f"{side}_path": None, f"{side}_kind": None, f"{side}_size": None, f"{side}_text": None} if k is None else {f"{side}_path": p[k], f"{side}_kind": t.kind[k], f"{side}_size": t.size[k], f"{side}_text": t.text(k) if t.leaf(k) else None}
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), fields[0].type), *(pa.array([r[f.name] for r in rows], f.type) for f in list(fields)[1:])], schema=fields)

    return pairs.select("pair_id", "before", "after", "language").mapInArrow(run, schema)


RUNS = "status string, nodes_before int, nodes_after int, elapsed_ms double, mapping_rows int, cost long"


def measured(pairs: DataFrame, config: Config = Config(), repeats: int = 1) -> DataFrame:  # noqa: B008
    """(pair_id, status, nodes, median milliseconds, mapping rows, cost): ok, no_tree, skipped_too_large or failed."""
    schema = T.StructType([pairs.schema["pair_id"], *T.StructType.fromDDL(RUNS).fields])

    def one(x: str, y: str, lang: str) -> tuple:
        b, a = build(x, lang), build(y, lang)
        if b is None or a is None:
            return "no_tree", None, None, None, None, None
        if b.n + a.n > config.max_nodes:
            return "skipped_too_large", b.n, a.n, None, None, None
        times = []
        for _ in range(repeats):
            begun = time.perf_counter()
            try:
                rows = list(match(b, a, config).rows())
            except (RecursionError, MemoryError):
                return "failed", b.n, a.n, None, None, None
            times.append(1000 * (time.perf_counter() - begun))
        return "ok", b.n, a.n, sorted(times)[len(times) // 2], len(rows), sum(r["cost"] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for batch in batches:
            keys, *rest = (c.to_pylist() for c in batch.columns)
            done = [one(x or "", y or "", lang) for x, y, lang in zip(*rest, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, fields[0].type), *(pa.array([d[k] for d in done], f.type) for k, f in enumerate(list(fields)[1:]))], schema=fields)

    return pairs.select("pair_id", "before", "after", "language").mapInArrow(run, schema)


# ---- questions about a mapping


def unit_cost(op, size):
    """0 for what stays or moves, 1 for a change, the size of the subtree for one that comes or goes whole."""
    return F.when(op.isin("Update", "Insert", "Delete"), 1).when(op.isin("InsertWithChildren", "DeleteWithChildren"), size).otherwise(0).cast("long")


def totals(mapping: DataFrame) -> DataFrame:
    """(pair_id, cost, nodes_before, nodes_after, and the number of rows of each operation)."""
    n = lambda op, name: F.count_if(F.col("op") == op).alias(name)
    return mapping.groupBy("pair_id").agg(
        F.sum("cost").cast("long").alias("cost"), F.count("b_pre").alias("nodes_before"), F.count("a_pre").alias("nodes_after"),
        n("Identical", "identical"), n("MatchButNotIdentical", "matched"), n("Update", "updated"), n("Insert", "inserted"), n("Delete", "deleted"),
    )


def violations(mapping: DataFrame) -> DataFrame:
    """(pair_id, problem, n): nodes that are mapped twice, and rows with no side. None, for a mapping that holds."""
    twice = lambda c: mapping.where(F.col(c).isNotNull()).groupBy("pair_id", c).count().where("count > 1").groupBy("pair_id").agg(F.count("*").alias("n")).select("pair_id", F.lit(f"{c} twice").alias("problem"), "n")
    none = mapping.where("b_pre is null and a_pre is null").groupBy("pair_id").agg(F.count("*").alias("n")).select("pair_id", F.lit("no side").alias("problem"), "n")
    return twice("b_pre").unionByName(twice("a_pre")).unionByName(none)


def reasons(mapping: DataFrame) -> DataFrame:
    """(reason, n): matched rows by reason, with the source where there is one."""
    return mapping.where("reason is not null").groupBy(F.concat_ws(":", "reason", "source").alias("reason")).agg(F.count("*").alias("n"))


def path_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair_id, b_path, a_path, side): rows that only one of two mappings has, by paths, so that both may come from parses of their own."""
    key = lambda m: m.select("pair_id", F.coalesce("b_path", F.lit("")).alias("b_path"), F.coalesce("a_path", F.lit("")).alias("a_path"))
    x, y = key(a), key(b)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def mismatches(mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """(pair_id, entries, mismatches) against entries (pair_id, operation, before_path, after_path) that people have made.

    A pair of paths must be mapped to each other; a path without another must be mapped to nothing, with children: it and
    all below it.
    """
    b = mapping.select("pair_id", F.col("b_path").alias("before_path"), F.col("a_path").alias("got_after"), F.col("op").alias("b_op")).where("before_path is not null")
    a = mapping.select("pair_id", F.col("a_path").alias("after_path"), F.col("b_path").alias("got_before")).where("after_path is not null")
    one_side = truth.where("before_path is null or after_path is null")
    two = truth.where("before_path is not null and after_path is not null").join(b, ["pair_id", "before_path"], "left")
    right = F.col("after_path").eqNullSafe(F.col("got_after")) & F.when(F.col("operation") == "identical", F.col("b_op") == "Identical").otherwise(True)
    scored = two.select("pair_id", right.alias("ok"))

    def gone(side: str, rows: DataFrame, other: str) -> DataFrame:
        mine = one_side.where(f"{side} is not null").withColumn("_whole", F.col("operation").endswith("with_children"))
        exact = mine.where("not _whole").join(rows, ["pair_id", side], "left").select("pair_id", F.col(other).isNull().alias("ok"))
        w = mine.where("_whole").select("pair_id", F.col(side).alias("_root"))
        # a node meets the entries at its own path and at those of its ancestors, which are the beginnings of its path
        parts = F.split(side, "/")
        up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        below = rows.select("pair_id", other, F.explode(up).alias("_root")).join(w, ["pair_id", "_root"])
        return exact.unionByName(below.groupBy("pair_id", "_root").agg(F.bool_and(F.col(other).isNull()).alias("ok")).select("pair_id", "ok"))

    every = scored.unionByName(gone("before_path", b, "got_after")).unionByName(gone("after_path", a, "got_before"))
    return every.groupBy("pair_id").agg(F.count("*").alias("entries"), F.count_if(~F.col("ok")).alias("mismatches"))
