"""Trees as nested sets: one row for each node, with what its subtree holds and four hashes of it.

pre is a node's place in document order, and the descendants of a node are those with pre in
[pre, pre + size), so that questions about subtrees and ancestors are ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.languages import ANCHORS, COMMENT_KINDS, COMMUTATIVE
from palimpsest.operators.parsers import PARSERS, Node, parse, parse_text
from palimpsest.session import spread

NODE_FIELDS = (
    "pre int, post int, parent_pre int, sib_idx int, depth int, size int, n_children int, kind string, path string, text string, own_text string, start int, end int, "
    "start_row int, start_col int, end_row int, end_col int, decl_name string, is_anchor boolean, in_comment boolean, widest_n int, widest_pre int, "
    "full_hash long, structural_hash long, kind_value_hash long, kind_only_hash long, ancestors array<int>"
)

#: Columns that are made only when they are named: the full hashes of a node's children, their sizes (null where all are leaves), and the runs of leaves of one kind among them.
MORE_FIELDS = "child_hashes array<long>, child_sizes array<int>, leaf_runs array<struct<kind:string,first:int,n:int>>"

#: Nodes of an Arrow batch: small units share one, as a batch of a few rows costs more than its rows.
BATCH_NODES = 4096
HASHES = ("full_hash", "structural_hash", "kind_value_hash", "kind_only_hash")


def _hash(*parts: object) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        raw = p if isinstance(p, bytes) else str(p).encode()
        h.update(len(raw).to_bytes(4, "big") + raw)
    return int.from_bytes(h.digest(), "big", signed=True)


class Tree:
    """A parsed text as arrays by pre."""

    def __init__(self, text: str, root: Node, language: str, hashed: bool | set[str] = True):
        """hashed: whether, or which of the four hashes (by column) are worked out."""
        self.text_all, self.language = text, language
        self.kind: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.sib: list[int] = []
        self.depth: list[int] = []
        self.children: list[list[int]] = []
        self.name: list[str | None] = []
        stack = [(root, -1, 0, 0)]
        while stack:
            n, parent, sib, depth = stack.pop()
            pre = len(self.kind)
            self.kind.append(n.kind)
            self.start.append(n.start)
            self.end.append(n.end)
            self.parent.append(parent)
            self.sib.append(sib)
            self.depth.append(depth)
            self.children.append([])
            self.name.append(n.name)
            if parent >= 0:
                self.children[parent].append(pre)
            stack += [(c, pre, i, depth + 1) for i, c in reversed(list(enumerate(n.children)))]
        n = self.n = len(self.kind)
        self.size = [1] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.size[p] += self.size[i]
        if hashed:
            self._hashes(set(HASHES) if hashed is True else hashed)

    @cached_property
    def widest(self) -> list[tuple[int, int]]:
        """Of each subtree the largest number of children and the node that has them; of equal widths the shallowest, then the first."""
        out = [(len(c), i) for i, c in enumerate(self.children)]
        for i in range(self.n - 1, 0, -1):
            p = self.parent[i]
            if (out[i][0], -self.depth[out[i][1]], -out[i][1]) > (out[p][0], -self.depth[out[p][1]], -out[p][1]):
                out[p] = out[i]
        return out

    @cached_property
    def post(self) -> list[int]:
        """As many end before a node as stand before it, less its ancestors, plus its descendants."""
        return [i - self.depth[i] + self.size[i] - 1 for i in range(self.n)]

    @cached_property
    def anchor(self) -> list[bool]:
        return [k in ANCHORS.get(self.language, ()) for k in self.kind]

    @cached_property
    def comment(self) -> list[bool]:
        return [k in COMMENT_KINDS for k in self.kind]

    def _hashes(self, wanted: set[str]) -> None:
        n = self.n
        self.full, self.structural, self.value, self.only = ([0] * n for _ in range(4))
        full, structural, value, only = (h in wanted for h in HASHES)
        loose = COMMUTATIVE.get(self.language, ())
        for i in range(n - 1, -1, -1):
            k, kids = self.kind[i], self.children[i]
            if full or value:
                gaps = self.gaps(i)
                parts: list[object] = [gaps[0]] if gaps[0].strip() else []
                inner: list[object] = list(parts)
                for g, c in zip(gaps[1:], kids, strict=True):
                    parts.append(self.full[c])
                    inner.append(self.value[c])
                    if g.strip():
                        parts.append(g)
                        inner.append(g)
            if full:
                self.full[i] = _hash(k, len(kids), *parts)
            if structural:
                self.structural[i] = _hash(k, len(kids), *(self.structural[c] for c in kids))
            if value:
                self.value[i] = _hash(k, len(kids), *(sorted(self.value[c] for c in kids) if k in loose else inner))
            if only:
                below = [self.only[c] for c in kids]
                self.only[i] = _hash(k, len(kids), *(sorted(below) if k in loose else below))

    def gaps(self, i: int) -> list[str]:
        """Text of a node before, between and after its children."""
        out, at = [], self.start[i]
        for c in self.children[i]:
            out.append(self.text_all[at : max(at, self.start[c])] if self.start[c] >= 0 else "")
            at = max(at, self.end[c])
        return [*out, self.text_all[at : max(at, self.end[i])] if at >= 0 else ""]

    def text(self, i: int) -> str:
        return self.text_all[self.start[i] : self.end[i]] if self.start[i] >= 0 else ""

    def ancestors(self, i: int) -> Iterator[int]:
        i = self.parent[i]
        while i >= 0:
            yield i
            i = self.parent[i]

    def subtree(self, i: int) -> range:
        return range(i, i + self.size[i])

    def leaf(self, i: int) -> bool:
        return not self.children[i]

    def paths(self) -> list[str]:
        """kind or kind[k] (k-th of its kind under its parent) from the root on, joined by slashes."""
        out = [""] * self.n
        for i in range(self.n):
            if i == 0:
                out[0] = self.kind[0]
            seen: dict[str, int] = {}
            for c in self.children[i]:
                k = self.kind[c]
                seen[k] = seen.get(k, -1) + 1
                out[c] = f"{out[i]}/{k}[{seen[k]}]"
        return out


class _Fed(dict):
    """Word -> what its hash adds to its line's: few words make most of a corpus, so each is hashed once."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = out = _fed(_hash("word", 0, word))
        return out


def _fed(part: object) -> bytes:
    raw = str(part).encode()
    return len(raw).to_bytes(4, "big") + raw


def _counts(first: np.ndarray, n: int) -> np.ndarray:
    """How many there are from each of some places to the next, the last place being n."""
    out = np.empty(len(first), np.int64)
    if len(first):
        out[:-1] = first[1:] - first[:-1]
        out[-1] = n - first[-1]
    return out


_FED = _Fed()
_DOCUMENT, _BLOCK, _LINE = map(_fed, ("document", "block", "line"))
#: Whether a character is white space; all beyond the last such are not.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


class TextTree(Tree):
    """The tree of parse_text(), document > block > line > word, worked out as an array for each level; lists of all nodes are made when they are asked for."""

    def __init__(self, text: str, language: str):
        self.text_all, self.language = text, language
        plain = text.isascii()
        code = np.frombuffer(text.encode() if plain else text.encode("utf-32-le", "surrogatepass"), np.uint8 if plain else np.uint32)
        blank = np.ones(len(code) + 2, bool)
        blank[1:-1] = _SPACE[code if plain else np.minimum(code, 0x3001)]
        turns = (blank[1:] != blank[:-1]).nonzero()[0]
        self.w_start, self.w_end = turns[::2], turns[1::2]
        ends = (code == 10).nonzero()[0]
        row = ends.searchsorted(self.w_start)  # of each word
        other = np.ones(len(row), bool)
        other[1:] = row[1:] != row[:-1]
        first = other.nonzero()[0]
        row = row[first]  # of each line with words
        self.l_first, self.l_n = first, _counts(first, len(self.w_start))
        self.l_start = np.concatenate(([0], ends + 1))[row]
        self.l_end = np.concatenate((ends, [len(code)]))[row]
        for i in (code[self.l_end - 1] == 13).nonzero()[0].tolist():
            self.l_end[i] = self.l_start[i] + len(text[self.l_start[i] : self.l_end[i]].rstrip("\r"))
        new = np.ones(len(row), bool)
        new[1:] = row[1:] - row[:-1] > 1
        self.b_first = new.nonzero()[0]
        self.b_n = _counts(self.b_first, len(row))
        self.l_block = new.cumsum() - 1
        self.l_pre = 2 + self.l_block + np.arange(len(row)) + first
        self.b_pre = self.l_pre[self.b_first] - 1
        self.n = 1 + len(self.b_pre) + len(row) + len(self.w_start)

    def _all(self, document: int, block: np.ndarray, line: np.ndarray, word: np.ndarray | int) -> list[int]:
        out = np.full(self.n, word) if isinstance(word, int) else np.empty(self.n, np.int64)
        if not isinstance(word, int):
            out[self._w_pre] = word
        out[0], out[self.b_pre], out[self.l_pre] = document, block, line
        return out.tolist()

    @cached_property
    def _w_pre(self) -> np.ndarray:
        return np.repeat(self.l_pre + 1 - self.l_first, self.l_n) + np.arange(len(self.w_start))

    @cached_property
    def _b_end(self) -> np.ndarray:
        return self.l_end[self.b_first + self.b_n - 1]

    @cached_property
    def _b_size(self) -> np.ndarray:
        return _counts(self.b_pre, self.n)

    @cached_property
    def _l_sib(self) -> np.ndarray:
        return np.arange(len(self.l_pre)) - self.b_first[self.l_block]

    @cached_property
    def kind(self) -> list[str]:
        out = ["word"] * self.n
        out[0] = "document"
        for places, kind in ((self.b_pre, "block"), (self.l_pre, "line")):
            for i in places.tolist():
                out[i] = kind
        return out

    @cached_property
    def start(self) -> list[int]:
        return self._all(0, self.l_start[self.b_first], self.l_start, self.w_start)

    @cached_property
    def end(self) -> list[int]:
        return self._all(len(self.text_all), self._b_end, self.l_end, self.w_end)

    @cached_property
    def parent(self) -> list[int]:
        return self._all(-1, 0, self.b_pre[self.l_block], np.repeat(self.l_pre, self.l_n))

    @cached_property
    def sib(self) -> list[int]:
        return self._all(0, np.arange(len(self.b_pre)), self._l_sib, np.arange(len(self.w_start)) - np.repeat(self.l_first, self.l_n))

    @cached_property
    def depth(self) -> list[int]:
        return self._all(0, 1, 2, 3)

    @cached_property
    def size(self) -> list[int]:
        return self._all(self.n, self._b_size, self.l_n + 1, 1)

    @cached_property
    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.n)]
        out[0] = self.b_pre.tolist()
        lines, firsts = self.l_pre.tolist(), self.b_first.tolist()
        for i, f, k in zip(out[0], firsts, self.b_n.tolist(), strict=True):
            out[i] = lines[f : f + k]
        for i, k in zip(lines, self.l_n.tolist(), strict=True):
            out[i] = list(range(i + 1, i + 1 + k))
        return out

    @cached_property
    def name(self) -> list[str | None]:
        return [None] * self.n

    @cached_property
    def full(self) -> list[int]:
        document, blocks, lines = Outline(self.text_all).hashes
        words = np.array([int(_FED[x][4:]) for x in self.text_all.split()], np.int64)
        return self._all(document, blocks, lines, words)

    @cached_property
    def structural(self) -> list[int]:
        return self._other("structural_hash")

    @cached_property
    def value(self) -> list[int]:
        return self._other("kind_value_hash")

    @cached_property
    def only(self) -> list[int]:
        return self._other("kind_only_hash")

    def _other(self, name: str) -> list[int]:
        other = Tree(self.text_all, parse_text(self.text_all), self.language, {name})
        return {"structural_hash": other.structural, "kind_value_hash": other.value, "kind_only_hash": other.only}[name]


class Outline:
    """The same tree without its words as nodes: lines with their words."""

    def __init__(self, text: str):
        self.length = len(text)
        self.words: list[list[str]] = []
        self.l_start: list[int] = []
        self.l_end: list[int] = []
        self.l_pre: list[int] = []
        self.l_block: list[int] = []
        self.b_first: list[int] = []
        self.b_pre: list[int] = []
        at, pre, inside = 0, 1, False
        for line in text.split("\n"):
            words = line.split()
            if words:
                if not inside:
                    self.b_first.append(len(self.words))
                    self.b_pre.append(pre)
                    pre += 1
                self.words.append(words)
                self.l_start.append(at)
                self.l_end.append(at + len(line.rstrip("\r")))
                self.l_pre.append(pre)
                self.l_block.append(len(self.b_pre) - 1)
                pre += 1 + len(words)
            inside = bool(words)
            at += len(line) + 1
        self.n = pre

    def _of(self, lines: list) -> list[list]:
        """What lines have, by block."""
        return [lines[f:t] for f, t in zip(self.b_first, [*self.b_first[1:], len(lines)], strict=False)]

    @cached_property
    def hashes(self) -> tuple[int, list[int], list[int]]:
        """Full hashes of the document, its blocks and its lines, from those of words that were met before."""
        of = lambda kind, n, fed: int.from_bytes(hashlib.blake2b(kind + _fed(n) + fed, digest_size=8).digest(), "big", signed=True)
        lines = [of(_LINE, len(w), b"".join([_FED[x] for x in w])) for w in self.words]
        blocks = [of(_BLOCK, len(x), b"".join(map(_fed, x))) for x in self._of(lines)]
        return of(_DOCUMENT, len(blocks), b"".join(map(_fed, blocks))), blocks, lines

    def columns(self) -> dict[str, Callable[[], list]]:
        """How to make columns of the nodes that are no words, in document order."""

        def ordered(document: object, blocks: list, lines: list) -> list:
            out = [document]
            for b, of in zip(blocks, self._of(lines), strict=True):
                out.append(b)
                out += of
            return out

        nb, nl = len(self.b_pre), len(self.words)
        counts = [len(w) for w in self.words]
        sizes = [t - f for f, t in zip(self.b_pre, [*self.b_pre[1:], self.n], strict=False)]
        sibs = lambda: [i - self.b_first[b] for i, b in enumerate(self.l_block)]
        path = lambda: ordered("document", [f"document/block[{i}]" for i in range(nb)], [f"document/block[{b}]/line[{k}]" for b, k in zip(self.l_block, sibs(), strict=True)])
        child_hashes = lambda: ordered(self.hashes[1], self._of(self.hashes[2]), [[int(_FED[x][4:]) for x in w] for w in self.words])
        return {
            "pre": lambda: ordered(0, self.b_pre, self.l_pre), "parent_pre": lambda: ordered(None, [0] * nb, [self.b_pre[b] for b in self.l_block]), "sib_idx": lambda: ordered(0, list(range(nb)), sibs()),
            "depth": lambda: ordered(0, [1] * nb, [2] * nl), "size": lambda: ordered(self.n, sizes, [c + 1 for c in counts]), "n_children": lambda: ordered(nb, list(map(len, self._of(counts))), counts),
            "kind": lambda: ordered("document", ["block"] * nb, ["line"] * nl), "path": path, "start": lambda: ordered(0, [self.l_start[f] for f in self.b_first], self.l_start),
            "end": lambda: ordered(self.length, [x[-1] for x in self._of(self.l_end)], self.l_end), "full_hash": lambda: ordered(*self.hashes), "ancestors": lambda: ordered([], [[0]] * nb, [[0, self.b_pre[b]] for b in self.l_block]),
            "child_hashes": child_hashes, "child_sizes": lambda: ordered(sizes or None, self._of([c + 1 for c in counts]), [None] * nl), "leaf_runs": lambda: ordered([], [[]] * nb, [[("word", 0, c)] for c in counts]),
        }


#: What the outline has columns of.
OUTLINED = Outline("").columns().keys()


def build(text: str, language: str | None, hashed: bool | set[str] = True) -> Tree | None:
    if language and PARSERS.get(language) is parse_text:
        return TextTree(text, language)
    root = parse(text, language)
    return Tree(text, root, language, hashed) if root else None


def identical_places(before: str, after: str, language: str | None) -> Iterator[tuple[int, int]]:
    """Places of equal nodes that have the same path on both sides."""
    if PARSERS.get(language or "") is parse_text:
        b, a = Outline(before), Outline(after)
        (b_all, b_blocks, b_lines), (a_all, a_blocks, a_lines) = b.hashes, a.hashes
        if b_all == a_all:
            yield 0, 0
        yield from ((i, j) for i, j, x, y in zip(b.b_pre, a.b_pre, b_blocks, a_blocks, strict=False) if x == y)
        for own, other in zip(b._of(list(zip(b.l_pre, b_lines, b.words, strict=True))), a._of(list(zip(a.l_pre, a_lines, a.words, strict=True))), strict=False):
            for (i, x, ours), (j, y, theirs) in zip(own, other, strict=False):
                if x == y:
                    yield i, j
                yield from ((i + k, j + k) for k, (v, w) in enumerate(zip(ours, theirs, strict=False), 1) if v == w)
        return
    x, y = build(before, language, {"full_hash"}), build(after, language, {"full_hash"})
    if x and y:
        there = {p: j for j, p in enumerate(y.paths())}
        yield from ((i, there[p]) for i, p in enumerate(x.paths()) if p in there and x.full[i] == y.full[there[p]])


def positions(text: str, places: list[int]) -> list[tuple[int, int]]:
    """(row, column) of places in a text, columns in characters."""
    from bisect import bisect_right

    starts = [0]
    while (i := text.find("\n", starts[-1])) >= 0:
        starts.append(i + 1)
    return [(r, p - starts[r]) for p in places for r in [bisect_right(starts, max(p, 0)) - 1]]


def _columns(tree: Tree) -> dict:
    """How to make each node column of a tree."""
    start = lambda k: [p[k] for p in positions(tree.text_all, tree.start)]
    end = lambda k: [p[k] for p in positions(tree.text_all, tree.end)]

    def in_comment() -> list[bool]:
        out = list(tree.comment)
        for i in range(1, tree.n):
            out[i] = out[i] or out[tree.parent[i]]
        return out

    def ancestors() -> list[list[int]]:
        out: list[list[int]] = [[]]
        for i in range(1, tree.n):
            out.append([*out[tree.parent[i]], tree.parent[i]])
        return out

    def leaf_runs() -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = []
        for kids in tree.children:
            runs: list[tuple[str, int, int]] = []
            seen: dict[str, int] = {}
            for c in kids:
                k = tree.kind[c]
                at = seen[k] = seen.get(k, -1) + 1
                if tree.leaf(c):
                    if runs and runs[-1][0] == k and runs[-1][1] + runs[-1][2] == at:
                        runs[-1] = (k, runs[-1][1], runs[-1][2] + 1)
                    else:
                        runs.append((k, at, 1))
            out.append(runs)
        return out

    return {
        "child_hashes": lambda: [[tree.full[c] for c in kids] for kids in tree.children], "leaf_runs": leaf_runs,
        "child_sizes": lambda: [[tree.size[c] for c in kids] if tree.size[i] > len(kids) + 1 else None for i, kids in enumerate(tree.children)],
        "pre": lambda: range(tree.n), "post": lambda: tree.post, "parent_pre": lambda: [None if p < 0 else p for p in tree.parent], "sib_idx": lambda: tree.sib, "depth": lambda: tree.depth, "size": lambda: tree.size,
        "n_children": lambda: [len(c) for c in tree.children], "kind": lambda: tree.kind, "path": tree.paths, "text": lambda: [tree.text(i) if tree.leaf(i) else None for i in range(tree.n)],
        "own_text": lambda: ["".join(tree.gaps(i)) for i in range(tree.n)], "start": lambda: tree.start, "end": lambda: tree.end, "start_row": lambda: start(0), "start_col": lambda: start(1), "end_row": lambda: end(0), "end_col": lambda: end(1),
        "decl_name": lambda: tree.name, "is_anchor": lambda: tree.anchor, "in_comment": in_comment, "widest_n": lambda: [w[0] for w in tree.widest], "widest_pre": lambda: [w[1] for w in tree.widest],
        "full_hash": lambda: tree.full, "structural_hash": lambda: tree.structural, "kind_value_hash": lambda: tree.value, "kind_only_hash": lambda: tree.only, "ancestors": ancestors,
    }


def flatten(units: DataFrame, unit_id: str, contents: str, language: str, columns: list[str] | None = None, least: int = 1) -> DataFrame:
    """(unit_id, node columns) of each node of each unit with a tree; only the named columns are worked out (all of NODE_FIELDS, if none are named).

    Of subtrees of fewer than `least` nodes there are no rows; where leaves are not asked for, those of plain texts (words, nearly all of the nodes) are never made.
    Units are independent, so nothing is shuffled.
    """
    known = T.StructType.fromDDL(f"{NODE_FIELDS}, {MORE_FIELDS}")
    wanted = T.StructType.fromDDL(NODE_FIELDS).names if columns is None else columns
    schema = T.StructType([T.StructField("unit_id", units.schema[unit_id].dataType), *(known[c] for c in wanted)])
    outlined = least > 1 and OUTLINED >= set(wanted)
    hashed = set(HASHES) & set(wanted) | ({"full_hash"} if "child_hashes" in wanted else set())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)

        def batch(columns: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        held: list[list] = [[] for _ in fields]
        for b in batches:
            for unit, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if outlined and PARSERS.get(lang) is parse_text:
                    make = Outline(text or "").columns()
                else:
                    tree = build(text or "", lang, hashed)
                    if tree is None:
                        continue
                    make = _columns(tree)
                made = [make[c]() for c in wanted]
                if least > 1:
                    keep = [i for i, n in enumerate(make["size"]()) if n >= least]
                    made = [[c[i] for i in keep] for c in made]
                for column, more in zip(held, [[unit] * (len(keep) if least > 1 else tree.n), *made], strict=True):
                    column.extend(more)
                if len(held[0]) >= BATCH_NODES:
                    yield batch(held)
                    held = [[] for _ in fields]
        if held[0]:
            yield batch(held)

    return spread(units.select(unit_id, contents, language)).mapInArrow(run, schema)


# ---- questions about node rows


def kind_counts(nodes: DataFrame) -> DataFrame:
    """(kind, size_bucket, n): nodes by kind and order of magnitude (base 2) of their subtrees."""
    return nodes.groupBy("kind", (F.length(F.bin("size")) - 1).alias("size_bucket")).agg(F.count("*").alias("n"))


def anchors(nodes: DataFrame, min_size: int = 45) -> DataFrame:
    """Nodes that matching starts from: anchors by kind, and large ones; largest first, then by place."""
    return nodes.where(F.col("is_anchor") | (F.col("size") >= min_size)).orderBy("unit_id", F.desc("size"), "start", "pre")


def with_ancestors(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(unit_id, pre, a_<column>...) of each node and each of its ancestors: one equi-join on (unit, ancestor), as many rows as nodes are deep.

    nodes need their `ancestors`.
    """
    a = nodes.select("unit_id", F.col("pre").alias("_up"), *(F.col(c).alias(f"a_{c}") for c in columns))
    return nodes.select("unit_id", "pre", F.explode("ancestors").alias("_up")).join(a, ["unit_id", "_up"]).drop("_up")


def enclosing(points: DataFrame, nodes: DataFrame, row: str = "row") -> DataFrame:
    """points (unit_id, row) with the start row and name of the innermost named declaration around, null if none."""
    decl = nodes.where("decl_name is not null").select("unit_id", F.col("start_row").alias("_s"), F.col("end_row").alias("_e"), F.col("depth").alias("_d"), F.col("decl_name").alias("_n"))
    met = points.join(decl, (points.unit_id == decl.unit_id) & (decl._s <= points[row]) & (points[row] <= decl._e), "left").select(points["*"], "_s", "_d", "_n")
    return met.groupBy(*points.columns).agg(F.max_by(F.struct(F.col("_s").alias("row"), F.col("_n").alias("name")), F.struct("_d", "_s")).alias("_x")).select(
        *points.columns, F.col("_x.row").alias("declared_row"), F.col("_x.name").alias("declared_name")
    )


def repeated_subtrees(nodes: DataFrame, hash_: str = "full_hash", min_size: int = 4) -> DataFrame:
    """(hash, size, copies, units) of subtrees that occur more than once."""
    return (
        nodes.where(F.col("size") >= min_size).groupBy(F.col(hash_).alias("hash"), "size")
        .agg(F.count("*").alias("copies"), F.countDistinct("unit_id").alias("units")).where("copies > 1")
    )


def unique_hash_matches(before: DataFrame, after: DataFrame, key: list[str], hash_: str = "full_hash", min_size: int = 4) -> DataFrame:
    """(key..., before_pre, after_pre): subtrees whose hash stands once on each side match, without their inner nodes."""

    def once(nodes: DataFrame, name: str) -> DataFrame:
        g = nodes.where(F.col("size") >= min_size).groupBy(*key, hash_)
        return g.agg(F.count("*").alias("n"), F.first("pre").alias(name), F.first("size").alias("size"), F.first("parent_pre").alias(f"{name}_parent")).where("n = 1").drop("n")

    met = once(before, "before_pre").join(once(after, "after_pre").drop("size"), [*key, hash_])
    inner = met.select(*key, F.col("before_pre").alias("before_pre_parent"), F.col("after_pre").alias("after_pre_parent"))
    return met.join(inner, [*key, "before_pre_parent", "after_pre_parent"], "left_anti").select(*key, "before_pre", "after_pre", "size")


def named_matches(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key..., kind, decl_name, before_pre, after_pre): declarations whose kind and name stand once on each side."""

    def once(nodes: DataFrame, name: str) -> DataFrame:
        return nodes.where("decl_name is not null").groupBy(*key, "kind", "decl_name").agg(F.count("*").alias("n"), F.min("pre").alias(name)).where("n = 1").drop("n")

    return once(before, "before_pre").join(once(after, "after_pre"), [*key, "kind", "decl_name"])


def previous_sibling(nodes: DataFrame) -> DataFrame:
    """nodes with the pre, kind and full hash of the sibling before each."""
    w = Window.partitionBy("unit_id", "parent_pre").orderBy("sib_idx")
    return nodes.withColumn("previous", F.lag(F.struct("pre", "kind", "full_hash")).over(w))


def first_of_kind(nodes: DataFrame) -> DataFrame:
    """(unit_id, kind, pre) of the first node of each kind, in document order."""
    return nodes.groupBy("unit_id", "kind").agg(F.min("pre").alias("pre"))


def last_segment(path: Column) -> tuple[Column, Column]:
    """(kind, number) of a path's last part; a part without a number is the first of its kind."""
    part = F.element_at(F.split(path, "/"), -1)
    number = F.regexp_extract(part, r"\[(\d+)\]$", 1)
    return F.regexp_replace(part, r"\[\d+\]$", ""), F.when(number == "", 0).otherwise(number.cast("int"))


def in_any(keys: DataFrame, before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """keys with the node of the before side, else that of the after side (a struct of all node columns; null if neither has it)."""
    side = lambda nodes, name: nodes.select(*by, F.struct(*nodes.columns).alias(name))
    met = keys.join(side(before, "_b"), by, "left").join(side(after, "_a"), by, "left")
    return met.select(*keys.columns, F.coalesce("_b", "_a").alias("node"))


def named_groups(nodes: DataFrame, without_root: bool = False) -> DataFrame:
    """(unit_id, kind, decl_name, pres): declarations by kind and name in document order, on request without roots."""
    rows = nodes.where("decl_name is not null" + (" and pre > 0" if without_root else ""))
    return rows.groupBy("unit_id", "kind", "decl_name").agg(F.array_sort(F.collect_list("pre")).alias("pres"))
