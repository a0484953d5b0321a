"""Hard-negative mining by dual-tree search.

Rows are quantised vectors with labels. An anchor's positives are the rows of its own label that score highest; the hard negatives of an anchor and a positive are the
rows of other labels that score highest among those between two shares of the positive's score. Both are one search: for each query the k best candidates
whose label is the same, or another, and whose score lies between a least and a greatest one.

Both sides are trees. At the top, rows are dealt by range of label, cell (of a tree of medians over a bounded sample, as a column expression) and row number, so that a
slot holds rows that lie near each other, and a label, cell or vector with many rows fills several slots. A slot holds blocks, and each block a tree of balls
over its rows. The inner products of two nodes lie in an interval, known from their centres and radii. A node pair is left, and with it the whole group of
anchors, if the interval, the labels, or the ids where scores tie, cannot give any anchor of the group a better result than it has; pairs of leaves are scored exactly. The same
test, on the ball around a slot, keeps a block of anchors from being sent to slots that cannot help it. What an anchor finds in the sample is where its search begins.

The driver sees the sample (SAMPLE rows) and one ball for each slot; these, of that size, go to the tasks. No task sees more than two blocks at a time.

Defined results: a row takes part if its id and label are not null and its vector is neither null nor holds null or a non-finite component. Rows of an anchor's own id are no
candidates for it. Equal rows are one anchor but candidates each for itself; rows that share an id and differ are anchors of their own. Of equal scores the smaller id goes first.
Vectors of unequal length score over the dimensions they share; an empty one scores 0. A score that does not fit a long stops the search with an error.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, partitions
from palimpsest.llm.topk import quantised

CANDIDATES = 4096
QUERIES = 1024
LEAF = 64
SAMPLE = 2048
DEPTH = 6
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1
#: What a block is made of: its rows in the order of its tree, and the tree's nodes from the root down, left before right.
LONGS = ("ids", "labels", "marks", "places", "lowest", "highest")
BLOCK = ", ".join(f"{c} binary" for c in (*LONGS, "vectors", "centres", "radii", "least_ids", "low_labels", "high_labels")) + ", width int, rows int"


@functools.lru_cache(maxsize=64)
def halves(rows: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first row, row after the last, left child, right child) of each node of a tree over rows, halved until they are a leaf; children of leaves are -1."""
    nodes: list[list[int]] = []

    def add(lo: int, hi: int) -> int:
        i = len(nodes)
        nodes.append([lo, hi, -1, -1])
        if hi - lo > leaf:
            mid = (lo + hi) // 2
            nodes[i][2] = add(lo, mid)
            nodes[i][3] = add(mid, hi)
        return i

    add(0, rows)
    return tuple(np.array(nodes).T)


def arranged(m: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The rows in the order of a tree: each node halved at the median of its widest dimension, equal rows by id."""
    order = np.argsort(ids, kind="stable")
    for lo, hi, left, _ in zip(*halves(len(ids)), strict=True):
        if left >= 0 and m.shape[1]:
            part = m[order[lo:hi]]
            widest = int(np.argmax(part.max(0).astype(float) - part.min(0)))
            order[lo:hi] = order[lo:hi][np.argsort(part[:, widest], kind="stable")]
    return order


def balls(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius of each node over rows in the order of the tree."""
    starts, stops, _, _ = halves(len(m))
    f = m.astype(float)
    centres = np.array([f[lo:hi].mean(0) for lo, hi in zip(starts, stops, strict=True)])
    radii = np.array([np.sqrt(((f[lo:hi] - c) ** 2).sum(1).max()) for lo, hi, c in zip(starts, stops, centres, strict=True)])
    return centres, radii


def intervals(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) whole number that the inner product of any two rows of two balls can be, for each pair of balls."""
    na, nb = np.sqrt((ca**2).sum(1)), np.sqrt((cb**2).sum(1))
    middle = ca @ cb.T
    reach = np.outer(na, rb) + np.outer(ra, nb) + np.outer(ra, rb)
    slack = 1e-9 * np.outer(na + ra, nb + rb) + 1e-9  # of rounding, by far
    return np.ceil(middle - reach - slack), np.floor(middle + reach + slack)


def scored(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two matrices of integers, in longs; those of pairs that count must fit one."""
    size = lambda m: max(int(m.max()), -int(m.min())) if m.size else 0
    bound = size(a) * size(b) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    s = np.where(counts, a.astype(object) @ b.astype(object).T, LEAST)
    if any(not LEAST <= x <= MOST for x in s.flat):
        raise OverflowError("a score does not fit a long")
    return s.astype(np.int64)


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Block:
    """Rows in the order of their tree, and the tree."""

    def __init__(self, r: dict) -> None:
        self.rows, self.width = r["rows"], r["width"]
        for c in LONGS:
            setattr(self, c, np.frombuffer(r[c], np.int64))
        kind = np.int64 if len(r["vectors"]) == 8 * self.rows * self.width else np.int32
        self.vectors = np.frombuffer(r["vectors"], kind).reshape(self.rows, self.width).astype(np.int64)
        self.centres = np.frombuffer(r["centres"], float).reshape(-1, self.width)
        self.radii = np.frombuffer(r["radii"], float)
        self.least_ids, self.low_labels, self.high_labels = (np.frombuffer(r[c], np.int64) for c in ("least_ids", "low_labels", "high_labels"))
        self.starts, self.stops, self.left, self.right = halves(self.rows)


def packed(columns: dict[str, np.ndarray], vectors: list[np.ndarray]) -> dict:
    """A block as a row of bytes."""
    width, n = max(map(len, vectors)), len(vectors)
    m = np.zeros((n, width), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    order = arranged(m, columns["ids"])
    m, columns = m[order], {c: x[order] for c, x in columns.items()}
    centres, radii = balls(m)
    starts, stops, _, _ = halves(n)
    spans = list(zip(starts, stops, strict=True))
    small = not m.size or (m.max() < 1 << 31 and m.min() >= -(1 << 31))
    of = lambda f, c: np.array([f(columns[c][lo:hi]) for lo, hi in spans], np.int64).tobytes()
    return {c: columns[c].tobytes() for c in LONGS} | {
        "vectors": (m.astype(np.int32) if small else m).tobytes(), "centres": centres.tobytes(), "radii": radii.tobytes(),
        "least_ids": of(np.min, "ids"), "low_labels": of(np.min, "labels"), "high_labels": of(np.max, "labels"), "width": width, "rows": n,
    }


def ball_around(centres: list[np.ndarray], radii: list[float]) -> tuple[np.ndarray, float]:
    """A ball that holds all of the given ones."""
    width = max(map(len, centres))
    c = np.array([np.pad(x, (0, width - len(x))) for x in centres])
    middle = c.mean(0)
    return middle, float((np.sqrt(((c - middle) ** 2).sum(1)) + radii).max() * (1 + 1e-9))


def fits(labels: np.ndarray, others: np.ndarray, same: bool) -> np.ndarray:
    return (labels[:, None] == others[None, :]) == same


class Sample:
    """Candidates that every task knows: where a search begins, and where cells part."""

    def __init__(self, rows: list) -> None:
        width = max((len(r.terms) for r in rows), default=0)
        self.vectors = np.array([list(r.terms) + [0] * (width - len(r.terms)) for r in rows], np.int64).reshape(len(rows), width)
        self.ids, self.labels = (np.array([r[c] for r in rows], np.int64) for c in ("id", "label"))

    def cell(self, terms: Column) -> Column:
        """The cell of a vector, by medians of the widest dimensions."""

        def parted(m: np.ndarray, depth: int, number: int) -> Column:
            spread = m.max(0).astype(float) - m.min(0) if m.size else np.zeros(1)
            d = int(np.argmax(spread))
            if not depth or not spread[d]:
                return F.lit(number)
            at = np.sort(m[:, d])[len(m) // 2]
            at = at if (m[:, d] < at).any() else m[m[:, d] > at, d].min()
            below = m[:, d] < at
            return F.when(F.coalesce(F.get(terms, F.lit(d)), F.lit(0)) < int(at), parted(m[below], depth - 1, 2 * number)).otherwise(parted(m[~below], depth - 1, 2 * number + 1))

        return parted(self.vectors, DEPTH, 1)

    def raised(self, lowest: np.ndarray, columns: dict, vectors: list[np.ndarray], same: bool, k: int) -> np.ndarray:
        """The least score that each query may still want, given what the sample holds for it."""
        if len(self.ids) < k:
            return lowest
        width = max(self.vectors.shape[1], *map(len, vectors))
        m = np.zeros((len(vectors), width), np.int64)
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        ok = fits(columns["labels"], self.labels, same) & (columns["ids"][:, None] != self.ids)
        s = scored(m, widened(self.vectors, width), ok)
        ok &= (s >= lowest[:, None]) & (s <= columns["highest"][:, None])
        s = np.where(ok, s, LEAST)
        return np.maximum(lowest, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])


class Slots:
    """The ball, labels and number of each slot of candidates."""

    def __init__(self, rows: list) -> None:
        width = max((r.width for r in rows), default=0)
        ball = [np.frombuffer(r.centres, float) for r in rows]
        self.numbers = [r.slot for r in rows]
        self.centres = np.array([np.pad(c, (0, width - len(c))) for c in ball]).reshape(len(rows), width)
        self.radii = np.array([np.frombuffer(r.radii, float)[0] for r in rows])
        self.low, self.high = (np.array([np.frombuffer(r[c], np.int64)[0] for r in rows], np.int64) for c in ("low_labels", "high_labels"))

    def wanted(self, block: dict, same: bool) -> list[int]:
        """Slots that may hold a result for a block of queries."""
        b = Block(block)
        width = max(b.width, self.centres.shape[1])
        least, greatest = intervals(widened(b.centres[:1], width), b.radii[:1], widened(self.centres, width), self.radii)
        ok = (greatest[0] >= b.lowest.min()) | (b.lowest.min() == LEAST)
        ok &= (least[0] <= b.highest.max()) | (b.highest.max() == MOST)
        low, high = b.low_labels[0], b.high_labels[0]
        ok &= (self.low <= high) & (low <= self.high) if same else ~((low == high) & (self.low == self.high) & (self.low == low))
        return [s for s, yes in zip(self.numbers, ok, strict=True) if yes]


def _pack(most: int, sample: Sample | None = None, slots: Slots | None = None, same: bool = True, k: int = 0):
    """Packs rows of (LONGS, terms) into blocks; of candidates, one more row, with no rows in it, has the ball around them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in LONGS]
        vectors: list[np.ndarray] = []
        around: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = {c: np.array(x, np.int64) for c, x in zip(LONGS, held, strict=True)}
            if sample is not None:
                columns["lowest"] = sample.raised(columns["lowest"], columns, vectors, same, k)
            block = packed(columns, vectors)
            if slots is not None:
                block["slots"] = slots.wanted(block, same)
            else:
                b = Block(block)
                around.append((b.centres[0], b.radii[0], b.low_labels[0], b.high_labels[0]))
            for x in (*held, vectors):
                x.clear()
            return pa.RecordBatch.from_pylist([block], _arrow(slots is not None))

        for b in batches:
            lists = b.column(len(LONGS))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for row, lo, hi in zip(zip(*(b.column(i).to_pylist() for i in range(len(LONGS))), strict=True), ends[:-1], ends[1:], strict=True):
                for x, v in zip(held, row, strict=True):
                    x.append(v)
                vectors.append(flat[lo:hi])
                if len(vectors) >= most:
                    yield made()
        if vectors:
            yield made()
        if slots is None and around:
            centre, radius = ball_around([a[0] for a in around], np.array([a[1] for a in around]))
            labels = {"low_labels": min(a[2] for a in around), "high_labels": max(a[3] for a in around)}
            none = dict.fromkeys((*LONGS, "vectors", "least_ids"), b"") | {"width": len(centre), "rows": 0, "centres": centre.tobytes(), "radii": np.array([radius]).tobytes()}
            yield pa.RecordBatch.from_pylist([none | {c: np.array([x], np.int64).tobytes() for c, x in labels.items()}], _arrow(False))

    return run


def _arrow(with_slots: bool) -> pa.Schema:
    kinds = {"binary": pa.binary(), "int": pa.int32()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in BLOCK.split(", "))]
    return pa.schema(fields + [("slots", pa.list_(pa.int32()))] * with_slots)


def search(a: Block, c: Block, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best candidates of a block for each query of another, best first; LEAST where there are fewer."""
    width = max(a.width, c.width)
    va, vc = widened(a.vectors, width), widened(c.vectors, width)
    least, greatest = intervals(widened(a.centres, width), a.radii, widened(c.centres, width), c.radii)
    scores, ids = np.full((a.rows, k), LEAST, np.int64), np.full((a.rows, k), MOST, np.int64)
    need, last = a.lowest.copy(), np.full(a.rows, MOST, np.int64)
    high = np.array([a.highest[lo:hi].max() for lo, hi in zip(a.starts, a.stops, strict=True)])

    def hopeless(x: int, y: int) -> bool:
        low, top = (a.low_labels[x], a.high_labels[x]), (c.low_labels[y], c.high_labels[y])
        if (low[0] > top[1] or top[0] > low[1]) if same else low[0] == low[1] == top[0] == top[1]:
            return True
        if least[x, y] > high[x] and high[x] < MOST:
            return True
        at, most = slice(a.starts[x], a.stops[x]), greatest[x, y]
        return bool((((most < need[at]) & (need[at] > LEAST)) | ((most == need[at]) & (c.least_ids[y] > last[at]))).all())

    def leaves(x: int, y: int) -> None:
        at, to = slice(a.starts[x], a.stops[x]), slice(c.starts[y], c.stops[y])
        ok = fits(a.labels[at], c.labels[to], same) & (a.ids[at][:, None] != c.ids[to])
        s = scored(va[at], vc[to], ok)
        ok &= (s >= need[at][:, None]) & (s <= a.highest[at][:, None])
        rows = np.flatnonzero(ok.any(1))
        if len(rows):
            ok, own = ok[rows], rows + a.starts[x]
            all_scores = np.concatenate([scores[own], np.where(ok, s[rows], LEAST)], axis=1)
            all_ids = np.concatenate([ids[own], np.where(ok, c.ids[to], MOST)], axis=1)
            best = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
            scores[own], ids[own] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
            need[own] = np.maximum(need[own], scores[own, -1])
            last[own] = np.where(scores[own, -1] > LEAST, ids[own, -1], MOST)

    first = lambda x, y: (-min(greatest[x, y], float(high[x])), int(c.least_ids[y]), x, y)
    heap = [first(0, 0)]
    while heap:
        _, _, x, y = heapq.heappop(heap)
        if hopeless(x, y):
            continue
        if a.left[x] < 0 and c.left[y] < 0:
            leaves(x, y)
        elif c.left[y] < 0 or (a.left[x] >= 0 and a.radii[x] > c.radii[y]):
            for z in (int(a.left[x]), int(a.right[x])):
                heapq.heappush(heap, first(z, y))
        else:
            for z in (int(c.left[y]), int(c.right[y])):
                heapq.heappush(heap, first(x, z))
    return scores, ids


FOUND = "id long, label long, mark long, place long, vec_id long, score long"


def _met(same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = Block({c[2:]: v for c, v in r.items() if c.startswith("q_")})
                c = Block({c: v for c, v in r.items() if not c.startswith("q_")})
                scores, ids = search(a, c, same, k)
                rows, at = np.nonzero(scores > LEAST)
                columns = [a.ids[rows], a.labels[rows], a.marks[rows], a.places[rows], ids[rows, at], scores[rows, at]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def _long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


class Candidates:
    """Candidates (id, label, terms) as blocks in slots, stored in the shared folder, and what all tasks know of them."""

    def __init__(self, rows: DataFrame, slots: int | None = None) -> None:
        spark = rows.sparkSession
        self.slots = slots or partitions(spark)
        self.sample = Sample(rows.orderBy(F.xxhash64("id", "terms", "label"), "id").limit(SAMPLE).collect())
        plain = rows.select("id", "label", "terms", F.lit(0).alias("mark"), F.lit(0).alias("place"), F.lit(LEAST).alias("lowest"), F.lit(MOST).alias("highest"))
        blocks = self.dealt(plain, self.slots).mapInArrow(_pack(CANDIDATES), BLOCK).withColumn("slot", F.spark_partition_id())
        stored = cut(blocks)
        self.blocks = stored.where("rows > 0")
        self.balls = Slots(stored.where("rows = 0").collect())

    def dealt(self, rows: DataFrame, parts: int) -> DataFrame:
        by = ["label", "_cell", "_row"]
        near = rows.withColumn("_cell", self.sample.cell(F.col("terms"))).withColumn("_row", F.monotonically_increasing_id())
        longs = zip(("id", "label", "mark", "place", "lowest", "highest"), LONGS, strict=True)
        return near.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*(_long(F.col(c), n) for c, n in longs), F.col("terms").cast("array<long>").alias("terms"))

    def best(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, label, mark, place, rank, vec_id, score) of the k best candidates for each of queries (id, label, mark, place, lowest, highest, terms)."""
        asked = self.dealt(queries, max(1, self.slots // 4)).mapInArrow(_pack(QUERIES, self.sample, self.balls, same, k), f"{BLOCK}, slots array<int>")
        names = [f.split()[0] for f in BLOCK.split(", ")]
        left = asked.select(*(F.col(c).alias(f"q_{c}") for c in names), F.explode("slots").alias("slot"))
        # dealt by number: a slot's searches stay in a task of their own
        met = left.repartition(self.slots, "slot").join(self.blocks.repartition(self.slots, "slot"), "slot").drop("slot").mapInArrow(_met(same, k), FOUND)
        ranked = Window.partitionBy("id", "label", "mark", "place").orderBy(F.desc("score"), F.asc("vec_id"))
        return met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("id", "label", "mark", "place", "rank", "vec_id", "score")


def hard_negatives(
    df: DataFrame, vec_id: str, embedding: str, label: Column, anchor: Column, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), slots: int | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of df for which the column `anchor` holds.

    The negatives of a positive score between band[0] and band[1] hundredths of its score.
    """
    rows = cut(quantised(df, vec_id, embedding, 256, label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where("label is not null"))
    candidates = Candidates(rows.drop("anchor"), slots)
    keys = ["id", "label", "mark"]
    anchors = rows.where("anchor").select("id", "label", "terms").distinct().withColumn("mark", F.xxhash64("terms"))
    asked = anchors.select("*", F.lit(0).alias("place"), F.lit(LEAST).alias("lowest"), F.lit(MOST).alias("highest"))
    near = cut(candidates.best(asked, True, positives).select(*keys, F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(24,0)")
    lowest, highest = F.ceil(score * band[0] / 100).cast("long"), F.floor(score * band[1] / 100).cast("long")
    bands = near.select(*keys, "place", lowest.alias("lowest"), highest.alias("highest")).where("lowest <= highest")
    found = candidates.best(bands.join(anchors, keys), False, negatives)
    return found.join(near, [*keys, "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
