"""Line diffs of texts of any length: unique common lines first, gaps between them as rows of their own.

A gap is a run of rows on each side. Lines that stand once on both sides of a gap are anchors. Anchors that follow each other on both sides make runs, found by joining each anchor to
the next; a heaviest chain of runs in the same order is kept, and what lies between is gaps again. So a large file's lines are hashed, counted and joined as rows of a frame, spread over tasks;
only its runs, as many as there are edits, are ordered in one task, and only gaps without anchors are compared line by line. Rounds end when no gap has an anchor.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.alignment import TEXT_EDITS, common_subsequence, text_lines
from palimpsest.operators.assignment import written
from palimpsest.operators.pairs import line_rows
from palimpsest.session import small_batches, spread

PAIR = "pair_id"
GAP = [PAIR, "b_from", "a_from"]


def heaviest(runs: list[tuple[int, int, int]]) -> list[int]:
    """Places of a heaviest chain of runs (before, after, weight), ascending by `before`, whose `after` ascends too."""
    order = sorted({a for _, a, _ in runs})
    best = [(0, -1)] * (len(order) + 1)  # a tree of running maxima over the ranks of `after`
    back, weight = [-1] * len(runs), [0] * len(runs)
    for i, (_, a, w) in enumerate(runs):
        rank = bisect_left(order, a)
        top, k = (0, -1), rank
        while k:
            top = max(top, best[k])
            k &= k - 1
        back[i], weight[i] = top[1], top[0] + w
        k = rank + 1
        while k < len(best):
            best[k] = max(best[k], (weight[i], i))
            k += k & -k
    out, i = [], max(range(len(runs)), key=lambda i: (weight[i], -i)) if runs else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _kept(names: list[str]):
    """Of each gap's runs those in a heaviest chain, and the gaps before, between and behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                runs = [(x["b"], x["a"], x["n"]) for x in r["runs"]]
                b, a = r["b_from"], r["a_from"]
                for i in heaviest(runs):
                    x, y, n = runs[i]
                    out.append((r[PAIR], x, y, n, b, x, a, y))
                    b, a = x + n, y + n
                out.append((r[PAIR], None, None, None, b, r["b_to"], a, r["a_to"]))
            kinds = (batch.schema.field(PAIR).type, *[pa.int32()] * 7)
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def anchors(gaps: DataFrame, lines: DataFrame) -> DataFrame:
    """(pair_id, b_from, a_from, b_to, a_to, b, a): rows whose line stands once on each side of a gap. lines: (pair_id, side, row, h)."""

    def rows(side: str) -> DataFrame:
        own = lines.where(F.col("side") == side).select(PAIR, "row", "h")
        each = gaps.select(*GAP, "b_to", "a_to", F.explode(F.sequence(F.col(f"{side}_from"), F.col(f"{side}_to") - 1)).alias("row"))
        return each.join(own, [PAIR, "row"]).groupBy(*GAP, "b_to", "a_to", "h").agg(F.count("*").alias("n"), F.min("row").alias(side)).where("n = 1").drop("n")

    return rows("b").join(rows("a").drop("b_to", "a_to"), [*GAP, "h"]).drop("h")


def runs(found: DataFrame) -> DataFrame:
    """(gap..., b_to, a_to, b, a, n): anchors that follow each other on both sides, as one row. The k-th start of a diagonal belongs to the k-th end."""
    step = lambda by: found.select(*GAP, (F.col("b") + by).alias("b"), (F.col("a") + by).alias("a"))
    w = Window.partitionBy(*GAP, "_d").orderBy("b")
    edge = lambda by: found.join(step(by), [*GAP, "b", "a"], "left_anti").withColumn("_d", F.col("b") - F.col("a")).withColumn("_k", F.row_number().over(w))
    ends = edge(-1).select(*GAP, "_d", "_k", F.col("b").alias("_last"))
    return edge(1).join(ends, [*GAP, "_d", "_k"]).select(*GAP, "b_to", "a_to", "b", "a", (F.col("_last") - F.col("b") + 1).alias("n"))


def _aligned(names: list[str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [(r[PAIR], r["b_from"] + i, r["a_from"] + j) for i, j in common_subsequence(r["b"], r["a"], most) or []]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (batch.schema.field(PAIR).type, pa.int32(), pa.int32()), strict=True)], names=names)

    return run


def first_gaps(lines: DataFrame) -> DataFrame:
    """Each pair as one gap, (pair_id, b_from, b_to, a_from, a_to), if both sides have lines."""
    n = lines.groupBy(PAIR).agg(F.max(F.when(F.col("side") == "b", F.col("row") + 1)).alias("b_to"), F.max(F.when(F.col("side") == "a", F.col("row") + 1)).alias("a_to"))
    return n.where("b_to is not null and a_to is not null").select(PAIR, F.lit(0).alias("b_from"), "b_to", F.lit(0).alias("a_from"), "a_to")


def hashed_lines(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, row, h) of the lines of (pair_id, before, after)."""
    one = lambda name, side: line_rows(pairs, PAIR, name).select(PAIR, F.lit(side).alias("side"), "row", F.md5("line").alias("h"))
    return one("before", "b").unionByName(one("after", "a"))


def chained(found: DataFrame) -> DataFrame:
    """(pair_id, b, a, n, b_from, b_to, a_from, a_to): runs of anchors that are kept, each with the gap before it, and, without a run, the gap behind the last."""
    kind = found.schema[PAIR].dataType.simpleString()
    names = [PAIR, "b", "a", "n", "b_from", "b_to", "a_from", "a_to"]
    listed = runs(found).groupBy(*GAP, "b_to", "a_to").agg(F.sort_array(F.collect_list(F.struct("b", "a", "n"))).alias("runs"))
    return listed.mapInArrow(_kept(names), f"{PAIR} {kind}, " + ", ".join(f"{n} int" for n in names[1:]))


def matched_rows(pairs: DataFrame, most: int = TEXT_EDITS) -> DataFrame:
    """(pair_id, before_row, after_row) of the lines of (pair_id, before, after) that are partners.

    In a gap without anchors lines are aligned by a longest common subsequence; beyond `most` edits nothing in that gap matches.
    """
    lines = written(hashed_lines(pairs))
    gaps = first_gaps(lines)
    out: list[DataFrame] = []
    final: list[DataFrame] = []
    while True:
        gaps = written(gaps)
        steps = written(chained(written(anchors(gaps, lines))))
        kept = steps.where("n is not null")
        final.append(gaps.join(steps.select(PAIR, F.col("b_from"), F.col("a_from")).distinct(), GAP, "left_anti"))
        if not steps.take(1):
            break
        out.append(kept.select(PAIR, "b", "a", "n"))
        gaps = steps.where("b_to > b_from and a_to > a_from").select(PAIR, "b_from", "b_to", "a_from", "a_to")
    rest = reduce(DataFrame.unionByName, final)

    def listed(side: str) -> DataFrame:
        own = lines.where(F.col("side") == side).select(PAIR, "row", "h")
        each = rest.select(*GAP, F.explode(F.sequence(F.col(f"{side}_from"), F.col(f"{side}_to") - 1)).alias("row"))
        return each.join(own, [PAIR, "row"]).groupBy(*GAP).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "h"))), lambda x: x["h"]).alias(side))

    kind = pairs.schema[PAIR].dataType.simpleString()
    small = listed("b").join(listed("a"), GAP).mapInArrow(_aligned([PAIR, "before_row", "after_row"], most), f"{PAIR} {kind}, before_row int, after_row int")
    if not out:
        return small
    each = reduce(DataFrame.unionByName, out).select(PAIR, "b", "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select(PAIR, (F.col("b") + F.col("i")).alias("before_row"), (F.col("a") + F.col("i")).alias("after_row")).unionByName(small)


def common_rows(before: list[str], after: list[str], most: int = TEXT_EDITS) -> list[tuple[int, int]]:
    """What matched_rows() finds for one pair of lists of lines: the same anchors, chains and gaps, in the order in which gaps are met."""
    numbers: dict[str, int] = {}
    b, a = ([numbers.setdefault(x, len(numbers)) for x in side] for side in (before, after))
    out: list[tuple[int, int]] = []
    gaps = [(0, len(b), 0, len(a))]
    while gaps:
        b_from, b_to, a_from, a_to = gaps.pop()
        if b_from == b_to or a_from == a_to:
            continue
        once = _once(a, a_from, a_to)
        runs: list[tuple[int, int, int]] = []
        for x, line in sorted((x, line) for line, x in _once(b, b_from, b_to).items() if line in once):
            y = once[line]
            if runs and (x - runs[-1][2], y - runs[-1][2]) == runs[-1][:2]:
                runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
            else:
                runs.append((x, y, 1))
        if not runs:
            out += [(b_from + i, a_from + j) for i, j in common_subsequence(b[b_from:b_to], a[a_from:a_to], most) or []]
        for i in heaviest(runs):
            x, y, n = runs[i]
            out += zip(range(x, x + n), range(y, y + n), strict=True)
            gaps.append((b_from, x, a_from, y))
            b_from, a_from = x + n, y + n
        if runs:
            gaps.append((b_from, b_to, a_from, a_to))
    return out


def _once(lines: list[int], first: int, to: int) -> dict[int, int]:
    """line -> its place, of the lines that stand once in a range."""
    at = {lines[i]: i for i in range(first, to)}
    if len(at) == to - first:
        return at
    n = Counter(lines[first:to])
    return {line: i for line, i in at.items() if n[line] == 1}


def counts(pairs: DataFrame, most: int = TEXT_EDITS) -> DataFrame:
    """(pair_id, inserted, deleted) in rows, by common_rows() where a pair lies: both texts are in one row, so lines need not leave it and nothing is shuffled."""
    kind = pairs.schema[PAIR].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inserted, deleted = [], []
            for _, before, after in zip(*batch.columns, strict=True):
                b, a = (text_lines(x.as_py() or "") for x in (before, after))
                met = len(common_rows(b, a, most))
                inserted.append(len(a) - met)
                deleted.append(len(b) - met)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(inserted, pa.int64()), pa.array(deleted, pa.int64())], names=[PAIR, "inserted", "deleted"])

    return small_batches(spread(pairs.select(PAIR, "before", "after"))).mapInArrow(run, f"{PAIR} {kind}, inserted long, deleted long")
