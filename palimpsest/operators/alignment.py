"""Alignment of two sequences: shortest edit scripts, weighted common subsequences, and line diffs of pairs of texts."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edits after which two texts are told to have nothing in common.
TEXT_EDITS = 10_000
TREE_EDITS = 1_000
#: Edits up to which the steps of an alignment are kept, some 4 MB; beyond, it is halved until they are few.
DIRECT = 1_500


def common_subsequence(a: Sequence, b: Sequence, most: int) -> list[tuple[int, int]] | None:
    """Places (i, j) of a longest common subsequence by greedy furthest-reaching paths; None beyond `most` edits.

    Where two paths reach equally far, the one that deletes goes on. Beyond DIRECT edits space is linear, and of several longest ones another may be found.
    """
    found, edits = _direct(a, b, min(most, DIRECT))
    if found is not None or edits >= most:
        return found
    return halved(a, b) if _edits(a, b, most) is not None else None


def _edits(a: Sequence, b: Sequence, most: int) -> int | None:
    """The number of edits, None beyond `most`, without the steps."""
    n, m = len(a), len(b)
    furthest = {1: 0}
    for d in range(min(most, n + m) + 1):
        for k in range(-d, d + 1, 2):
            x = furthest[k + 1] if k == -d or (k != d and furthest[k - 1] < furthest[k + 1]) else furthest[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            furthest[k] = x
            if x >= n and x - k >= m:
                return d
    return None


def _middle(a: Sequence, b: Sequence) -> tuple[int, int, int, int]:
    """Start and end of a run of equal items in the middle of a shortest script, where paths from both ends meet."""
    n, m = len(a), len(b)
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            first = x
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and abs(k - delta) <= d - 1 and x + back[delta - k] >= n:
                return first, first - k, x, x - k
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            first = x
            while x < n and x - k < m and a[n - 1 - x] == b[m - 1 - x + k]:
                x += 1
            back[k] = x
            if delta % 2 == 0 and abs(k - delta) <= d and x + ahead[delta - k] >= n:
                return n - x, m - x + k, n - first, m - first + k
    raise AssertionError("paths from both ends meet")


def halved(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence in linear space: parted at the middle of a shortest script until nothing differs."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        x, y, u, v = _middle(a[i:n], b[j:m])
        out += [(i + x + k, j + y + k) for k in range(u - x)]
        todo += [(i, i + x, j, j + y), (i + u, n, j + v, m)]
    return sorted(out)


def _direct(a: Sequence, b: Sequence, most: int) -> tuple[list[tuple[int, int]] | None, int]:
    """common_subsequence() by the steps of all edits, with the number of edits tried."""
    n, m = len(a), len(b)
    if not n or not m:
        return [], 0
    furthest = {1: 0}
    steps: list[array] = []
    for d in range(min(most, n + m) + 1):
        row = array("i")
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and furthest[k - 1] < furthest[k + 1])
            x = furthest[k + 1] if down else furthest[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            furthest[k] = x
            row.append(x)
            if x >= n and x - k >= m:
                steps.append(row)
                return _walk_back(steps, n, m), d
        steps.append(row)
    return None, most


def _walk_back(steps: list[array], x: int, y: int) -> list[tuple[int, int]]:
    out = []
    for d in range(len(steps) - 1, 0, -1):
        k = x - y
        before = steps[d - 1]
        reach = lambda at, d=d, before=before: before[(at + d - 1) // 2]
        down = k == -d or (k != d and reach(k - 1) < reach(k + 1))
        k += 1 if down else -1
        to_x = reach(k)
        start = to_x if down else to_x + 1
        while x > start:
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = to_x, to_x - k
    while x > 0:
        x, y = x - 1, y - 1
        out.append((x, y))
    return out[::-1]


def weighted_subsequence(n: int, m: int, weight: Callable[[int, int], float]) -> list[tuple[int, int]]:
    """Places of the common subsequence of the highest total weight; pairs of weight 0 never match."""
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            w = weight(i, j)
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + w if w else 0.0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        w = weight(i, j)
        if w and best[i][j] == best[i + 1][j + 1] + w:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def increasing_subsequence(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k:
            back[i] = at[k - 1]
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def text_lines(text: str) -> list[str]:
    """Lines without their ends (LF or CR LF), and without an empty one after the last end."""
    out = text.replace("\r\n", "\n").split("\n")
    if out[-1] == "":
        out.pop()
    return out


RANGE = "struct<first:int,last:int,to_first:int,to_last:int,op:string>"
LINE_DIFF = f"matched array<struct<before:int,after:int>>, over_cap boolean, before_ranges array<{RANGE}>, after_ranges array<{RANGE}>"


def line_ranges(n: int, m: int, matched: list[tuple[int, int]], op: str) -> list[dict]:
    """Runs of rows of one side: Identical with its place on the other, or op with the empty place where it would stand."""
    out: list[dict] = []

    def add(first: int, last: int, to_first: int, to_last: int, what: str) -> None:
        if first == last:
            return
        if out and out[-1]["op"] == what and out[-1]["last"] == first and (what == op or out[-1]["to_last"] == to_first):
            out[-1] |= {"last": last, "to_last": to_last if what != op else out[-1]["to_last"]}
        else:
            out.append({"first": first, "last": last, "to_first": to_first, "to_last": to_last, "op": what})

    i = j = 0
    for x, y in matched:
        add(i, x, j, j, op)
        add(x, x + 1, y, y + 1, "Identical")
        i, j = x + 1, y + 1
    add(i, n, j, j, op)
    return out


def line_diff(before: str, after: str, most: int = TEXT_EDITS) -> dict:
    b, a = text_lines(before), text_lines(after)
    matched = common_subsequence(b, a, most)
    over = matched is None
    pairs = matched or []
    return {
        "matched": [{"before": i, "after": j} for i, j in pairs],
        "over_cap": over,
        "before_ranges": line_ranges(len(b), len(a), pairs, "Delete"),
        "after_ranges": line_ranges(len(a), len(b), [(j, i) for i, j in pairs], "Insert"),
    }


def line_diffs(pairs: DataFrame, most: int = TEXT_EDITS) -> DataFrame:
    """(pair_id, matched, over_cap, before_ranges, after_ranges) of (pair_id, before, after); pairs are independent, so nothing is shuffled."""
    schema = T.StructType([pairs.schema["pair_id"], *T.StructType.fromDDL(LINE_DIFF).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for b in batches:
            rows = [line_diff(x or "", y or "", most) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(fields)[1:])], schema=pa.schema([fields[0], *list(fields)[1:]]))

    return pairs.select("pair_id", "before", "after").mapInArrow(run, schema)


def count_ops(diffs: DataFrame) -> DataFrame:
    """(pair_id, inserted, deleted, updated) in rows."""
    rows = lambda c, op: F.aggregate(F.filter(c, lambda r: r["op"] == op), F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"])
    return diffs.select(
        "pair_id", rows("after_ranges", "Insert").alias("inserted"), rows("before_ranges", "Delete").alias("deleted"), rows("after_ranges", "Update").alias("updated")
    )


def labels(diffs: DataFrame) -> DataFrame:
    """(pair_id, side, row, op, touched): each row of each side with its operation; others than Identical win, later ones first."""
    side = lambda name: diffs.select("pair_id", F.lit(name).alias("side"), F.posexplode(f"{name}_ranges").alias("ord", "r"))
    r = side("before").unionByName(side("after")).where("r.last > r.first")
    each = r.select("pair_id", "side", "ord", "r.op", F.explode(F.sequence(F.col("r.first"), F.col("r.last") - 1)).alias("row"))
    top = each.groupBy("pair_id", "side", "row").agg(F.max_by("op", F.struct((F.col("op") != "Identical").alias("x"), "ord")).alias("op"))
    return top.withColumn("touched", F.col("op") != "Identical")


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair_id, rows, differ): rows of two labellings and how many of them one touches and the other does not."""
    x = a.select("pair_id", "side", "row", F.col("touched").alias("x"))
    y = b.select("pair_id", "side", "row", F.col("touched").alias("y"))
    met = x.join(y, ["pair_id", "side", "row"], "full_outer").na.fill(False, ["x", "y"])
    return met.groupBy("pair_id").agg(F.count("*").alias("rows"), F.count_if(F.col("x") != F.col("y")).alias("differ"))


def summarise(before: Column, after: Column, before_ranges: Column, after_ranges: Column) -> Column:
    """The class of a change from contents and ranges, the first that holds; null for any other."""
    from palimpsest.operators.pairs import content_summary

    every = lambda c, *ops: F.forall(c, lambda r: r["op"].isin(*ops))
    moved = F.exists(before_ranges, lambda r: r["op"] == "Move") | F.exists(after_ranges, lambda r: r["op"] == "Move")
    return F.coalesce(content_summary(before, after), F.when(every(before_ranges, "Identical", "Move") & every(after_ranges, "Identical", "Move") & moved, "RefactorMovedOnly"))
