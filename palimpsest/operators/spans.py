"""Mappings projected to ranges of text: gaps and islands over pieces of text, with a limit carried from one to the next.

On frames for trees and mappings of any kind; in_place() for pairs of plain texts, whose words are arrays that never leave the task in which their pair lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.claims import equal_subtrees
from palimpsest.operators.mapping import together
from palimpsest.operators.trees import TextTree
from palimpsest.session import small_batches, spread

PAIR = "pair_id"
PIECE = "pre int, k int, start int, finish int, col int, text string"


def text_pieces(units: DataFrame, unit_id: str, contents: str, language: str) -> DataFrame:
    """(unit_id, pre, k, start, finish, col, text) of all text that is not blank: the k-th piece that node `pre` holds itself, its place and column, in characters."""
    schema = T.StructType([T.StructField(unit_id, units.schema[unit_id].dataType), *T.StructType.fromDDL(PIECE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from palimpsest.operators.ranges import pieces
        from palimpsest.operators.trees import BATCH_NODES, build

        fields = to_arrow_schema(schema)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

        rows: list[tuple] = []
        for b in batches:
            for unit, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree = build(text or "", lang, False)
                seen = {}
                for a, z, i in pieces(tree) if tree else []:
                    seen[i] = seen.get(i, -1) + 1
                    rows.append((unit, i, seen[i], a, z, a - (text.rfind("\n", 0, a) + 1), text[a:z]))
                if len(rows) >= BATCH_NODES:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return spread(units.select(unit_id, contents, language)).mapInArrow(run, schema)


def projected(before: DataFrame, after: DataFrame, mapping: DataFrame) -> DataFrame:
    """(pair_id, side, number, start, finish, to_start, to_finish, op) of both sides in order.

    A piece goes to the piece of the same number that its node's partner holds: Identical, Move where it starts in another column, Update where the text differs. One without such a
    piece is a Delete or Insert and stands, empty, where the piece before it ends on the other side. Pieces of one operation become one range as long as they follow each
    other on both sides with nothing but white space between, which is to say: as long as their numbers on the other side do. Pieces are rows of text_pieces() with a pair_id.
    """
    order = Window.partitionBy(PAIR).orderBy("start", "finish", "pre")
    numbered = lambda p: together(p).withColumn("at", F.row_number().over(order))
    b, a = numbered(before), numbered(after)

    def one(side: str, own: DataFrame, other: DataFrame, pre: str, to: str, lone: str) -> DataFrame:
        met = mapping.where("b_pre is not null and a_pre is not null").select(PAIR, F.col(pre).alias("pre"), F.col(to).alias("_to"))
        there = other.select(PAIR, F.col("pre").alias("_to"), "k", F.col("at").alias("_at"), F.col("start").alias("_x"), F.col("finish").alias("_y"), F.col("col").alias("_col"), F.col("text").alias("_text"))
        rows = own.join(met, [PAIR, "pre"], "left").join(there, [PAIR, "_to", "k"], "left")
        op = F.when(F.col("_at").isNull(), lone).when(F.col("text") != F.col("_text"), "Update").when(F.col("col") == F.col("_col"), "Identical").otherwise("Move")
        w = Window.partitionBy(PAIR).orderBy("at")
        limit = F.coalesce(F.last("_y", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = rows.withColumn("op", op).withColumn("_limit", limit)
        follows = (F.col("op") == F.lag("op").over(w)) & (F.col("_at").isNull() | (F.col("_at") == F.lag("_at").over(w) + 1))
        island = F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(w)
        spans = placed.withColumn("number", island).groupBy(PAIR, "number", "op").agg(
            F.min("start").alias("start"), F.max("finish").alias("finish"), F.min_by(F.coalesce("_x", "_limit"), "at").alias("to_start"), F.max_by(F.coalesce("_y", "_limit"), "at").alias("to_finish")
        )
        return spans.select(PAIR, F.lit(side).alias("side"), (F.col("number") - 1).cast("long").alias("number"), "start", "finish", "to_start", "to_finish", "op")

    return one("before", b, a, "b_pre", "a_pre", "Delete").unionByName(one("after", a, b, "a_pre", "b_pre", "Insert"))


def mirrored(spans: DataFrame) -> DataFrame:
    """The spans with each Insert of the after side shown on the before side too, as an empty Delete where it would stand.

    A shown Insert comes before that range of the before side that has as many ranges before it as the Insert has ranges of other kinds; one that comes after the last is left out.
    Numbers are given anew.
    """
    own, theirs = spans.where("side = 'before'"), spans.where("side = 'after'")
    w = Window.partitionBy(PAIR).orderBy("number")
    before = F.sum((F.col("op") != "Insert").cast("long")).over(w)
    shown = theirs.withColumn("_at", before).where("op = 'Insert'").select(
        PAIR, "_at", F.lit(0).alias("_own"), "number", F.col("to_start").alias("start"), F.col("to_finish").alias("finish"), F.col("start").alias("to_start"), F.col("finish").alias("to_finish"), F.lit("Delete").alias("op")
    )
    rows = own.select(PAIR, F.col("number").alias("_at"), F.lit(1).alias("_own"), "number", "start", "finish", "to_start", "to_finish", "op")
    kept = rows.unionByName(shown.join(own.groupBy(PAIR).agg(F.max("number").alias("_last")), PAIR).where("_at <= _last").drop("_last"))
    number = F.row_number().over(Window.partitionBy(PAIR).orderBy("_at", "_own", "number")) - 1
    return kept.select(PAIR, F.lit("before").alias("side"), number.cast("long").alias("number"), "start", "finish", "to_start", "to_finish", "op").unionByName(theirs)


def row_labels(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (pair_id, side, row, start, finish) with `op`: the operation of the last range in a row that is neither Identical nor empty; Identical if there is none.

    Each range is cut at the rows it touches by a join on its first row and the count of rows, found by running counts: one union, no pair of range and row is formed but those that meet.
    """
    marks = rows.select(PAIR, "side", F.col("start").alias("at"), F.lit(1).alias("_row"), F.lit(None).cast("struct<number:long,start:int,finish:int,op:string>").alias("_span"))
    real = spans.where("op <> 'Identical' and finish > start")
    edge = lambda at: real.select(PAIR, "side", at.alias("at"), F.lit(0).alias("_row"), F.struct("number", "start", "finish", "op").alias("_span"))
    w = Window.partitionBy(PAIR, "side").orderBy("at", F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    first = marks.unionByName(edge(F.col("start"))).withColumn("_in", F.sum("_row").over(w)).where("_row = 0").select(PAIR, "side", "_span", F.col("_in").alias("_first"))
    last = marks.unionByName(edge(F.col("finish") - 1)).withColumn("_in", F.sum("_row").over(w)).where("_row = 0").select(PAIR, "side", "_span", F.col("_in").alias("_last"))
    touched = first.join(last, [PAIR, "side", "_span"]).select(PAIR, "side", F.col("_span.number").alias("number"), F.col("_span.op").alias("op"), F.explode(F.sequence("_first", "_last")).alias("_n"))
    top = touched.groupBy(PAIR, "side", "_n").agg(F.max_by("op", "number").alias("op"))
    n = F.row_number().over(Window.partitionBy(PAIR, "side").orderBy("start", "row")).cast("long")
    return rows.withColumn("_n", n).join(top, [PAIR, "side", "_n"], "left").select(PAIR, "side", "row", F.coalesce("op", F.lit("Identical")).alias("op"))


# ---- the same, where a pair of plain texts lies

#: What ranges can be, by number: as projected() names them on the before and on the after side.
OPS = (("Delete", "Update", "Identical", "Move"), ("Insert", "Update", "Identical", "Move"))
LONE, UPDATE, IDENTICAL, MOVE = range(4)
SIDES = ("before", "after")
#: Rows of an Arrow batch that pairs share.
BATCH_ROWS = 1 << 15
#: start, finish, to_start, to_finish and op of the ranges of a side.
Ranges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _offsets(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of some runs."""
    return np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)


def words_by_path(b: TextTree, a: TextTree) -> np.ndarray:
    """For each word of b the number of the word of a that has its path, document/block[i]/line[j]/word[k]; -1 if there is none."""
    line = np.full(len(b.l_first), -1)
    block = np.flatnonzero(b.l_block < len(a.b_first))
    block = block[b._l_sib[block] < a.b_n[b.l_block[block]]]
    line[block] = a.b_first[b.l_block[block]] + b._l_sib[block]
    met = np.flatnonzero(line >= 0)
    n = np.minimum(b.l_n[met], a.l_n[line[met]])
    out, k = np.full(len(b.w_start), -1), _offsets(n)
    out[np.repeat(b.l_first[met], n) + k] = np.repeat(a.l_first[line[met]], n) + k
    return out


def words_by_claims(b: TextTree, a: TextTree) -> np.ndarray:
    """For each word of b its partner in the subtrees that claims.hash_claims() pairs by place: documents, blocks and lines of equal words. Contents stand for hashes."""

    def nodes(t: TextTree) -> list[tuple[int, int, object]]:
        lines = [" ".join(t.text_all[x:y].split()) for x, y in zip(t.l_start.tolist(), t.l_end.tolist(), strict=True)]
        firsts = t.b_first.tolist()
        blocks = ["\n".join(lines[f : f + n]) for f, n in zip(firsts, t.b_n.tolist(), strict=True)]
        of = lambda kind, pres, sizes, keys: [(p, s, (kind, k)) for p, s, k in zip(pres, sizes, keys, strict=True)]
        whole = [(0, t.n, ("document", "\n\n".join(blocks)))] if blocks else []
        return whole + of("block", t.b_pre.tolist(), t._b_size.tolist(), blocks) + of("line", t.l_pre.tolist(), (t.l_n + 1).tolist(), lines)

    out = np.full(len(b.w_start), -1)
    roots = equal_subtrees(nodes(b), nodes(a))
    if roots:
        x, y, size = np.array(roots).T
        at = b._w_pre.searchsorted(x)
        n = b._w_pre.searchsorted(x + size) - at
        k = _offsets(n)
        out[np.repeat(at, n) + k] = np.repeat(a._w_pre.searchsorted(y), n) + k
    return out


def _ranges(own: TextTree, other: TextTree, to: np.ndarray, same: np.ndarray) -> Ranges:
    """projected() for one side: `to` is each word's partner or -1, `same` whether it has the same text."""
    met = to >= 0
    column = lambda t: t.w_start - np.repeat(t.l_start, t.l_n)
    op = np.full(len(to), LONE, np.int8)
    partners = to[met]
    op[met] = np.where(~same[met], UPDATE, np.where(column(own)[met] == column(other)[partners], IDENTICAL, MOVE))
    begins = np.ones(len(to), bool)
    begins[1:] = (op[1:] != op[:-1]) | (met[1:] & (to[1:] != to[:-1] + 1))
    first = begins.nonzero()[0]
    last = np.append(first[1:], len(to))[: len(first)] - 1
    # words of a range all have partners or all have none; those without stand where the last partner before them ends
    limit = np.zeros(len(to), np.int64)
    limit[met] = other.w_end[partners]
    before = np.maximum.accumulate(np.where(met, np.arange(len(to)), -1))[first] if len(first) else first
    lone = np.where(before >= 0, limit[before], 0) if len(first) else first
    has = met[first]
    x, y = lone.copy(), lone.copy()
    x[has], y[has] = other.w_start[to[first[has]]], limit[last[has]]
    return own.w_start[first], own.w_end[last], x, y, op[first]


def _equal_words(b: TextTree, a: TextTree, to: np.ndarray) -> np.ndarray:
    x, y = b.text_all.split(), a.text_all.split()
    return np.fromiter((j >= 0 and w == y[j] for w, j in zip(x, to.tolist(), strict=True)), bool, len(x))


def _pair_ranges(b: TextTree, a: TextTree, by: str) -> tuple[Ranges, Ranges]:
    """The ranges of both sides of a pair of plain texts, as projected() has them."""
    to = (words_by_path if by == "path" else words_by_claims)(b, a)
    met = to >= 0
    same = _equal_words(b, a, to) if by == "path" else met
    back, back_same = np.full(len(a.w_start), -1), np.zeros(len(a.w_start), bool)
    back[to[met]], back_same[to[met]] = met.nonzero()[0], same[met]
    return _ranges(b, a, to, same), _ranges(a, b, back, back_same)


def _mirrored(own: Ranges, theirs: Ranges) -> tuple[Ranges, Ranges]:
    """mirrored() for one pair."""
    insert = theirs[4] == LONE
    at = (~insert).cumsum()[insert]
    shown = np.flatnonzero(insert)[at < len(own[0])]
    order = np.concatenate((2 * at[at < len(own[0])], 2 * np.arange(len(own[0])) + 1)).argsort(kind="stable")
    put = lambda i, j: np.concatenate((theirs[i][shown], own[j]))[order]
    return (put(2, 0), put(3, 1), put(0, 2), put(1, 3), put(4, 4)), theirs


def _line_ops(text: str, ranges: Ranges) -> np.ndarray:
    """row_labels() for one text."""
    starts = np.array([0, *(len(x) + 1 for x in text.split("\n")[:-1])]).cumsum()
    start, finish, _, _, op = (x[ranges[4] != IDENTICAL] for x in ranges)
    first = starts.searchsorted(start, "right") - 1
    n = starts.searchsorted(finish - 1, "right") - first
    rows = np.repeat(first, n) + _offsets(n)
    out = np.full(len(starts), IDENTICAL, np.int8)
    if len(rows):
        final = np.append(rows[1:] != rows[:-1], True)  # of a row the last range: both ascend
        out[rows[final]] = np.repeat(op, n)[final]
    return out


def _in_place(pairs: DataFrame, schema: str, one: Callable[[str, str], list[tuple[np.ndarray, ...]]]) -> DataFrame:
    """(pair_id, side, number or row, columns..., op) of (pair_id, before, after), from what `one` gives for each side; nothing is shuffled."""
    kinds = T.StructType([pairs.schema[PAIR], *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(kinds)

        def batch(held: list[tuple[object, int, tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
            counts = np.array([len(x[0]) for _, _, x in held])
            each = lambda values, kind: pa.array(values, kind).take(pa.array(np.repeat(np.arange(len(held)), counts)))
            side = np.repeat(np.array([s for _, s, _ in held]), counts)
            *rest, op = (np.concatenate(c) for c in zip(*(x for _, _, x in held), strict=True))
            columns = [each([k for k, _, _ in held], fields[0].type), pa.array(SIDES).take(pa.array(side)), pa.array(_offsets(counts)).cast(fields[2].type)]
            columns += [pa.array(c).cast(f.type) for c, f in zip(rest, list(fields)[3:-1], strict=True)]
            columns.append(pa.array([*OPS[0], *OPS[1]]).take(pa.array(op + len(OPS[0]) * side)))
            return pa.RecordBatch.from_arrays(columns, schema=fields)

        held, n = [], 0
        for b in batches:
            for key, before, after in zip(*b.columns, strict=True):
                for side, made in enumerate(one(before.as_py(), after.as_py())):
                    held.append((key.as_py(), side, made))
                    n += len(made[0])
                if n >= BATCH_ROWS:
                    yield batch(held)
                    held, n = [], 0
        if n:
            yield batch(held)

    return small_batches(spread(pairs.select(PAIR, *SIDES))).mapInArrow(run, kinds)


def in_place(pairs: DataFrame, by: str, mirror: bool = False) -> DataFrame:
    """projected() (and mirrored()) for pairs of plain texts (pair_id, before, after) in one pass, without a shuffle: words of one `path` are partners, or those of equal subtrees (`claims`)."""

    def one(before: str | None, after: str | None) -> list[tuple[np.ndarray, ...]]:
        found = _pair_ranges(TextTree(before or "", "Text"), TextTree(after or "", "Text"), by)
        return list(_mirrored(*found) if mirror else found)

    return _in_place(pairs, "side string, number long, start int, finish int, to_start int, to_finish int, op string", one)


def line_labels(pairs: DataFrame, by: str) -> DataFrame:
    """(pair_id, side, row, op): row_labels() of all lines of both sides, an empty one after the last end too, from in_place()'s ranges. A missing side has no lines."""

    def one(before: str | None, after: str | None) -> list[tuple[np.ndarray, ...]]:
        found = _pair_ranges(TextTree(before or "", "Text"), TextTree(after or "", "Text"), by)
        return [(_line_ops(t, r) if t is not None else np.empty(0, np.int8),) for t, r in zip((before, after), found, strict=True)]

    return _in_place(pairs, "side string, row int, op string", one)
