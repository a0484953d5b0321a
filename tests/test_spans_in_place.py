"""Ranges, labels and line diffs that are worked out where a pair lies, against the same on frames; their plans deal nothing out."""

import random

import pytest
from pyspark.sql import functions as F
from test_claims import texts
from test_patience import PAIRS, word_mapping

from palimpsest.operators import claims, mapping, patience, spans
from palimpsest.operators.alignment import text_lines
from palimpsest.plans import catalog

ODD = [
    (100, "", "a b"), (101, "a  b\n\n c", "a b\n\n  c"), (102, "x", ""), (103, "", ""), (104, " \n\t\n", "\n"), (105, "a\r\nb c\r\n\r\nd", "a\nb  c\n\nd\r"), (106, "same\nsame\n\nsame", "same\n\nsame\nsame\nsame"),
    (107, "ä ö ü\n\n日本 語", "日本 語\n\nä ö ü"), (108, "a\x0bb\x85c", "a b c"), (109, "p q\n\np q\n\np q", "p q\n\nz\n\np q"), (110, "x y\n", "x y\n"),
]


def collected(df):
    return sorted(map(tuple, df.collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture(scope="module")
def frames(spark):
    """Pairs, and the ranges of both sides on frames, by path and by claims."""
    rows = texts(19, 40) + ODD
    b, pb, a, pa = word_mapping(spark, rows)
    fit = F.col("size") >= 2
    by_claims = claims.lockstep(claims.hash_claims(b.where(fit), a.where(fit), place="pre"))
    found = {"path": spans.projected(pb, pa, mapping.by_paths(b, a).select("pair_id", "b_pre", "a_pre")).cache(), "claims": spans.projected(pb, pa, by_claims).cache()}
    return rows, spark.createDataFrame(rows, PAIRS).repartition(3), found


@pytest.mark.parametrize("by", ["path", "claims"])
def test_ranges_in_place(frames, by):
    _, pairs, found = frames
    got = collected(spans.in_place(pairs, by))
    assert got == collected(found[by])
    assert {x[-1] for x in got} >= {"Identical", "Move", "Insert", "Delete"}


def test_mirrored_in_place(frames):
    _, pairs, found = frames
    assert collected(spans.in_place(pairs, "claims", mirror=True)) == collected(spans.mirrored(found["claims"]))


def test_labels_in_place(spark, frames):
    rows, pairs, found = frames
    lines = []
    for i, *both in rows:
        for side, text in zip(spans.SIDES, both, strict=True):
            at = 0
            for row, line in enumerate(text.split("\n")):
                lines.append((i, side, row, at, at + len(line)))
                at += len(line) + 1
    df = spark.createDataFrame(lines, "pair_id long, side string, row int, start int, finish int")
    assert collected(spans.line_labels(pairs, "path")) == collected(spans.row_labels(found["path"], df))


def test_missing_sides(spark):
    pairs = spark.createDataFrame([(1, None, "a b"), (2, "a", None), (3, None, None)], PAIRS)
    assert collected(spans.in_place(pairs, "path")) == [(1, "after", 0, 0, 3, 0, 0, "Insert"), (2, "before", 0, 0, 1, 0, 0, "Delete")]
    assert collected(spans.line_labels(pairs, "path")) == [(1, "after", 0, "Insert"), (2, "before", 0, "Delete")]


def test_equal_subtrees_as_rounds_find_them(spark):
    r = random.Random(23)
    rows = {}
    for i in range(60):  # nested sets whose keys tell their contents
        sides = []
        for _ in range(2):
            nodes, at = [], 1
            for _ in range(r.randint(0, 6)):
                kids = [r.choice("abc") for _ in range(r.randint(1, 3))]
                nodes += [(at, len(kids) + 1, "(" + "".join(kids) + ")"), *((at + 1 + k, 1, x) for k, x in enumerate(kids))]
                at += len(kids) + 1
            sides.append([(0, at, "root " + "".join(x for _, s, x in nodes if s > 1)), *nodes])
        rows[i] = sides
    frame = lambda k: spark.createDataFrame([(i, p, s, x) for i, both in rows.items() for p, s, x in both[k]], "pair_id long, pre int, size int, full_hash string")
    want = collected(claims.hash_claims(frame(0), frame(1), place="pre"))
    assert sorted((i, *x) for i, (b, a) in rows.items() for x in claims.equal_subtrees(b, a)) == want


def test_common_rows_as_frames_find_them(spark):
    r = random.Random(29)
    pairs = texts(31, 30) + ODD
    for i in range(60):
        side = lambda: "\n".join(r.choices("abcdefgh", k=r.randint(0, 12)) + [f"u{r.randint(0, 9)}" for _ in range(r.randint(0, 8))])
        pairs.append((200 + i, side(), side()))
    want = collected(patience.matched_rows(spark.createDataFrame(pairs, PAIRS)))
    assert sorted((i, *x) for i, b, a in pairs for x in patience.common_rows(text_lines(b), text_lines(a))) == want


@pytest.mark.parametrize("name", ["diff_ranges", "range_labels", "diff_ranges_of_claims", "mirrored_ranges", "patience_counts"])
def test_queries_deal_out_few_rows(spark, name):
    """Only a small table's own rows may be dealt out, before anything is made of them."""
    assert shuffles(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) <= 1
