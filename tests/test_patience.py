"""Distributed line diffs and projected ranges against plain versions."""

import random

import pytest
from pyspark.sql import functions as F
from test_claims import texts

from palimpsest.operators import alignment, claims, mapping, patience, spans, trees
from palimpsest.operators.alignment import common_subsequence, text_lines
from palimpsest.operators.matching import Matching
from palimpsest.operators.ranges import pieces, project
from palimpsest.operators.trees import build

PAIRS = "pair_id long, before string, after string"


def plain_chain(anchors):
    """The most anchors in the same order, by dynamic programming."""
    best = [1] * len(anchors)
    for i, (_, a) in enumerate(anchors):
        best[i] = 1 + max((best[j] for j in range(i) if anchors[j][1] < a), default=0)
    return max(best, default=0)


def test_heaviest_chain():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(0, 9)
        runs = [(10 * i, a, r.randint(1, 4)) for i, a in enumerate(r.sample(range(50), n))]
        got = patience.heaviest(runs)
        assert all(runs[x][1] < runs[y][1] for x, y in zip(got, got[1:])) and got == sorted(got)
        best = [0] * n
        for i in range(n):
            best[i] = runs[i][2] + max((best[j] for j in range(i) if runs[j][1] < runs[i][1]), default=0)
        assert sum(runs[i][2] for i in got) == max(best, default=0)


def test_alignment_in_linear_space(monkeypatch):
    r = random.Random(9)
    for _ in range(400):
        x, y = ("".join(r.choices("abcd", k=r.randint(0, 30))) for _ in range(2))
        direct, rows = common_subsequence(x, y, 10**6), alignment.halved(x, y)
        assert valid(rows, x, y) and len(rows) == len(direct)
        edits = len(x) + len(y) - 2 * len(direct)
        assert common_subsequence(x, y, edits) == direct and (not edits or not x or not y or common_subsequence(x, y, edits - 1) is None)
        monkeypatch.setattr(alignment, "DIRECT", 3)
        assert len(common_subsequence(x, y, 10**6)) == len(direct) and (edits < 5 or not x or not y or common_subsequence(x, y, edits - 1) is None)
        monkeypatch.undo()


def valid(rows, b, a):
    rows = sorted(rows)
    return all(b[i] == a[j] for i, j in rows) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(rows, rows[1:]))


def test_matched_rows_are_a_common_subsequence(spark):
    r = random.Random(7)
    pairs = texts(5, 25)
    for i in range(30):  # few distinct lines: many gaps without anchors
        side = lambda: "\n".join(r.choices("ab", k=r.randint(0, 8)) + [f"u{r.randint(0, 6)}" for _ in range(r.randint(0, 6))])
        pairs.append((100 + i, side(), side()))
    pairs += [(200, None, "a"), (201, "a", None), (202, None, None), (203, "x\n" * 500, "x\n" * 400), (204, "", "")]
    df = spark.createDataFrame(pairs, PAIRS).repartition(3)
    got = {}
    for x in patience.matched_rows(df).collect():
        got.setdefault(x.pair_id, []).append((x.before_row, x.after_row))
    counts = {x.pair_id: (x.inserted, x.deleted) for x in patience.counts(df).collect()}
    assert len(counts) == len(pairs)
    optimal = 0
    for i, before, after in pairs:
        b, a = text_lines(before or ""), text_lines(after or "")
        rows = got.get(i, [])
        assert valid(rows, b, a) and counts[i] == (len(a) - len(rows), len(b) - len(rows))
        best = len(common_subsequence(b, a, 10**6))
        assert len(rows) <= best
        optimal += len(rows) == best
        once = [(b.index(x), a.index(x)) for x in sorted(set(b) & set(a), key=b.index) if b.count(x) == 1 == a.count(x)]
        assert len(rows) >= plain_chain(once)
        if len(set(b)) == len(b) and len(set(a)) == len(a):
            assert len(rows) == best  # then nothing but anchors can match
    assert optimal > 0.8 * len(pairs)
    assert len(got[203]) == 400


def test_a_large_file_is_split(spark):
    """Hundred thousands of lines with scattered edits; as a longest common subsequence over the whole, some 20,000 edits would be over the cap."""
    n = 200_000
    lines = [f"line {i}" if i % 3 else "same" for i in range(n)]
    after = [x for i, x in enumerate(lines) if i % 23 != 5]
    for i in range(0, len(after), 31):
        after[i] = f"new {i}"
    df = spark.createDataFrame([(1, "\n".join(lines), "\n".join(after))], PAIRS)
    row = patience.counts(df).first()
    kept = len(after) - len(range(0, len(after), 31))
    assert row.deleted == n - kept and row.inserted == len(after) - kept


def word_mapping(spark, rows):
    """Nodes and pieces of both sides of pairs of texts."""
    out = []
    for k in (1, 2):
        units = spark.createDataFrame([(r[0], r[k], "Text") for r in rows], "pair_id long, t string, language string")
        nodes = trees.flatten(units, "pair_id", "t", "language", ["pre", "size", "start", "path", "full_hash"]).withColumnRenamed("unit_id", "pair_id").cache()
        out += [nodes, spans.text_pieces(units, "pair_id", "t", "language")]
    return out


@pytest.mark.parametrize("how", ["paths", "claims"])
def test_ranges_against_the_walk_over_one_pair(spark, how):
    rows = texts(11, 20) + [(100, "", "a b"), (101, "a  b\n\n c", "a b\n\n  c"), (102, "x", "")]
    b, pb, a, pa = word_mapping(spark, rows)
    met = mapping.by_paths(b, a).select("pair_id", "b_pre", "a_pre") if how == "paths" else claims.lockstep(claims.hash_claims(b, a))
    met = met.where("b_pre is not null and a_pre is not null").cache()
    partner = {}
    for x in met.collect():
        partner.setdefault(x.pair_id, {})[x.b_pre] = x.a_pre
    got = {}
    for x in spans.projected(pb, pa, met).collect():
        got.setdefault((x.pair_id, x.side), []).append((x.number, x.start, x.finish, x.to_start, x.to_finish, x.op))
    ops = set()
    for i, before, after in rows:
        m = Matching.__new__(Matching)
        m.b, m.a = build(before, "Text", False), build(after, "Text", False)
        m.to_a = partner.get(i, {})
        m.to_b = {y: x for x, y in m.to_a.items()}
        for side in ("before", "after"):
            want = [(n, *s) for n, s in enumerate(project(m, side))]
            assert sorted(got.get((i, side), [])) == want, (i, side)
            ops |= {s[-1] for s in want}
    assert ops >= ({"Identical", "Move", "Update", "Insert", "Delete"} if how == "paths" else {"Identical", "Insert", "Delete"})


def test_mirrored_inserts(spark):
    rows = texts(13, 20)
    b, pb, a, pa = word_mapping(spark, rows)
    spread = spans.projected(pb, pa, claims.lockstep(claims.hash_claims(b, a))).cache()
    plain = {}
    for x in sorted(spread.collect(), key=lambda x: x.number):
        plain.setdefault((x.pair_id, x.side), []).append((x.start, x.finish, x.to_start, x.to_finish, x.op))
    got = {}
    for x in sorted(spans.mirrored(spread).collect(), key=lambda x: x.number):
        got.setdefault((x.pair_id, x.side), []).append((x.number, (x.start, x.finish, x.to_start, x.to_finish, x.op)))
    shown = 0
    for i, _, _ in rows:
        own, theirs, want, j = plain.get((i, "before"), []), plain.get((i, "after"), []), [], 0
        for s in own:
            while j < len(theirs) and theirs[j][4] == "Insert":
                want.append((theirs[j][2], theirs[j][3], theirs[j][0], theirs[j][1], "Delete"))
                j, shown = j + 1, shown + 1
            want.append(s)
            j += 1
        assert got.get((i, "before"), []) == list(enumerate(want))
        assert [s for _, s in got.get((i, "after"), [])] == theirs
    assert shown > 10


def test_row_labels(spark):
    rows = texts(17, 20)
    b, pb, a, pa = word_mapping(spark, rows)
    spread = spans.projected(pb, pa, mapping.by_paths(b, a).select("pair_id", "b_pre", "a_pre")).cache()
    lines, want = [], {}
    by = {}
    for x in spread.collect():
        by.setdefault((x.pair_id, x.side), []).append(x)
    for i, before, after in rows:
        for side, text in (("before", before), ("after", after)):
            at = 0
            for row, line in enumerate(text.split("\n")):
                lines.append((i, side, row, at, at + len(line)))
                touching = [s for s in by.get((i, side), []) if s.op != "Identical" and s.finish > s.start and s.start < at + len(line) + 1 and s.finish > at]
                want[i, side, row] = max(touching, key=lambda s: s.number).op if touching else "Identical"
                at += len(line) + 1
    df = spark.createDataFrame(lines, "pair_id long, side string, row int, start int, finish int")
    assert {(x.pair_id, x.side, x.row): x.op for x in spans.row_labels(spread, df).collect()} == want
    assert pieces(build("a b", "Text", False))
