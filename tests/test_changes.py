import json
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import alignment, matching, pairs, parsers, ranges, reports, sampling, ted, trees

BEFORE = 'import os\n\ndef f(a, b):\n    # add\n    return a + b\n\ndef g(x):\n    print("hi", x)\n    return x * 2\n'
AFTER = 'import os\n\ndef g(x):\n    print("hi", x)\n    return x * 3\n\ndef f(a, b, c=0):\n    # add\n    return a + b + c\n'


# ---- sequences


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_subsequences():
    r = random.Random(1)
    for _ in range(1500):
        a, b = (r.choices("abc", k=r.randint(0, 9)) for _ in range(2))
        got = alignment.common_subsequence(a, b, 100)
        assert len(got) == longest(a, b) == len(alignment.weighted_subsequence(len(a), len(b), lambda i, j: float(a[i] == b[j])))
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        edits = len(a) + len(b) - 2 * len(got)
        if a and b and edits:
            assert alignment.common_subsequence(a, b, edits - 1) is None and alignment.common_subsequence(a, b, edits) == got
    assert alignment.common_subsequence([], [1], 0) == []
    assert alignment.increasing_subsequence([3, 1, 2, 2, 5, 4]) in ([1, 2, 4], [1, 2, 5], [1, 3, 5], [1, 3, 4])


def test_line_diffs(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\n", "a\nx\nc\nd"), (2, "", "n\n"), (3, "s\r\nt", "s\nt\n"), (4, None, None), (5, "b\na", "a\nb")], "pair_id long, before string, after string")
    d = alignment.line_diffs(df)
    counts = {r.pair_id: (r.inserted, r.deleted) for r in alignment.count_ops(d).collect()}
    assert counts == {1: (2, 1), 2: (1, 0), 3: (0, 0), 4: (0, 0), 5: (1, 1)}
    rows = {(r.pair_id, r.side, r.row): r.op for r in alignment.labels(d).collect()}
    assert [rows[1, "after", i] for i in range(4)] == ["Identical", "Insert", "Identical", "Insert"] and rows[5, "before", 0] == "Delete"
    over = alignment.line_diffs(df, most=1).where("pair_id = 1").first()
    assert over.over_cap and [x.op for x in over.before_ranges] == ["Delete"] and over.before_ranges[0].last == 3
    same = alignment.labels(d)
    assert alignment.disagreement(same, same).agg(F.sum("differ")).first()[0] == 0


# ---- trees


@pytest.mark.parametrize(
    ("language", "text"),
    [("JSON", '{"a": [1, 2, {"b": null}], "c": "x"}'), ("Python", BEFORE), ("HTML", "<p a=1>x<b>y</b>\n<p>z<br><script>if (a<b) {}</script>"), ("XML", "<a><b c='d'/>t</a>"), ("Text", "one two\n\nthree\r\nfour")],
)
def test_nested_sets(language, text):
    t = trees.build(text, language)
    assert sorted(t.post) == list(range(t.n)) and t.size[0] == t.n
    for i in range(t.n):
        inside = [j for j in range(t.n) if i in t.ancestors(j)]
        assert inside == list(range(i + 1, i + t.size[i])) and all(t.post[j] < t.post[i] for j in inside)
        assert t.widest[i] == max(((len(t.children[j]), j) for j in t.subtree(i)), key=lambda w: (w[0], -t.depth[w[1]], -w[1]))
        kids = [g for g in t.gaps(i)]
        assert len(kids) == len(t.children[i]) + 1
    assert len(set(t.paths())) == t.n


def test_unparsed():
    assert trees.build("{", "JSON") is None and trees.build("def (", "Python") is None and trees.build("<a>", "XML") is None and trees.build("x", "Fortran") is None
    parsers.register("Words", lambda t: parsers.Node("document", 0, len(t)))
    assert trees.build("x", "Words").n == 1
    deep = trees.build("[" * 10_000 + "]" * 10_000, "JSON")
    assert deep.n == 10_001


def test_hashes():
    h = lambda t, lang="JSON": trees.build(t, lang)
    a, b, c = h('{"x": 1, "y": 2}'), h('{"y": 2,  "x": 1}'), h('{"x": 1, "y": 3}')
    assert a.full[0] != b.full[0] and a.value[0] == b.value[0] and a.only[0] == c.only[0] and a.value[0] != c.value[0] and a.structural[0] == c.structural[0]
    assert h("[1,2]").full[0] == h("[1,2]").full[0] != h("[2,1]").full[0]


def test_flatten(spark):
    units = spark.createDataFrame([(1, BEFORE, "Python"), (2, "x", None), (3, "{", "JSON"), (4, None, "Text")], "id long, t string, l string")
    nodes = trees.flatten(units, "id", "t", "l").cache()
    assert {r.unit_id for r in nodes.select("unit_id").distinct().collect()} == {1, 4}
    assert {r.decl_name for r in nodes.where("is_anchor and decl_name is not null").collect()} == {"f", "g"}
    comment = nodes.where("kind = 'comment'").first()
    assert (comment.start_row, comment.start_col, comment.text, comment.in_comment) == (3, 4, "# add", True)
    counted = trees.with_ancestors(nodes, ["size"]).groupBy("unit_id", "a_size").count()
    assert counted.where("unit_id = 1 and a_size = count + 1").count() > 0
    found = trees.enclosing(spark.createDataFrame([(1, 4), (1, 0)], "unit_id long, row int"), nodes)
    assert {(r.row, r.declared_row, r.declared_name) for r in found.collect()} == {(4, 2, "f"), (0, None, None)}
    assert trees.kind_counts(nodes).agg(F.sum("n")).first()[0] == nodes.count()
    dump = reports.tree_dump(nodes).where("unit_id = 1").first().report
    assert dump.startswith("Module\n  Import\n    alias os") or dump.startswith("Module\n  Import\n    alias")
    assert trees.previous_sibling(nodes).where("previous is not null").count() > 0


# ---- edit distance


def test_distance_against_recursion():
    r = random.Random(2)

    def made(depth):
        return r.choice("ab"), r.choice("xy"), [made(depth - 1) for _ in range(r.randint(0, 2))] if depth else []

    def flat(t, acc, kids):
        i = len(acc)
        acc.append(t)
        kids.append(None)
        kids[i] = [flat(c, acc, kids) for c in t[2]]
        return i

    for _ in range(150):
        a, ca, b, cb = [], [], [], []
        flat(made(2), a, ca), flat(made(2), b, cb)
        cost = lambda i, j: ted.change_cost(a[i][0], b[j][0], None if ca[i] else a[i][1], None if cb[j] else b[j][1], "")  # noqa: E731, B023
        d, pairs_ = ted.distance(ted.Forest([0], ca.__getitem__), ted.Forest([0], cb.__getitem__), cost)

        @lru_cache(None)
        def plain(f, g):
            if not f or not g:
                return sum(1 for x in (f or g) for _ in walk(x, ca if f else cb))  # noqa: B023
            x, y = f[-1], g[-1]
            return min(plain(f[:-1] + tuple(ca[x]), g) + 1, plain(f, g[:-1] + tuple(cb[y])) + 1, plain(f[:-1], g[:-1]) + plain(tuple(ca[x]), tuple(cb[y])) + cost(x, y))  # noqa: B023

        def walk(x, kids):
            yield x
            for c in kids[x]:
                yield from walk(c, kids)

        assert d == plain((0,), (0,)) == len(a) + len(b) - 2 * len(pairs_) + sum(cost(i, j) for i, j in pairs_)


# ---- matching


def rows_of(before, after, language="Python", **config):
    m = matching.match(trees.build(before, language), trees.build(after, language), matching.Config(**config))
    return m, list(m.rows())


def test_matching_functions_by_name():
    m, rows = rows_of(BEFORE, AFTER)
    names = {(m.b.name[i], m.a.name[j]) for i, j in m.to_a.items() if m.b.name[i]}
    assert names == {("f", "f"), ("g", "g")}
    assert {m.a.text(r["a_pre"]) for r in rows if r["op"] == "Insert"} <= {"c", "0", "a + b + c", "a + b", "a", "b"}
    assert not [r for r in rows if r["op"] == "Delete"]
    update = next(r for r in rows if r["op"] == "Update")
    assert (m.b.text(update["b_pre"]), m.a.text(update["a_pre"]), update["cost"]) == ("2", "3", 2)


def test_matching_holds():
    r = random.Random(7)
    for _ in range(60):
        words = lambda: "\n".join(" ".join(r.choices("alpha beta gamma delta".split(), k=r.randint(1, 6))) for _ in range(r.randint(0, 8)))
        before, after = words(), words()
        for config in ({}, {"bottom_up": True, "match_imports": True, "match_flow_control": True}, {"exact": False}, {"moved_subtrees": False}):
            m, rows = rows_of(before, after, "Text", **config)
            b, a = [x["b_pre"] for x in rows if x["b_pre"] is not None], [x["a_pre"] for x in rows if x["a_pre"] is not None]
            assert sorted(b) == list(range(m.b.n)) and sorted(a) == list(range(m.a.n))
            assert all(ted.compatible(m.b.kind[i], m.a.kind[j], "Text") for i, j in m.to_a.items())
    _, same = rows_of(BEFORE, BEFORE)
    assert all(x["op"] == "Identical" and x["cost"] == 0 for x in same)


def test_slots_and_context():
    m, rows = rows_of("f(alpha_one, 1)\n", "f(zzz, 1)\n")
    assert {(x["op"], m.b.text(x["b_pre"])) for x in rows if x["op"] == "Update"} == {("Update", "alpha_one")}
    m, rows = rows_of("[1, a, 2]\n", "[1, b, 2]\n")
    assert [x["op"] for x in rows].count("Update") == 1 and not [x for x in rows if x["op"] in ("Insert", "Delete")]
    assert matching.alike("counter", "counters") and not matching.alike("a", "b") and matching.alike("a", "a")


def test_moved_subtree_and_fallback():
    before = "class A:\n    x = [1, 2, 3, 4]\n    y = 2\nclass B:\n    z = f(1)\n"
    after = "class A:\n    y = 2\nclass B:\n    z = f(1)\n    x = [1, 2, 3, 4]\n"
    m, _ = rows_of(before, after)
    assert "MovedSubtree" in {w.reason for w in m.why.values()}
    m, _ = rows_of(before, after, moved_subtrees=False)
    assert "MovedSubtree" not in {w.reason for w in m.why.values()}
    lines = "\n".join(f"w{i}" for i in range(6000))
    m, rows = rows_of(lines, lines.replace("w17\n", "new\n"), "Text")
    assert sum(x["op"] != "Identical" for x in rows) < 12


def test_mapping_frames(spark):
    df = spark.createDataFrame([(1, BEFORE, AFTER, "Python"), (2, "a", "b", None), (3, "[1]", "[1]", "JSON")], "pair_id long, before string, after string, language string")
    m = matching.mappings(df).cache()
    t = {r.pair_id: r for r in matching.totals(m).collect()}
    assert set(t) == {1, 3} and t[3].cost == 0 and t[1].inserted >= 3 and t[1].updated >= 1
    assert matching.violations(m).count() == 0
    assert {r.status for r in matching.measured(df).collect()} == {"ok", "no_tree"}
    assert matching.measured(df, matching.Config(max_nodes=3)).where("pair_id = 3").first().status == "skipped_too_large"
    again = matching.mappings(df.repartition(3))
    assert matching.path_differences(m, again).count() == 0
    assert sum(r.n for r in matching.reasons(m).collect()) == sum(r.a_pre is not None and r.b_pre is not None for r in m.collect())
    truth = [
        (1, "match_but_not_identical", "Module/FunctionDef[0]", "Module/FunctionDef[1]"), (1, "identical", "Module/Import[0]", "Module/Import[0]"),
        (1, "delete", "Module/FunctionDef[0]", None), (1, "insert", None, "Module/FunctionDef[1]/arguments[0]/arg[2]"), (1, "delete_with_children", "Module/FunctionDef[1]", None),
    ]
    got = matching.mismatches(m, spark.createDataFrame(truth, "pair_id long, operation string, before_path string, after_path string")).first()
    assert (got.entries, got.mismatches) == (5, 2)


# ---- ranges


def test_a_pair_with_many_nodes_is_compared_by_trees():
    text = "x = 1\n" * 4 + "y = 2\n"
    d = ranges.diff_pair(text, text.replace("y = 2", "y = 3"), "Python", matching.Config(max_nodes=3))
    assert not d["fallback"] and d["updated"] == 1


def test_large_groups_of_one_name_match():
    page = lambda word: "<html><body><article>" + "".join(f"<p><b>k{i}</b><i>{word}{i}</i></p>" for i in range(101)) + "</article></body></html>"
    m = matching.Matching(trees.build(page("old"), "HTML"), trees.build(page("new"), "HTML"), matching.Config())
    m.phase_names()
    assert sum(w.reason == "QualifiedName" and m.b.kind[i] == m.a.kind[j] for (i, j), w in m.why.items()) >= 101


def test_diff_pairs(spark):
    rows = [
        (1, BEFORE, AFTER, "Python"), (2, "x = 1\n", "x = 1\n", "Python"), (3, "x=1\n", "x = 1\n", "Python"), (4, "", "x = 1\n", "Python"), (5, "x = 1\n", None, "Python"),
        (6, "x = 1  # a\n", "x = 1  # b\n", "Python"), (7, "if a:\n  b()\n", "if a:\n    b()\n\n", "Python"), (8, "a\nb\nc\n", "a\nc\nd\n", None), (9, "(", "[", "Python"),
        (10, "def f():\n  b(1)\nx = f\n", "class A:\n    def f():\n        b(1)\nx = f\n", "Python"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, before string, after string, language string")
    got = {r.pair_id: r for r in ranges.diffs(df).collect()}
    assert [got[i].summary for i in range(1, 8)] == [None, "NoChanges", "WhitespaceOnly", "NewFile", "DeletedFile", "CommentOnly", "WhitespaceOnly"]
    assert not got[1].fallback and got[8].fallback and got[9].fallback
    assert (got[8].before_ops, got[8].after_ops) == (["Identical", "Delete", "Identical", "Identical"], ["Identical", "Identical", "Insert", "Identical"])
    assert "~     return x * 3" in got[1].report or "~     return x * 2" in got[1].report
    assert got[2].report == "No changes - files are identical\n      ... 2 unchanged lines ...\n      ... 2 unchanged lines ...\n"
    doc = json.loads(got[1].json)
    assert not doc["fallback_used"] and {"operation", "start", "end"} <= set(doc["after"]["hunks"][0]) and "summary" not in doc
    assert json.loads(got[2].json)["summary"] == "No changes - files are identical"
    assert got[10].moved > 0 or got[10].inserted > 0


def test_report_context():
    text = "def f():\n" + "".join(f"    a{i} = {i}\n" for i in range(12)) + "    z = 0\n"
    d = ranges.diff_pair(text, text.replace("z = 0", "z = 1"), "Python", matching.Config())
    assert "      ... 10 unchanged lines ...\n    @ def f():\n" in d["report"] and "~     z = 0\n" in d["report"] and "~     z = 1\n" in d["report"]
    coloured = ranges.diff_pair("a\n", "b\n", None, matching.Config(), colour=True)["report"]
    assert "\x1b[31m- a\x1b[0m\n" in coloured and "\x1b[32m+ b\x1b[0m\n" in coloured


def test_range_columns(spark):
    p = lambda r, c: ranges.point(F.lit(r), F.lit(c))
    rg = lambda a, b, c, d: F.struct(p(a, b).alias("start"), p(c, d).alias("end"))
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(ranges.intersects(rg(0, 0, 1, 0), rg(0, 5, 2, 0))) and not one(ranges.intersects(rg(0, 0, 1, 0), rg(1, 0, 2, 0))) and one(ranges.intersects(rg(1, 1, 1, 1), rg(1, 1, 1, 1)))
    assert one(ranges.extends(rg(1, 0, 2, 0), rg(0, 0, 1, 0))) and one(ranges.empty(ranges.right_limit(rg(0, 0, 1, 3))))
    text = F.lit("é\nab \n c")
    assert one(ranges.byte_offset(text, p(1, 1))) == 4 and one(ranges.byte_offset(text, p(9, 9))) == 9 and one(ranges.row_widths(text)) == [1, 3, 2]
    assert one(ranges.touch(text, rg(1, 0, 1, 2), rg(2, 1, 2, 2))) and not one(ranges.touch(text, rg(0, 0, 0, 2), rg(2, 1, 2, 2))) and not one(ranges.touch(text, rg(1, 0, 1, 2), rg(1, 1, 1, 2)))
    assert tuple(one(ranges.normalised_end(p(1, 3), ranges.row_widths(text)))) == (2, 0) and tuple(one(ranges.whole_row(F.lit(4))).end) == (5, 0)


# ---- pairs and samples


def test_pairs_without_sides(spark):
    df = spark.createDataFrame([(0, "a\nb\na"), (1, "a\nc"), (2, "x"), (5, "y"), (6, None), (7, None)], "id long, t string")
    got = pairs.neighbours(df, "id", "t").cache()
    assert {r.pair_id for r in got.collect()} == {0, 2, 4, 6}
    changes = {r.pair_id: (r.deleted, r.inserted) for r in pairs.multiset_changes(got).collect()}
    assert changes == {0: (2, 1), 2: (1, 0), 4: (0, 1), 6: (0, 0)}
    assert [(r.before_row, r.after_row) for r in pairs.fifo_matches(got).collect()] == [(0, 0)]
    assert pairs.unique_matches(got).count() == 0
    assert {r.pair_id: round(r.jaccard, 3) for r in pairs.line_similarity(got).collect()} == {0: 0.333, 2: 0.0, 4: 0.0, 6: 0.0}


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(60)], "id long, s string, v int")
    a = sorted(r.id for r in sampling.stratified(df, ["s"], ["id"], 5).collect())
    assert a == sorted(r.id for r in sampling.stratified(df.repartition(7), ["s"], ["id"], 5).collect()) and len(a) == 10
    new = sampling.refill(df, df.where("id < 6"), "s", ["id"], 8).collect()
    assert len(new) == 10 and min(r.id for r in new) >= 6
    up = sampling.upsert(df.where("id < 3"), spark.createDataFrame([(1, "z", 9), (70, "y", 1)], df.schema), ["id"]).collect()
    assert sorted((r.id, r.s) for r in up) == [(0, "a"), (1, "z"), (2, "a"), (70, "y")]
    assert sampling.latest(df, ["s"], ["v", "id"]).count() == 2
    diff = {(r.v, r.side) for r in sampling.differences(df.where("v < 2"), df.where("v > 0"), ["v"]).collect()}
    assert diff == {(0, "left"), (2, "right")}
    other = {r.s: r.n for r in sampling.top_and_other(df.withColumn("s", F.col("id").cast("string")), "s", 2).collect()}
    assert other["Other"] == 58 and len(other) == 3


def test_edit_distance_is_the_least_of_all(monkeypatch):
    """Against a search through all ways to delete, insert and change, on random trees."""
    import functools
    import random

    r = random.Random(4)

    def tree(n):
        children = {i: [] for i in range(n)}
        for i in range(1, n):
            children[r.randrange(i)].append(i)
        return children, [r.choice("abc") for _ in range(n)]

    for _ in range(150):
        (x, la), (y, lb) = tree(r.randint(1, 6)), tree(r.randint(1, 6))
        change = lambda i, j: 0 if la[i] == lb[j] else 1.5  # noqa: B023, E731

        @functools.cache
        def least(f, g):
            if not f or not g:
                return sum(1 + least(tuple(x[i]), ()) for i in f) + sum(1 + least((), tuple(y[j])) for j in g)  # noqa: B023
            i, j = f[-1], g[-1]
            return min(
                least((*f[:-1], *x[i]), g) + 1,  # noqa: B023
                least(f, (*g[:-1], *y[j])) + 1,  # noqa: B023
                least(f[:-1], g[:-1]) + least(tuple(x[i]), tuple(y[j])) + change(i, j),  # noqa: B023
            )

        found, pairs = ted.distance(ted.Forest([0], x.__getitem__), ted.Forest([0], y.__getitem__), change)
        assert found == least((0,), (0,))
        assert found == sum(change(i, j) for i, j in pairs) + len(la) + len(lb) - 2 * len(pairs)


def test_large_forests_are_matched_by_edit_distance():
    page = lambda words: "<div>" + "".join(f"<span>{w} {k}</span>" for k, w in enumerate(words)) + "</div>"
    b, a = trees.build(page(["left"] * 40), "HTML"), trees.build(page(["right"] * 41), "HTML")
    m = matching.match(b, a, matching.Config(exact=True))
    assert len(m.to_a) >= b.n - 2
