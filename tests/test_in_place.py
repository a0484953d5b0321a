"""What is worked out where a pair lies equals what joins of all words and nodes find."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import assignment, claims, costs, mapping, matching, ranges, trees
from palimpsest.operators.pairs import line_rows


def frame(spark, seed=1, n=30):
    r = random.Random(seed)
    text = lambda: None if r.random() < 0.1 else "".join(r.choice(["a", "b", "c", "d", " ", " ", "\n", "\n", "\t", "\r\n"]) for _ in range(r.randint(0, 90)))
    rows = [(k, text(), text(), "Text") for k in range(n)] + [(100, "x y", "x y", "Text"), (101, "x  y", "x y", "Text"), (102, "", "z", "Text"), (103, '{"a": [1, 2], "b": 3}', '{"a": [1, 4], "b": 3}', "JSON"), (104, "{", "{}", "JSON")]
    return spark.createDataFrame(rows, "pair_id long, before string, after string, language string")


def test_classes_are_those_of_whole_diffs(spark):
    pairs = frame(spark)
    kind = F.when(F.col("summary").isin("NoChanges", "WhitespaceOnly", "NewFile", "DeletedFile"), F.col("summary"))
    want = ranges.diffs(pairs, matching.Config()).select("pair_id", "fallback", kind.alias("summary"), F.size("before_ops").cast("long").alias("rows_before"), F.size("after_ops").cast("long").alias("rows_after"))
    got = ranges.classes(pairs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_similar_lines_are_similar_sets_of_words(spark):
    pairs = frame(spark, 2)
    words = lambda side, name: line_rows(pairs, "pair_id", side).select("pair_id", F.col("row").alias(name), F.explode(F.array_distinct(F.split(F.trim("line"), r"\s+"))).alias("word")).where("word <> ''")
    for least in (0.3, 0.5, 1.0):
        want = assignment.similar_sets(words("before", "b_row"), words("after", "a_row"), ["pair_id"], "word", least, ("b_row", "a_row"))
        got = assignment.similar_lines(pairs, least)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_greedy_within_a_key_equals_the_sequence(spark):
    r = random.Random(3)
    rows = [(p, b, a, r.randint(0, 6) / 6) for p in range(8) for b in range(12) for a in range(12) if r.random() < 0.5]
    got = assignment.greedy(spark.createDataFrame(rows + rows[:20], "p int, b int, a int, cost double"), ["p", "b"], ["p", "a"], "cost", 0.9).collect()
    want, used = [], set()
    for p, b, a, c in sorted(rows, key=lambda x: (x[3], x[0], x[1], x[2])):
        if c <= 0.9 and not {(p, "b", b), (p, "a", a)} & used:
            used |= {(p, "b", b), (p, "a", a)}
            want.append((p, b, a, c))
    assert sorted(map(tuple, got)) == sorted(want)


def test_identical_nodes_of_one_path(spark):
    pairs = frame(spark, 4)
    side = lambda s: trees.flatten(pairs, "pair_id", s, "language", ["pre", "size", "path", "full_hash"]).withColumnRenamed("unit_id", "pair_id")
    want = mapping.by_paths(side("before"), side("after")).where("op = 'Identical'").select("pair_id", "b_pre", "a_pre")
    got = mapping.identical_by_paths(pairs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30


def test_roots_stand_for_their_nodes(spark):
    pairs = frame(spark, 6, 40)
    columns = ["pre", "parent_pre", "size", "depth", "n_children", "kind", "ancestors", "full_hash"]
    nodes = lambda s, least: trees.flatten(pairs.where("language = 'Text'"), "pair_id", s, "language", columns, least).withColumnRenamed("unit_id", "pair_id")
    (b, a), (few_b, few_a) = ((nodes("before", k), nodes("after", k)) for k in (1, 2))
    lines = F.col("kind") == "line"
    roots = claims.hash_claims(few_b.where(lines), few_a.where(lines), place="pre").localCheckpoint()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert roots.count() > 10
    assert rows(claims.fixed_points(few_b, roots)) == rows(claims.fixed_points(b, claims.lockstep(roots)))
    assert rows(claims.expanded(few_b, few_a, roots, dice=0.4)) == rows(claims.expanded(b, a, claims.lockstep(roots), dice=0.4))
    both = claims.lockstep(roots).join(few_b.select("pair_id", F.col("pre").alias("b_pre")), ["pair_id", "b_pre"]).select("pair_id", "b_pre", "a_pre")
    assert rows(claims.lockstep_inner(roots, few_b.select("pair_id", "pre", "kind")).select("pair_id", "b_pre", "a_pre")) == rows(both)


def test_costs_run_each_way_once_more_than_timed(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(costs, "_tools", lambda: {"parse": lambda x, y, lang: seen.append(x) or 1})
    run = {}
    df = spark.createDataFrame([(1, "x", "y", "Text")], "pair_id long, before string, after string, language string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: run.update(f=f) or self)
    costs.costs(df, 2, ["parse"])
    out = next(run["f"](iter(df.toArrow().to_batches())))
    assert len(seen) == 3 and out.column("status").to_pylist() == ["ok"] and len(out.column("ms").to_pylist()[0]) == 2


def test_scoped_needs_no_rows_for_words(spark):
    pairs = frame(spark, 8, 12).where("language = 'Text'")
    columns = ["pre", "parent_pre", "sib_idx", "size", "kind", "path", "ancestors", "full_hash"]
    nodes = lambda s, more, least: trees.flatten(pairs, "pair_id", s, "language", columns + more, least).withColumnRenamed("unit_id", "pair_id")
    none = spark.createDataFrame([], "pair_id long, b_pre int, a_pre int")
    found = lambda *x: sorted(map(tuple, claims.scoped(nodes("before", *x), nodes("after", *x), none, F.col("kind") == "line", ordered=False).collect()))
    few, want = found(["child_hashes", "child_sizes"], 2), found([], 1)
    assert few == want and len(want) > 10
