"""Entries that people made, small helpers, and questions to pairs of trees."""

from pyspark.sql import functions as F

from palimpsest.functions import languages as L
from palimpsest.functions import stats
from palimpsest.functions import text as T
from palimpsest.operators import annotations as A
from palimpsest.operators import mapping, matching, trees


def nodes(spark, text, pair=0):
    df = spark.createDataFrame([(pair, text, "Text")], "pair_id long, t string, l string")
    return trees.flatten(df, "pair_id", "t", "l").withColumnRenamed("unit_id", "pair_id")


def test_statuses_costs_and_rows(spark):
    b, a = nodes(spark, "one two\nthree\n\nfour five"), nodes(spark, "one 2\nthree\n\nsix")
    entries = spark.createDataFrame(
        [
            (0, "match_but_not_identical", "document", "document"),
            (0, "update", "document/block[0]/line[0]/word[1]", "document/block[0]/line[0]/word[1]"),
            (0, "delete_with_children", "document/block[1]", None),
            (0, "insert_with_children", None, "document/block[1]"),
        ],
        "pair_id long, operation string, before_path string, after_path string",
    )
    s = A.flags(A.statuses(b, entries, "before"))
    got = {r.path: (r.operation, r.inherited, r.identical, r.moved) for r in s.collect()}
    assert got["document/block[1]/line[0]/word[0]"] == ("delete_with_children", True, False, False)
    assert got["document/block[1]"] == ("delete_with_children", False, False, False)
    assert got["document/block[0]"] == (None, False, True, False)
    assert A.cost(entries, b, a).first().cost == 1 + 4 + 3
    assert sorted(r.row for r in A.touched_rows(b, s).collect()) == [0, 3]
    m = mapping.by_paths(b, a)
    found = A.disagreements(s, m, "before")
    assert {r.path for r in found.collect()} == {"document/block[1]", "document/block[1]/line[0]", "document/block[1]/line[0]/word[0]"}
    first = A.next_disagreement(found, spark.createDataFrame([(0, 0), (0, 99)], "pair_id long, pre int"))
    assert {r.pre: r.next for r in first.collect()}[0] == {r.pre: r.next for r in first.collect()}[99] == found.agg(F.min("pre")).first()[0]
    again = A.disagreements(A.statuses(b, A.from_mapping(m), "before"), m, "before")
    assert again.count() == 0
    assert [r.line for r in A.dump(m).orderBy("place").limit(1).collect()] == ["MatchButNotIdentical document -> document"]


def test_worklist(spark):
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", None), ("d", 3)], "name string, n int")
    assert [r.name for r in A.worklist(df, "name", "n").collect()] == ["b", "d", "a", "c"]
    assert [r.name for r in A.worklist(df, "name", "n", hide_solved=True).collect()] == ["b", "d", "c"]


def test_a_mapping_does_not_depend_on_partitions(spark):
    pairs = spark.createDataFrame([(i, f"a b c\nd e {i}\n\nx y z", f"a b\nd e {i + 1}\n\nx y", "Text") for i in range(40)], "pair_id long, before string, after string, language string")
    one, many = (matching.mappings(pairs.repartition(n)) for n in (1, 13))
    assert matching.path_differences(one, many).count() == 0 and one.count() > 0


def test_paused_matching(spark):
    pairs = spark.createDataFrame([(1, '{"k": 1, "l": [2, 3]}', '{"k": 2, "l": [2, 4, 5]}', "JSON")], "pair_id long, before string, after string, language string")
    early, late = matching.mappings(pairs, matching.Config(paused=True)), matching.mappings(pairs)
    n = lambda m: m.where("b_pre is not null and a_pre is not null").count()
    assert 0 < n(early) < n(late)


def test_small_helpers(spark):
    df = spark.createDataFrame([("Kotlin", "", "  x ", "APTED:move", 0, 2.0)], "l string, t string, x string, r string, zero int, v double")
    r = df.select(
        L.has_local_names(F.col("l")).alias("a"), L.extension_of(F.col("l")).alias("b"), L.is_string(F.lit("string")).alias("c"),
        L.with_other_language(F.lit("Unknown"), F.col("t"), F.lit("Go")).alias("d"), T.trimmed(F.col("x")).alias("e"), T.trimmed(F.lit(" ")).alias("f"), T.shown_reason(F.col("r")).alias("g"),
        stats.in_order(F.lit("b"), ["a", "b"]).alias("h"), stats.in_order(F.lit("z"), ["a", "b"]).alias("i"),
    ).first()
    assert tuple(r) == (True, "kt", True, "Go", "x", None, "APTED (move)", 2, 3)
    assert stats.active(df, ["zero", "v"]) == ["v"]
    b, a = nodes(spark, "one"), nodes(spark, "one\ntwo")
    keys = spark.createDataFrame([(0, "document/block[0]/line[1]"), (0, "document"), (0, "none")], "pair_id long, path string")
    got = {r.path: r.node and r.node.kind for r in trees.in_any(keys, b, a, ["pair_id", "path"]).collect()}
    assert got == {"document/block[0]/line[1]": "line", "document": "document", "none": None}


def test_identical_entries_leave_people_s_alone(spark):
    units = lambda t: trees.flatten(spark.createDataFrame([(0, t, "Text")], "pair_id long, t string, l string"), "pair_id", "t", "l", ["pre", "size", "start", "path", "full_hash"]).withColumnRenamed("unit_id", "pair_id")
    b, a = units("a b\nc d\n\ne f"), units("e f\n\na b\nc x")
    found = lambda *more: {(r.before_path, r.after_path) for r in A.identical_entries(b, a, *more).collect()}
    every = found()
    assert ("document/block[1]", "document/block[0]") in every and ("document/block[0]/line[0]/word[1]", "document/block[1]/line[0]/word[1]") in every
    mine = spark.createDataFrame([(0, "update", "document/block[1]/line[0]/word[0]", "document/block[1]/line[0]/word[0]")], "pair_id long, operation string, before_path string, after_path string")
    left = found(mine)
    named = {"document/block[1]", "document/block[1]/line[0]", "document/block[1]/line[0]/word[0]"}
    assert left and not any(x in named for x, _ in left) and ("document/block[1]/line[0]/word[1]", "document/block[0]/line[0]/word[1]") in left
