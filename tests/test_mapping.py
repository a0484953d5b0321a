import random
import subprocess
import sys

from palimpsest.operators import assignment, mapping, matching, trees


def test_greedy_is_the_sequence(spark):
    r = random.Random(5)
    rows = list({(g, b, a): (g, b, a, float(r.randint(0, 6))) for g in range(3) for b in range(12) for a in range(12) if r.random() < 0.4}.values())
    want, used = set(), set()
    for g, b, a, c in sorted(rows, key=lambda x: (x[3], x[0], x[1], x[0], x[2])):
        if c <= 5 and ("b", g, b) not in used and ("a", g, a) not in used:
            used |= {("b", g, b), ("a", g, a)}
            want.add((g, b, a))
    df = spark.createDataFrame(rows, "g int, b int, a int, cost double")
    got = assignment.greedy(df, ["g", "b"], ["g", "a"], "cost", 5)
    assert {(x.g, x.b, x.a) for x in got.collect()} == want
    assert assignment.greedy(df.limit(0), ["g", "b"], ["g", "a"], "cost").count() == 0


def test_similar_sets(spark):
    r = random.Random(6)
    sets = {(s, i): set(r.sample("abcdefghij", r.randint(1, 6))) for s in "ba" for i in range(25)}
    frame = lambda s, name: spark.createDataFrame([(1, i, w) for (k, i), v in sets.items() if k == s for w in v], f"k int, {name} int, w string")
    for least in (0.5, 0.8, 1.0):
        got = {(x.b_id, x.a_id): round(x.jaccard, 6) for x in assignment.similar_sets(frame("b", "b_id"), frame("a", "a_id"), ["k"], "w", least).collect()}
        want = {(i, j): round(len(x & y) / len(x | y), 6) for (s, i), x in sets.items() if s == "b" for (t, j), y in sets.items() if t == "a" if len(x & y) / len(x | y) >= least}
        assert got == want


def test_mapping_questions(spark):
    before = "class A:\n    def f(self):\n        return 1\n    def g(self):\n        return [1, 2, 3]\nx = 1\n"
    after = "class A:\n    def f(self):\n        return 1\n    def h(self, q):\n        for i in q:\n            print(i)\nx = 1\n"
    units = lambda t: spark.createDataFrame([(1, t, "Python")], "id long, t string, l string")
    nodes = lambda t: trees.flatten(units(t), "id", "t", "l").withColumnRenamed("unit_id", "pair_id").cache()
    b, a = nodes(before), nodes(after)
    tb, ta = trees.build(before, "Python"), trees.build(after, "Python")
    found = matching.match(tb, ta)
    m = spark.createDataFrame([(1, x["b_pre"], x["a_pre"], x["op"]) for x in found.rows()], "pair_id long, b_pre int, a_pre int, op string").cache()
    free = {i for i in range(tb.n) if i not in found.to_a}
    assert {x.pre for x in mapping.unmapped(b, m, "b").collect()} == free
    assert {x.pre for x in mapping.topmost_unmapped(b, m, "b").collect()} == {i for i in free if tb.parent[i] in found.to_a}
    assert {x.pre for x in mapping.wholly_unmapped(b, m, "b").collect()} == {i for i in range(tb.n) if all(j in free for j in tb.subtree(i))}
    for x in mapping.shared_descendants(b, a, m).collect():
        inside = [i for i in tb.subtree(x.b_pre) if i != x.b_pre and i in found.to_a and x.a_pre < found.to_a[i] < x.a_pre + ta.size[x.a_pre]]
        assert x.shared == len(inside)
    assert not mapping.router(m).first().expensive
    quiet = mapping.quiet_subtrees(b, m, 0).collect()
    ops = {x["b_pre"]: x["op"] for x in found.rows() if x["b_pre"] is not None}
    still = {i for i in range(tb.n) if all(ops[j] == "Identical" for j in tb.subtree(i))}
    assert {x.pre for x in quiet} == {i for i in still if tb.parent[i] not in still}
    rows = mapping.coarse(m, b, a).collect()
    assert {x.op for x in rows} <= {"Delete", "Insert", "DeleteWithChildren", "InsertWithChildren"} and mapping.coarse_cost(mapping.coarse(m, b, a)).count() == 1
    assert {(x["name"], tuple(x.pres)) for x in mapping.statement_identities(b).collect()} == {(tb.name[i], (i,)) for i in range(tb.n) if tb.name[i]}


def test_command_line(tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("x = 2\n")
    run = lambda *a: subprocess.run([sys.executable, "-m", "palimpsest", *map(str, a)], capture_output=True, text=True)
    assert "~ x = 2\n" in run(tmp_path / "a.py", tmp_path / "b.py").stdout
    assert '"fallback_used": false' in run("--json", tmp_path / "a.py", tmp_path / "b.py").stdout
    assert "~ x = 2\n" in run("b.py", tmp_path / "a.py", "0", "0", tmp_path / "b.py", "0", "0").stdout
    assert run("one").returncode == 2


def test_rows_of_a_pair_meet_with_one_shuffle_of_each_frame(spark):
    from palimpsest.operators.mapping import by_paths, quiet_subtrees

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.range(40).selectExpr("id % 2 as pair_id", "cast(id as int) as pre", "cast(null as int) as parent_pre", "1 as size", "cast(id as string) as path", "id as full_hash")
        shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        m = by_paths(nodes, nodes.where("pre < 30"))
        assert shuffles(m) == 2 and m.count() == 40 and m.where("a_path is null").count() == 10 and m.where("op = 'Identical'").count() == 30
        plan = m._jdf.queryExecution().optimizedPlan().toString()
        assert "AS b_path" not in plan.partition("Join")[2]  # a path is shuffled once for each side
        kept = spark.createDataFrame(m.collect(), m.schema)
        assert {"pair_id"} == {x for x in _shuffled_by(quiet_subtrees(nodes, kept, 0))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _shuffled_by(df):
    import re

    return {re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())}
