"""Names in scopes and arms of branches against Python's own symbol tables and plain versions."""

import ast

from pyspark.sql import functions as F

from palimpsest.operators import branches, trees

SOURCE = """
import os
top = 1
def f(a, b: int = 2, *args, c, **kw):
    x = y = a
    x += 1
    def g(a):
        x = a
        return x
    class K:
        z = 0
        def h(self, a):
            self.q = a
            w: int = 3
            return lambda v: v
    for i in range(3):
        t = i
    return x
async def k(p):
    if (n := p):
        m = n
"""
CODE = """
def f(x, y):
    match x:
        case 1: pass
        case [a, *_] if a > 2: pass
        case {"k": v}: pass
        case str() | bytes(): pass
        case _: pass
    if x == 1:
        pass
    elif y:
        if x is None:
            pass
        elif x: pass
    elif f(x, y) and \\
            y: pass
    else:
        if y < 2: pass
"""


def nodes_of(spark, rows):
    units = spark.createDataFrame([(i, t, "Python") for i, t in rows], "unit_id long, contents string, language string")
    return trees.flatten(units, "unit_id", "contents", "language", branches.COLUMNS), units


def plain_names(source):
    """(scope's name, bucket, name, how often) by walking Python's own tree."""
    out = {}

    def walk(n, scope):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            scope = getattr(n, "name", "lambda")
        names = []
        if isinstance(n, ast.arg):
            names = [("parameter", n.arg)]
        elif isinstance(n, ast.Assign):
            names = [("assignment", t.id) for t in n.targets if isinstance(t, ast.Name)]
        elif isinstance(n, (ast.AugAssign, ast.AnnAssign, ast.NamedExpr)) and isinstance(n.target, ast.Name):
            names = [("assignment", n.target.id)]
        for x in names:
            out[(scope, *x)] = out.get((scope, *x), 0) + 1
        for c in ast.iter_child_nodes(n):
            walk(c, scope)

    walk(ast.parse(source), "<module>")
    return out


def test_names_by_their_innermost_scope(spark):
    nodes, _ = nodes_of(spark, [(1, SOURCE), (2, ""), (3, "x = 1\n")])
    groups = branches.name_groups(branches.local_names(nodes))
    names = nodes.join(trees.flatten(spark.createDataFrame([(1, SOURCE, "Python"), (3, "x = 1\n", "Python")], "u long, t string, l string"), "u", "t", "l", ["pre", "decl_name"]).select("unit_id", "pre", "decl_name"), ["unit_id", "pre"])
    scope = names.select("unit_id", F.col("pre").alias("scope"), F.coalesce("decl_name", F.when(F.col("kind") == "Lambda", "lambda").otherwise("<module>")).alias("s"))
    got = {(r.unit_id, r.s, r.bucket, r["name"]): len(r.pres) for r in groups.join(scope, ["unit_id", "scope"]).collect()}
    assert {k[1:]: n for k, n in got.items() if k[0] == 1} == plain_names(SOURCE)
    assert {k[1:]: n for k, n in got.items() if k[0] == 3} == {("<module>", "assignment", "x"): 1}


def test_unique_names_of_partners(spark):
    b, _ = nodes_of(spark, [(1, "def f(a, b):\n    x = a\n    y = 1\n    y = 2\n")])
    a, _ = nodes_of(spark, [(1, "import os\ndef f(b, q):\n    x = b\n    y = 3\n")])
    side = lambda n: branches.name_groups(branches.local_names(n)).withColumnRenamed("unit_id", "pair_id")
    at = lambda n, k: n.where(f"kind = '{k}'").first().pre
    scopes = spark.createDataFrame([(1, at(b, "FunctionDef"), at(a, "FunctionDef"))], "pair_id long, b_pre int, a_pre int")
    text = lambda n: {r.pre: r.text for r in n.collect()}
    tb, ta = text(b), text(a)
    got = {(tb[r.b_pre], ta[r.a_pre]) for r in branches.unique_names(side(b), side(a), scopes).collect()}
    assert got == {("b", "b"), ("x", "x")}


def test_arms_and_their_signatures(spark):
    nodes, units = nodes_of(spark, [(1, CODE), (2, "x = 1\n")])
    got = {}
    for r in branches.arms(nodes, units, "contents").orderBy("branch", "number").collect():
        got.setdefault((r.family, r.branch), []).append(r.signature)
    lists = sorted(map(repr, got.values()))
    assert lists == sorted(map(repr, [["1", "[a, *_]", '{"k": v}', "str() | bytes()", None], ["x == 1", "y", "f(x, y) and \\\n            y"], ["x is None", "x"], ["y < 2"]]))


def test_branches_are_partners_by_their_arms(spark):
    case = lambda keys: "".join(f"        case {k}: pass\n" for k in keys)
    before = "def f(x):\n    match x:\n" + case([1, 2, 3, 4]) + "    match x:\n" + case([5, 5, 6, "_"]) + "    if x == 1: pass\n"
    after = "def g(x):\n    if x == 1: pass\n    match x:\n" + case([6, 5, 5]) + "    match x:\n" + case([4, 3, 2, 9]) + "    match x:\n" + case([4, 3, 2, 1, 0])
    (b, ub), (a, ua) = nodes_of(spark, [(1, before)]), nodes_of(spark, [(1, after)])
    b, a = (branches.arms(n, u, "contents").withColumnRenamed("unit_id", "pair_id") for n, u in ((b, ub), (a, ua)))
    met = branches.alike_branches(b, a)
    assert sorted((r.family, r.cost) for r in met.collect()) == [("If", 0.0), ("Match", 0.0), ("Match", 0.2)]
    signature = lambda x: {r.arm: r.signature for r in x.collect()}
    sb, sa = signature(b), signature(a)
    pairs = [(sb[r.b_pre], sa[r.a_pre]) for r in branches.matching_arms(b, a, met).collect()]
    assert sorted(x for x, _ in pairs) == ["1", "2", "3", "4", "5", "5", "6", "x == 1"] and all(x == y for x, y in pairs)


def test_written_frames_are_as_large_as_their_own_rows(spark, tmp_path):
    from palimpsest.operators import trees
    from palimpsest.operators.assignment import forget, written

    spark.createDataFrame([(1, "a b\n" * 5000, "Text")], "id long, t string, language string").write.parquet(f"{tmp_path}/units")
    units = spark.read.parquet(f"{tmp_path}/units")
    nodes = trees.flatten(units, "id", "t", "language", ["pre", "path", "kind"])
    kept = written(nodes)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size(kept) > 4 * size(nodes)  # an estimate from the one text would have every join broadcast its nodes
    assert sorted(kept.collect()) == sorted(nodes.collect()) and kept.count() > 15000
    forget(kept)


def test_small_units_share_batches(spark):
    from palimpsest.operators import spans, trees

    units = spark.createDataFrame([(i, f"a{i} b\n\nc", "Text") for i in range(3000)] + [(-1, None, "Text"), (-2, "", "Text")], "id long, t string, language string").repartition(1)
    nodes = trees.flatten(units, "id", "t", "language", ["pre", "kind", "size", "ancestors"])
    sizes = nodes.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), nodes.schema).count()
    alone = trees.flatten(units.where("id = 7"), "id", "t", "language", ["pre", "kind", "size", "ancestors"])
    assert sizes < 50 and sorted(nodes.where("unit_id = 7").collect()) == sorted(alone.collect())
    pieces = spans.text_pieces(units, "id", "t", "language").collect()
    assert len(pieces) == 9000 and sorted((r.pre, r.text) for r in pieces if r.id == 7) == sorted((r.pre, r.text) for r in spans.text_pieces(units.where("id = 7"), "id", "t", "language").collect())


def test_functions_are_dealt_to_many_tasks(spark):
    from palimpsest.plans.branch_queries import functions_

    assert functions_(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4  # all of them, as the setting has it; they were one task's
