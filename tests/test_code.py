"""Trees of languages of braces."""

import random

import pytest

from palimpsest.functions.languages import BRACES
from palimpsest.operators import matching, trees

JAVA = 'package a.b;\nimport java.util.List;\n\n// one\npublic class Shop {\n  private int n = 3;\n\n  int total(List<Integer> xs) {\n    if (xs == null) { return 0; }\n    log.warn("empty {");\n    return sum(xs, n);\n  }\n}\n'
GO = 'package main\n\nimport "fmt"\n\nfunc add(a, b int) int {\n\tx := a +\n\t\tb\n\treturn x\n}\n\nvar s = `raw {\n`\n'
RUST = "use std::io;\n\nfn longest<'a>(x: &'a str) -> &'a str {\n    println!(\"{}\", x);\n    let c = '{';\n    x\n}\n"
JS = "import x from 'y'\nconst f = (a) => {\n  return a.b.c('q{', `t${a}`)\n}\nfunction g() { /* } */ }\n"


def named(text, language):
    t = trees.build(text, language)
    return t, [(t.kind[i], t.name[i]) for i in range(t.n) if t.name[i]]


def test_declarations_and_statements():
    t, names = named(JAVA, "Java")
    assert names == [("declaration", "Shop"), ("function", "total")]
    kinds = [t.kind[c] for c in t.children[0]]
    assert kinds == ["statement", "import", "comment", "declaration"] or kinds == ["import", "import", "comment", "declaration"]
    calls = [t.text_all[t.start[i] : t.end[i]] for i in range(t.n) if t.kind[i] == "call"]
    assert 'log.warn("empty {")' in calls and "sum(xs, n)" in calls
    assert "if_statement" in t.kind and "return_statement" in t.kind
    assert named(GO, "Go")[1] == [("function", "add")]
    g = trees.build(GO, "Go")
    assert [g.text_all[g.start[i] : g.end[i]] for i in range(g.n) if g.kind[i] == "statement"][0] == "x := a +\n\t\tb"
    assert named(RUST, "Rust")[1] == [("function", "longest")]
    assert named(JS, "JavaScript")[1] == [("function", "g")]


@pytest.mark.parametrize("language", BRACES)
def test_trees_are_nested_sets_of_places(language):
    for text in (JAVA, GO, RUST, JS, "", "a", ";;;", "f(", "}", "/*", '"', "{}" * 2000, "a.b().c()(d)[e]{f}"):
        t = trees.build(text, language)
        if t is None:
            continue
        for i in range(1, t.n):
            p = t.parent[i]
            assert t.start[p] <= t.start[i] <= t.end[i] <= t.end[p]
        assert t.size[0] == t.n
        for kids in t.children:
            assert all(t.end[a] <= t.start[b] for a, b in zip(kids, kids[1:], strict=False))


def test_unbalanced_texts_have_no_tree():
    assert trees.build("int f() { return 1;", "C") is None and trees.build("a) b", "Java") is None
    assert trees.build("{" * 50_000 + "}" * 50_000, "C") is not None


def test_any_text_is_read_in_a_moment():
    r = random.Random(1)
    for _ in range(300):
        trees.build("".join(r.choices(list("ab1 \n\t{}()[];,.'\"`/*#@+-=<>\\é"), k=60)), r.choice(BRACES))
    assert trees.build("x = \"" + "a\\" * 200_000, "Java") is not None


def test_edits_of_code_are_matched():
    after = JAVA.replace("return 0;", "return -1;").replace("int n = 3", "int n = 4").replace("total", "sumUp")
    m = matching.match(trees.build(JAVA, "Java"), trees.build(after, "Java"))
    ops = [r["op"] for r in m.rows()]
    assert ops.count("Update") >= 2 and ops.count("Identical") > 15 and "Delete" not in ops and "Insert" not in ops
    same = matching.match(trees.build(JAVA, "Java"), trees.build(JAVA, "Java"))
    assert {r["op"] for r in same.rows()} == {"Identical"}
