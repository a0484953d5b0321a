"""Trees of plain texts as arrays, and node rows without leaves."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import trees
from palimpsest.operators.parsers import parse_text

ODD = ["", " ", "\n", "\n\n\n", "a", "a b", " a  b\t\n", "a\r\n\r\nb\r\r\nc\r", "x\n\ny z\n \n\x0b\nw", "é à ü　z\n\U0001f600 k\n\x1cq\x85r", "one\rtwo\n\r\n three\n\n", "a\n" * 5, "\r", "b \r\r\n\x0c\r\nc"]


def texts():
    r = random.Random(5)
    return ODD + ["".join(r.choice("ab \n\r\t é") for _ in range(r.randint(0, 80))) for _ in range(300)]


def test_arrays_are_the_tree_of_the_parser():
    for text in texts():
        t, want = trees.build(text, "Text"), trees.Tree(text, parse_text(text), "Text")
        assert isinstance(t, trees.TextTree)
        for name in ("n", "kind", "start", "end", "parent", "sib", "depth", "children", "size", "name", "post", "widest", "anchor", "comment", "full", "structural", "value", "only"):
            assert getattr(t, name) == getattr(want, name), (name, text)
        assert t.paths() == want.paths() and [t.text(i) for i in range(t.n)] == [want.text(i) for i in range(t.n)]
        whole, outline = trees._columns(want), trees.Outline(text).columns()
        keep = [i for i in range(want.n) if want.kind[i] != "word"]
        for column in outline:
            assert outline[column]() == [list(whole[column]())[i] for i in keep], (column, text)


@pytest.mark.parametrize("least", [2, 4])
def test_nodes_without_small_subtrees_are_those_of_all_nodes(spark, least):
    rows = [(i, x, "Text") for i, x in enumerate(ODD)] + [(100, '{"a": [1, 2, {"b": null}], "c": "d"}', "JSON")]
    units = spark.createDataFrame(rows, "u long, t string, l string")
    columns = ["pre", "parent_pre", "size", "n_children", "kind", "path", "full_hash", "ancestors", "leaf_runs", "child_hashes", "child_sizes"]
    got = trees.flatten(units, "u", "t", "l", columns, least).collect()
    want = trees.flatten(units, "u", "t", "l", columns).where(F.col("size") >= least).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


def test_a_large_text_is_parsed_without_an_object_for_each_word():
    import tracemalloc

    text = "some words of a line\n" * 20_000
    tracemalloc.start()
    try:
        n = trees.build(text, "Text", False).n
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2 + 6 * 20_000 and peak < 20e6
