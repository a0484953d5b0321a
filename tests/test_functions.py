import math
import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import languages as L
from palimpsest.functions import stats as S
from palimpsest.functions import text as T


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_paths(spark):
    rows = [("a/b/main.rs",), ("before.py.test",), ("x.rs.test.test",), ("foo.test",), ("Makefile",), ("README.md",), ("a.HPP",), ("noext",), (".gitignore",), ("x.tar.gz",), ("a/third_party/x.c",), ("p.toml",)]
    df = spark.createDataFrame(rows, "p string")
    got = {r.p: r for r in df.select("p", L.language(F.col("p")).alias("l"), L.file_type(F.col("p")).alias("t"), L.extension(F.col("p")).alias("e"), L.skipped(F.col("p")).alias("s")).collect()}
    assert [got[p].l for p in ("a/b/main.rs", "before.py.test", "x.rs.test.test", "foo.test", "a.HPP", "noext")] == ["Rust", "Python", "Rust", "Unknown", "CPP", "Unknown"]
    assert tuple(got["Makefile"].t) == ("Code", "Build") and tuple(got["README.md"].t) == ("Documentation", "General") and tuple(got["x.tar.gz"].t) == ("Data", "Archive")
    assert tuple(got[".gitignore"].t) == ("Configuration", "DevEx") and got[".gitignore"].e is None and tuple(got["noext"].t) == ("Unknown", "")
    assert tuple(got["a/b/main.rs"].t) == ("Code", "Uncategorized") and tuple(got["p.toml"].t) == ("Configuration", "")
    assert got["a/third_party/x.c"].s and not got["a/b/main.rs"].s


def test_kinds(spark):
    assert one(spark, L.in_table(F.lit("HTML"), F.lit("element"), L.ANCHORS)) and not one(spark, L.in_table(F.lit("HTML"), F.lit("text"), L.ANCHORS))
    assert not one(spark, L.in_table(F.lit("None"), F.lit("element"), L.ANCHORS))
    ok = lambda a, b: one(spark, L.kinds_compatible(F.lit(a), F.lit(b), F.lit("Python")))
    assert ok("If", "If") and ok("Name", "arg") and ok("Lt", "GtE") and not ok("Lt", "Add") and not ok("Name", "Constant")


def test_lines(spark):
    cases = {"": [], "a": ["a"], "a\n": ["a"], "a\r\nb\n\n": ["a", "b", ""], "\n": [""], "a\nb": ["a", "b"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", T.lines(F.col("t")).alias("l"), T.line_feeds(F.col("t")).alias("n"), T.rows(F.col("t")).alias("r")).collect():
        assert r.l == cases[r.t] and r.n == r.t.count("\n") and r.r == r.t.split("\n")


def test_generated(spark):
    yes = ["// @generated by x", "# This file was automatically generated", "x\n/* DO NOT EDIT */", "; Code generated by tool", "auto generated"]
    no = ["hand written", "\n" * 50 + "do not edit", "regenerated beings", ""]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [r.g for r in df.select(T.is_generated(F.col("t")).alias("g")).collect()] == [True] * 5 + [False] * 4


def test_similarity(spark):
    pair = lambda f, a, b: one(spark, f(F.lit(a), F.lit(b)))
    assert pair(T.similar_leaves, "counter", "counters") and pair(T.similar_leaves, "a", "a")
    assert not pair(T.similar_leaves, "a", "b") and not pair(T.similar_leaves, "alpha", "zzz")
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array(F.lit("b")))) == 0


def test_small_text_functions(spark):
    assert one(spark, T.import_path(F.lit(" './././lib\\x' "))) == "lib/x"
    assert one(spark, T.change_counts(F.lit(12), F.lit(0), F.lit(2))) == "+12 ~2"
    assert one(spark, T.code_span(F.lit("a|b"))) == "`a\\|b`" and one(spark, T.code_span(F.lit("a`b"))) == "`` a`b ``"
    assert one(spark, T.tex(F.lit("50% & a_b"))) == "50\\% \\& a\\_b"
    assert one(spark, T.shortened(F.lit("abcdef"), 4)) == "abc…" and one(spark, T.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, T.repeats(F.lit("1.5; 2;;"))) == [1.5, 2.0] and one(spark, T.repeats(F.lit("  "))) is None
    assert one(spark, T.joined_repeats(F.array(F.lit(1.5), F.lit(2.0)))) == "1.5;2.0"
    assert one(spark, T.pair_name(F.lit("Go"), F.lit("a/b_c"), F.lit("0123456789"), F.lit("x/y.z.go"))) == "go-x-a-b-c-01234567-y-z"
    assert one(spark, T.without_white_space(F.lit("a \u00a0\u2003b\n"))) == "ab"
    assert one(spark, T.summary_label(F.lit("NewFile"))) == "New file - everything inserted"
    assert [tuple(x) for x in one(spark, T.search(F.lit("aAa\nb\nxaa"), F.lit("AA")))] == [(0, 0), (0, 1), (2, 1)]
    assert one(spark, T.search(F.lit("abc"), F.lit(""))) == [] and one(spark, T.last_callee_word(F.lit("self.log.Warn!"))) == "warn"


def test_buckets(spark):
    assert [one(spark, S.size_bucket(F.lit(n))) for n in (0, 999, 1000, 9999, 10000, 99999, 100000)] == ["small"] * 2 + ["medium"] * 2 + ["large"] * 2 + ["xlarge"]
    assert [one(spark, S.log2_bucket(F.lit(n))) for n in (1, 2, 3, 4, 7, 8)] == [0, 1, 1, 2, 2, 3]
    assert one(spark, S.safe_percent(F.lit(1), F.lit(0))) == 0 and one(spark, S.safe_percent(F.lit(1), F.lit(4))) == 25
    assert [one(spark, S.log_bin(F.lit(x), 1.0, 100.0, 4)) for x in (0.1, 1.0, 5.0, 99.0, 1e6)] == [0, 0, 1, 3, 3]
    v = one(spark, S.variation(F.array(F.lit(1.0), F.lit(3.0))))
    assert abs(v - 50) < 1e-9 and one(spark, S.variation(F.array(F.lit(1.0)))) is None


def test_quantiles_and_ranks(spark):
    r = random.Random(3)
    rows = [(g, float(r.choice([1, 1, 1, r.randint(0, 50)]))) for g in ("a", "b", None) for _ in range(r.randint(1, 300))] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs = {"lo": 0.0, "mid": 0.5, "hi": 0.9, "max": 1.0}
    near = {x.g: x for x in S.quantiles(df, ["g"], "v", qs).collect()}
    linear = {x.g: x for x in S.quantiles(df, ["g"], "v", qs, linear=True).collect()}
    for g in near:
        v = sorted(x for k, x in rows if k == g and x is not None)
        for name, q in qs.items():
            assert near[g][name] == v[math.floor(q * (len(v) - 1) + 0.5)]
            assert abs(linear[g][name] - np.percentile(v, 100 * q)) < 1e-9
    ids = df.where("v is not null").withColumn("id", F.monotonically_increasing_id()).cache()
    for x in S.ranked(ids, ["g"], "v", ["id"]).groupBy("g", "n").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect():
        assert x.r == list(range(1, x.n + 1))
    d = S.describe(df.where("g = 'a' and v is not null"), ["g"], "v").first()
    v = np.array([x for k, x in rows if k == "a" and x is not None])
    assert d.n == len(v) and abs(d.std - v.std(ddof=1)) < 1e-9 and abs(d.skew - ((v - v.mean()) ** 3).mean() / v.std() ** 3) < 1e-9
