"""Every operator and stage on empty tables, null, empty, repeated and very long rows, ties, and extra columns whose names clash with any of its own."""

import public_tokenizers
import pytest

import corpus_pipeline
from palimpsest.llm import decontamination, html_main, merkle, negatives, packing, pieces, pii, quality, secrets, sharding, simhash, substrings, topk

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Names of results and of steps between, in all modules.
CLASHING = (
    "_row row _text _t t _words _lines _stats stats _found _y _id id score held_out predicted _secrets secrets spans _assign _access _hex _likely _base base_sha256 "
    "_kept _fp fp print root _root _least least component_id node a b doc block n_words n_hit n_items items runs hit sha contaminated _page page_id html n_chars "
    "ids ends decoded _spans found before kind word rest _original _kinds n_card made _at _arc _rank _run _runs _lo _hi _slot shard slot size law "
    "sub none part kept removed vec_id terms embedding rank query_id slot_ i key"
).split()
LONG = "password = abcdefgh12345678 card 4111 1111 1111 1111 word word2 " * 3_000
TEXTS = [None, "", " ", "a b c d e", "a b c d e", "token: zzzzzzzz99", "12 34", "é中😀", LONG, LONG, "one\ntwo\nthree", "A" * 300_000]


def frame(spark, rows=True):
    names = ["doc_id", "text", *CLASHING]
    ddl = ", ".join(["doc_id long", "text string", *(f"{c} string" for c in CLASHING)])
    ids = [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    data = [(i, t, *CLASHING) for i, t in zip(ids, TEXTS, strict=True)] if rows else []
    df = spark.createDataFrame(data, ddl).repartition(3)
    assert df.columns == names
    return df


def small(spark, kind):
    if kind == "tests":
        return spark.createDataFrame([("it1", "a b c d e"), (None, "x"), ("it2", None)], "item_id string, text string")
    return spark.createDataFrame([(2, 1), (5, 0), (None, 1), (7, 1)], "doc_id long, quality int")


def model(df):
    return quality.train(df, "doc_id", "text", small(df.sparkSession, "labels"), "doc_id", "quality")


#: name: (operator, whether it keeps every row, names of the columns it puts in place of others)
KEEPING = {
    "pii.pseudonymised": (lambda df: pii.pseudonymised(df, "text", "key"), True, ()),
    "decontamination.clean": (lambda df: decontamination.clean(df, "text", small(df.sparkSession, "tests"), "item_id", "text"), False, ()),
    "secrets.redacted": (lambda df: secrets.redacted(df, "text"), True, ()),
    "secrets.with_secrets": (lambda df: secrets.with_secrets(df, "text"), True, ("secrets",)),
    "simhash.one_of_each": (lambda df: simhash.one_of_each(df, "doc_id", "text"), False, ()),
    "simhash.one_of_each, ids name rows": (lambda df: simhash.one_of_each(df.where("doc_id > 1"), "doc_id", "text"), False, ()),
    "quality.accepted": (lambda df: quality.accepted(df, "text", model(df)), False, ()),
    "quality.scored": (lambda df: quality.scored(df, "text", model(df)), True, ("score",)),
    "pieces.encode": (lambda df: pieces.encode(df, "text", MODEL, df.columns), True, ("ids", "ends", "decoded")),
}
MAKING = {
    "pii.pseudonyms": lambda df: pii.pseudonyms(df, "doc_id", "text", "key"),
    "decontamination.digests": lambda df: decontamination.digests(df, "doc_id", "text", small(df.sparkSession, "tests"), "item_id", "text"),
    "secrets.digests": lambda df: secrets.digests(df, "doc_id", "text"),
    "simhash.near_duplicates": lambda df: simhash.near_duplicates(df, "doc_id", "text"),
    "quality.digests": lambda df: quality.digests(df, "doc_id", "text", model(df)),
    "pieces.digests": lambda df: pieces.digests(df, "doc_id", "text", MODEL),
    "html_main.main_text": lambda df: html_main.main_text(df, "text", ["doc_id"]),
    "sharding.shard": lambda df: sharding.shard(df, "doc_id", ["_arc"], 4),
    "merkle.checked": lambda df: merkle.checked(df, "doc_id", "row", ["doc_id", "row", "text", "root"], "text"),
    "merkle.proofs": lambda df: merkle.proofs(df.select(*df.columns, merkle.leaf(df["text"]).alias("digest")), "text", ["doc_id", "_row"], "digest"),
    "packing.pack": lambda df: packing.pack(df, "doc_id", "text", VOCABULARY).where("start = 0"),
    "substrings.remove_repeats": lambda df: substrings.remove_repeats(df, "doc_id", "text", digest=True),
}


@pytest.mark.parametrize("name", KEEPING)
def test_rows_and_columns_stay(spark, name):
    operator, whole, made = KEEPING[name]
    df = frame(spark)
    got = operator(df)
    assert sorted(got.columns) == sorted(df.columns) if not made else sorted(got.columns) == sorted({*df.columns, *made})
    rows = got.collect()
    assert len(rows) == len(TEXTS) if whole else 0 < len(rows) <= len(TEXTS)
    assert all(r[c] == c for r in rows for c in CLASHING if c not in made)
    assert operator(frame(spark, rows=False)).count() == 0


@pytest.mark.parametrize("name", MAKING)
def test_a_row_for_each_row(spark, name):
    assert MAKING[name](frame(spark)).count() == len(TEXTS)
    assert MAKING[name](frame(spark, rows=False)).count() == 0


def test_one_of_each_is_the_same_however_rows_lie(spark):
    rows = [(1, "x y z", i) for i in range(20)] + [(None, "q r s", i) for i in range(20)]
    kept = {tuple(sorted((r.text, r.n) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(n), "doc_id", "text").collect())) for n in (1, 3, 7)}
    assert kept == {(("q r s", 0), ("x y z", 0))}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = frame(spark)
    rows = stage(spark, df, "/root/testdata/sf0.001").collect()
    made = ("ids", "ends", "decoded") if name == corpus_pipeline.STAGES[-1][0] else ()
    assert 0 < len(rows) <= len(TEXTS) and all(r[c] == c for r in rows for c in CLASHING if c not in made)
    assert stage(spark, frame(spark, rows=False), "/root/testdata/sf0.001").count() == 0


def test_wide_and_empty_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [300000.0, 0.0]), (2, [-(2.0**40), 3.0]), (50, [0.0, 2.0**20]), (3, []), (4, [float("nan"), 0.0]), (5, None)]
    t = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vec_id", "embedding")
    whole = {i: [int(256 * x) for x in v] for i, v in rows if v is not None and i != 4}
    want = []
    for q in (0, 50):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:5])]
    assert sorted(tuple(r) for r in topk.top_k(t, t.where("id % 50 = 0")).collect()) == want
    big = topk.quantised(spark.createDataFrame([(0, [2.0**50]), (1, [2.0**50])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(big, big).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        topk.quantised(spark.createDataFrame([(0, [2.0**60])], "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()


def test_negatives_of_clashing_names(spark):
    names = "id terms mark place lowest highest slot slots _cell _row ids labels vectors rank score anchor positive_id".split()
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.8, 0.0], 1), (2, [0.8, 0.0], 1), (3, None, 1), (None, [1.0, 0.0], 1), (4, [0.7, 0.1], None)]
    df = spark.createDataFrame([(*r, *names) for r in rows], ", ".join(["vec_id long", "embedding array<double>", "label int", *(f"{n} string" for n in names)])).repartition(3)
    mine = lambda d: negatives.hard_negatives(d, "vec_id", "embedding", d["label"], d["vec_id"] % 50 == 0)
    assert sorted(tuple(x) for x in mine(df).collect()) == [(0, 1, r, 2, 65536, 256 * 204) for r in (1, 2)]
    assert mine(df.limit(0)).count() == 0
