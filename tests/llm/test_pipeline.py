"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import re

import public_tokenizers
import sentencepiece
from test_rowwise import plain_hits, plain_secrets
from test_shuffled import plain_groups, plain_print

import corpus_pipeline
from palimpsest.llm import quality
from palimpsest.llm.common import cut


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{d}/documents.parquet").cache()
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{d}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = [raw]
    for f in stages:
        docs.append(cut(f(spark, docs[-1], d)))
    assert all(x.columns == raw.columns for x in docs[:-1])
    tables = [{r.doc_id: r for r in x.collect()} for x in docs]

    model = quality.train(raw, "doc_id", "text", labels, "doc_id", "quality")
    good = {r.doc_id for r in quality.digests(raw, "doc_id", "text", model).where("score >= 0.3").collect()}
    assert set(tables[1]) == good < set(tables[0])

    ids = sorted(tables[1])
    groups = plain_groups([plain_print(tables[1][i].text) for i in ids])
    assert set(tables[2]) == {ids[g] for g in groups}

    ids = sorted(tables[2])
    dirty = {i for i, h in zip(ids, plain_hits([tables[2][i].text for i in ids], items)) if h[4]}
    assert set(tables[3]) == set(ids) - dirty

    assert set(tables[4]) == set(tables[3])
    for i, r in tables[3].items():
        new = tables[4][i].text
        if not plain_secrets(r.text) and "[SECRET]" not in new:
            assert new == r.text
        assert not plain_secrets(new)
        assert re.sub(r"\[SECRET\]", "", new) in r.text or "[SECRET]" in new

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in tables[5].items():
        assert r.ids == lib.encode(tables[4][i].text) and r.decoded == lib.decode(r.ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").collect()) == sorted(tables[5])


def test_last_stage_gives_the_source_bytes_of_pieces(spark):
    r = corpus_pipeline.tokens(spark, spark.createDataFrame([(1, "Häuser am See")], "doc_id long, text string"), "").first()
    assert len(r.ends) == len(r.ids) and r.ends == sorted(r.ends) and r.ends[-1] == len(r.text.encode())
