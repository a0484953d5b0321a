import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import substrings as S


def brute(docs, length):
    """Runs removed of each (key, text), in order of position."""
    seen, out = set(), []
    for text in docs:
        hit = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            s = text[i : i + length]
            if s in seen:
                hit[i : i + length] = True
            seen.add(s)
        out.append(hit)
    return out


def made(seed, n=60, length=100):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgé中", k=r.randint(1, 6))) for _ in range(80)]
    passages = [" ".join(r.choices(vocab, k=40)) for _ in range(4)]
    base = " ".join(r.choices(vocab, k=120))
    docs = []
    for k in range(n):
        parts = [" ".join(r.choices(vocab, k=r.randint(0, 60)))]
        if k % 3 == 0:
            parts.append(r.choice(passages))
        if k % 5 == 0:
            w = base.split()
            w[r.randrange(len(w))] = "changed"
            parts.append(" ".join(w))
        if k % 11 == 0:
            parts.append("ab" * r.randint(40, 200))
        if k % 13 == 0:
            parts.append("x" * r.randint(90, 400))
        r.shuffle(parts)
        docs.append(" ".join(parts).encode())
    docs[7] = docs[3]
    docs[9] = b""
    return docs


def check(spark, docs, ids=None, length=100):
    ids = ids or list(range(len(docs)))
    df = spark.createDataFrame([(i, None if d is None else d.decode(), "extra") for i, d in zip(ids, docs)], "doc_id long, text string, sub string").repartition(3)
    order = sorted(range(len(docs)), key=lambda k: (ids[k] is not None, ids[k] or 0, docs[k] or b""))
    hits = brute([docs[k] or b"" for k in order], length)
    want = sorted(
        ((ids[k] is not None, ids[k] or 0), len(docs[k] or b""), int(h.sum()), int((np.diff(np.concatenate([[0], h.astype(int), [0]])) == 1).sum()), hashlib.sha256(np.frombuffer(docs[k] or b"", np.uint8)[~h].tobytes()).hexdigest())
        for k, h in zip(order, hits)
    )
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df, "doc_id", "text", length, digest=True).collect())
    assert got == want
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    assert sum(x[2] for x in check(spark, made(seed))) > 1000


class Held:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("share", [0, 3, 1])
def test_small_chunks_long_texts_crowds_and_hot_anchors(monkeypatch, share):
    for name, value in (("CHUNK", 300), ("HELD", 50), ("CROWD", 2), ("SORTED", 10)):
        monkeypatch.setattr(S, name, value)
    # workers are forked with the patched module only if functions carry the values, so run the steps in this process
    docs = made(3)
    parts, held = 3, []
    import pyarrow as pa

    def deal(batches, kinds=None):
        by = {}
        for b in batches:
            for i in range(b.num_rows):
                by.setdefault(b.column(0)[i].as_py(), []).append(b.slice(i, 1))
        return [sorted(by.get(p, []), key=lambda b: b.column(1)[0].as_py()) for p in range(parts)]

    source = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([0] * len(docs), pa.int32()), pa.array(docs, pa.binary())], names=["id", "sub", "text"])
    keys = np.unique(S.segments([d for d in docs if len(d) >= 100], 100)[0]["key"])
    hot = Held(keys[::share] if share else keys[:0])
    sifted = [b for p in deal(S._cut_up(parts, 100, hot)([source])) for b in S._sift(parts)(p)]
    assert {b.column(1)[0].as_py() for b in sifted} == ({S.RUNS, S.NEEDED, S.CROWDED} if share != 1 else {S.RUNS})
    documents = list(S._documents(parts)([source]))
    fetched = [b for p in deal([b for b in sifted if b.column(1)[0].as_py() != S.RUNS] + documents) for b in S._fetch(parts, 100, S.unpack)(p)]
    factored = [b for p in deal(fetched) for b in S._factor(parts, 100)(p)]
    runs = [b for b in sifted if b.column(1)[0].as_py() == S.RUNS] + factored
    got = {}
    for p in deal(runs + documents):
        for b in S._finish(S._digest, S.DIGEST)(p):
            for row in b.to_pylist():
                got[row["doc_id"]] = (row["n_removed"], row["kept_sha256"])
    hits = brute(docs, 100)
    assert got == {i: (int(h.sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~h].tobytes()).hexdigest()) for i, (d, h) in enumerate(zip(docs, hits))}


def test_hot_anchors_are_found(spark):
    r = random.Random(8)
    passage = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(40))
    docs = [f"{r.getrandbits(200):x} {passage} {r.getrandbits(200):x}".encode() for _ in range(400)]
    texts = spark.createDataFrame([(d,) for d in docs], "text binary")
    found = S.hot_anchors(texts.repartition(1), 400, 100).tolist()
    assert found
    for parts in (7, 200):  # at last about two documents to a partition
        assert S.hot_anchors(texts.repartition(parts), 400, 100).tolist() == found
    check(spark, docs)


def test_nulls_ties_and_empty(spark):
    text = (b"the quick brown fox jumps over the lazy dog " * 4)[:150]
    other = bytes(range(97, 123)) * 6
    check(spark, [text, text, None, b"", other, other, text[:99], b"z" + text], [5, 5, 1, 2, None, None, 9, 5])
    least = spark.createDataFrame([(None, "a"), (-(1 << 63), "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in S.remove_repeats(least, "doc_id", "text").collect()) == [(False, -(1 << 63)), (False, 3), (True, 0), (True, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty, "doc_id", "text").collect() == []


def test_many_rows_without_an_id(spark):
    """A third of all rows share the null id, some of them texts; each is a document of its own, earlier ones by their texts."""
    r = random.Random(3)
    common = bytes(r.choices(range(97, 123), k=140))
    docs = [b"%03d " % i + common[i % 20 :] for i in range(60)] + [common] * 10 + [bytes(r.choices(range(97, 123), k=3000)) for _ in range(20)]
    ids = [None if i % 3 == 0 else i for i in range(len(docs))]
    check(spark, docs, ids)


def test_whole_results_and_other_lengths(spark):
    docs = made(4, 30)
    check(spark, docs, length=20)
    df = spark.createDataFrame([(i, d.decode()) for i, d in enumerate(docs)], "doc_id long, text string")
    for r in S.remove_repeats(df, "doc_id", "text").collect():
        assert S.left([(x["first"], x["last"]) for x in r.removed], docs[r.doc_id]) == bytes(r.kept)


def test_longest_previous_factor():
    text = b"abracadabra abracad"
    n = 4
    of, offset, lpf = S.previous_factors([text], n)
    for o, got in zip(offset, lpf):
        want = max((k for k in range(n + 1) for j in range(o) if text[j : j + k] == text[o : o + k]), default=0)
        assert got == want
