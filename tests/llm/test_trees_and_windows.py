"""Merkle manifests, hard negatives and packing against plain versions and on odd rows."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from palimpsest.llm import merkle, negatives, packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# ---- Merkle manifests


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def small(s):
    return None if s is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_tree(digests, fan):
    """(root, path of each leaf as [(before, after)])."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, p in enumerate(paths):
            run, k = level[at[i] // fan * fan :][:fan], at[i] % fan
            p.append(("".join(run[:k]), "".join(run[k + 1 :])))
        level, at = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)], [a // fan for a in at]
    return level[0], paths


def plain_manifest(rows, fan=16):
    """What checked() gives for rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(frame, r))), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order], fan)
    out = []
    for g, above in zip(order, upper):
        for x, own in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            path, r = own + above, x[3]
            d = x[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                d = sha("".join(map(frame, (*r[:4], small(r[4])))))
            for before, after in path:
                d = sha(before + d + after)
            out.append((str(r[0]), x[2], trees[g][0], root, sha("".join(b + a for b, a in path)), d, d == root))
    return sorted(out)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DDL = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], f"{DDL}, root string, _pos string, leaf string").repartition(parts)
    return sorted((str(x[0]), *x[1:]) for x in merkle.checked(df, "doc_id", "source", FIELDS, "text").collect())


def some_rows():
    r = random.Random(2)
    sizes = {"hot": 300, "b": 17, "c": 16, "d": 1, None: 5, "é": 33, "": 2}
    rows = [(i, s, r.choice(["en", None]), r.choice([None, 3]), r.choice([None, "", "Some Text", "all small", "ÄÖ É", "X" * 5000])) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    return rows + [(None, "b", None, None, None), (7, "hot", "en", 3, "again"), (7, "hot", "en", 3, "again"), (7, "hot", "en", 3, "again")]


def test_manifest_against_plain(spark):
    rows = some_rows()
    want = plain_manifest(rows)
    assert manifest(spark, rows, 3) == want
    assert manifest(spark, rows, 1) == want
    assert Counter(x[6] for x in want)[False] > 10 and Counter(x[6] for x in want)[True] > 100


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, n):
    rows = some_rows()[300 : 300 + n]
    assert manifest(spark, rows) == (plain_manifest(rows) if n else [])


def test_manifest_of_one_hot_group_and_other_fans(spark):
    rows = [(i, "one", "en", i, f"Text {i}") for i in range(700)]
    assert manifest(spark, rows) == plain_manifest(rows)
    many = [(i, f"s{i % 40}", "en", i, "T") for i in range(100)]
    df = spark.createDataFrame(many, DDL).select("doc_id", "source", merkle.leaf(*map(F.col, FIELDS)).alias("leaf"))
    got = merkle.proofs(df, "source", ["doc_id"], "leaf", 3).select("doc_id", merkle.folded(F.col("leaf"), F.col("proof")).alias("again"), "root", F.size("proof").alias("n")).collect()
    assert len(got) == 100 and all(x.again == x.root for x in got) and len({x.root for x in got}) == 1
    groups = defaultdict(list)
    for r in many:
        groups[r[1]].append(sha("".join(map(frame, r))))
    assert got[0].root == plain_tree([plain_tree(groups[g], 3)[0] for g in sorted(groups)], 3)[0]
    assert {x.n for x in got} == {5}  # 3 leaves are one level, 40 groups four


# ---- hard negatives


def plain_negatives(rows, n_pos=5, n_neg=3):
    out = []
    for a, la, va in sorted({(i, l, tuple(v)) for i, l, v in rows if i % 50 == 0}):
        dot = lambda v: sum(x * y for x, y in zip(va, v))
        near = sorted((-dot(v), i) for i, l, v in rows if i != a and l == la)[:n_pos]
        far = sorted((-dot(v), i) for i, l, v in rows if i != a and l != la)
        for s, p in near:
            found = [(x, n) for x, n in far if 50 * -s <= 100 * -x <= 95 * -s][:n_neg]
            out += [(a, p, r + 1, n, -s, -x) for r, (x, n) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, slots=3, scale=256):
    df = spark.createDataFrame([(i, None if v is None else [x / scale for x in v], l, "x", "y") for i, l, v in rows], "vec_id long, embedding array<double>, label int, rank string, id string").repartition(3)
    got = negatives.hard_negatives(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 50 == 0, slots=slots)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(x) for x in got.collect())


def vectors(n=1500, width=6, kinds=4, seed=3):
    r = np.random.default_rng(seed)
    centres = r.integers(-200, 200, (12, width))
    rows = [(i, int(r.integers(kinds)), [int(x) for x in centres[i % 12] + r.integers(-60, 60, width)]) for i in range(n)]
    hot = rows[5][2]
    rows += [(n + i, int(i % 3 == 0), hot) for i in range(400)]  # one vector, a third of the rows near it: ties
    return rows + [(9000, 0, hot), (9000, 0, hot), (9000, 1, [1] * width), (3, 2, hot), (9050, 9, hot), (9100, 8, [0] * width), (9101, 8, [0] * width), (9150, 7, []), (9151, 7, [5]), (9200, 0, [7, 7])]


def test_negatives_against_plain(spark, monkeypatch):
    rows = vectors()
    want = plain_negatives(rows)
    assert len(want) > 300
    assert mined(spark, rows) == want
    for name, value in (("CANDIDATES", 100), ("QUERIES", 9), ("SAMPLE", 20)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows, 7) == want


def test_negatives_of_odd_rows(spark):
    odd = [(0, 0, None), (50, 0, [float("nan")] * 2), (100, None, [1.0, 2.0]), (150, 1, [float("inf"), 1.0])]
    assert mined(spark, odd) == []
    assert mined(spark, [(0, 0, [256, 256])]) == [] == mined(spark, [])
    two = [(0, 0, [256, 0]), (1, 0, [256, 0]), (2, 1, [192, 0]), (3, 1, [250, 0]), (4, 1, [100, 5])]
    assert mined(spark, [*two, *odd[:1]]) == [(0, 1, 1, 2, 65536, 49152)]
    wide = [(0, 0, [3 << 40, 0]), (1, 0, [1 << 20, 0]), (2, 1, [14 << 16, 0]), (3, 0, [-(1 << 20), 0])]
    assert mined(spark, wide) == plain_negatives(wide) != []
    with pytest.raises(Exception, match="does not fit a long"):
        mined(spark, [(0, 0, [3 << 40]), (1, 0, [3 << 40])])


def test_search_prunes_and_keeps_all():
    """Balls cut most leaf pairs of clustered rows; the result is that of all pairs."""
    r = np.random.default_rng(8)

    def block(n, first, seed):
        centres = np.random.default_rng(1).integers(-4000, 4000, (16, 8))
        v = centres[np.arange(n) % 16] + np.random.default_rng(seed).integers(-20, 20, (n, 8))
        long = lambda x: np.array(x, np.int64)
        columns = {"ids": long(range(first, first + n)), "labels": long(r.integers(0, 3, n)), "marks": long([0] * n), "places": long([0] * n), "lowest": long([negatives.LEAST] * n), "highest": long([negatives.MOST] * n)}
        return negatives.Block(negatives.packed(columns, list(v)))

    a, c = block(512, 0, 5), block(2048, 10_000, 6)
    calls = []
    real, negatives.scored = negatives.scored, lambda *x: calls.append(1) or real(*x)
    try:
        scores, ids = negatives.search(a, c, True, 4)
    finally:
        negatives.scored = real
    s = np.where(a.labels[:, None] == c.labels, a.vectors @ c.vectors.T, negatives.LEAST)
    for i in range(a.rows):
        best = sorted((-x, j) for x, j in zip(s[i].tolist(), c.ids.tolist()))[:4]
        assert [(-x, j) for x, j in zip(scores[i].tolist(), ids[i].tolist())] == best
    assert len(calls) < 8 * 32 / 3  # of 8 by 32 pairs of leaves


def test_intervals_hold_all_products():
    r = np.random.default_rng(2)
    for size in (3, 1 << 20):
        x, y = r.integers(-size, size, (150, 5)), r.integers(-size, size, (260, 5))
        x, y = x[negatives.arranged(x, np.arange(150))], y[negatives.arranged(y, np.arange(260))]
        (ca, ra), (cb, rb) = negatives.balls(x), negatives.balls(y)
        least, greatest = negatives.intervals(ca, ra, cb, rb)
        s = x @ y.T
        for i, (lo, hi) in enumerate(zip(*negatives.halves(150)[:2])):
            for j, (p, q) in enumerate(zip(*negatives.halves(260)[:2])):
                assert least[i, j] <= s[lo:hi, p:q].min() and s[lo:hi, p:q].max() <= greatest[i, j]


# ---- packing


ODD = [None, "", " ", "a", "word " * 3000, "<|endoftext|>", "a<|endoftext|> b", "x  y\n\n z \t", "é中😀 one", "don't I'll", "1234567890" * 400, "Ⅷ　  x\x1c\x1d y z", "a\n b", "a   b", "\r\n\r\n"]


def packed(spark, texts, parts=3, **more):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, sequence_id string").repartition(parts)
    return packing.pack(df, "doc_id", "text", VOCABULARY, **more)


def hold(rows, texts, window):
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    whole = defaultdict(list)
    sequences = defaultdict(list)
    for x in rows:
        whole[x.doc_id].append((x.start, np.frombuffer(x.ids, "<u4").tolist()))
        sequences[x.sequence_id].append((x.offset, x.length))
        assert x.length == len(x.ids) // 4 > 0
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(whole[i])
        assert [s for s, _ in parts] == list(np.cumsum([0] + [len(p) for _, p in parts])[:-1])
        assert [y for _, p in parts for y in p] == want
        assert {x.doc_tokens for x in rows if x.doc_id == i} == {len(want)}
    padding = 0
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1])
        n = sum(n for _, n in parts)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding, len(sequences)


@pytest.mark.parametrize("parts", [1, 4])
def test_pieces_hold_all_ids_once(spark, parts):
    r = random.Random(5)
    texts = ODD + [" ".join(r.choices("the a packing Häuser of tokens 2024 x,y".split(), k=r.choice([3, 50, 400, 1500]))) for _ in range(120)]
    pieces = packed(spark, texts, parts).cache()
    padding, n = hold(pieces.collect(), texts, 1024)
    assert padding == 0 and n <= sum(x.length for x in pieces.collect()) // 1024 + 11 * parts
    for s in packing.sequences(pieces).limit(5).collect():
        assert s.length == len(s.ids) // 4
    assert packed(spark, []).count() == 0


def test_few_open_windows_and_other_sizes(spark):
    texts = ["w " * n for n in range(1, 300)]
    padding, _ = hold(packed(spark, texts, 2, window=64, most_open=3).collect(), texts, 64)
    assert padding == 0
    with pytest.raises(ValueError):
        packed(spark, texts, window=100)


def test_level_has_the_least_sum_of_squares():
    r = random.Random(1)
    p = packing.Packer(32, 10**9)
    for k in range(3000):
        s = r.randint(1, 31)
        before = p.counts[:32].copy()

        def cost(h):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + s < 32:
                c[h + s] += 1
            return int((c**2).sum())

        allowed = [h for h in range(33 - s) if h == 0 or before[h]]
        h = p.level(s)
        assert h in allowed and cost(h) == min(map(cost, allowed))
        for w in p.put((k, 0, b"\0\0\0\0" * s, s)):
            assert sum(len(x[2]) for x in w) == 4 * 32
    assert p.counts[1:32].sum() < 60  # of some 1,500 windows
    rest = list(p.close())
    assert sum((n := sum(len(x[2]) for x in w) // 4) & (n - 1) for w in rest) == 0


def test_ids_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    library, encode = tokenizers.Tokenizer.from_file(VOCABULARY), packing.encoder(VOCABULARY)
    r = random.Random(7)
    letters = [" ", " ", "\n", "\t", "'", "s", "a", "B", "1", ".", "é", "中", " ", " ", " ", "᠎", "\x1c", "\x85", "​", "😀", "<|endoftext|>"]
    for _ in range(5000):
        t = "".join(r.choices(letters, k=r.randint(0, 25)))
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert packing.plain_ranks(json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))) is None
    other = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("Some  Words here", " a b", ""):
        assert np.frombuffer(other(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
