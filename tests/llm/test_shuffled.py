"""Operators that shuffle, against brute force and on odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import components, sharding, simhash, topk


# ---- top k


def plain_top(vectors, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ok if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


def test_top_k_against_plain(spark):
    r = random.Random(4)
    vectors = [(i, [r.choice([0.0, 0.0, r.uniform(-2, 2), 0.5]) for _ in range(8)]) for i in range(400)]
    vectors += [(500 + i, vectors[3][1]) for i in range(30)]  # equal ones: ties
    vectors += [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1050, [float("inf")] + [0.0] * 7), (1100, []), (None, [1.0] * 8), (1003, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    t = topk.quantised(df, "vec_id", "embedding")
    got = sorted(tuple(x) for x in topk.top_k(t, t.where("id % 50 = 0")).collect())
    assert got == plain_top(vectors)
    assert topk.top_k(t.limit(0), t.limit(0)).count() == 0
    few = topk.top_k(t.where("id < 3"), t.where("id = 0")).collect()
    assert [x["rank"] for x in few] == [1, 2]


def test_blocks_and_sparse_postings():
    r = np.random.default_rng(1)
    q, c = r.integers(-3, 3, (5, 9)) * (r.random((5, 9)) < 0.4), r.integers(-3, 3, (9, 50)) * (r.random((9, 50)) < 0.2)
    assert (topk.accumulate(q.astype(np.int32), c.astype(np.int64)) == q @ c).all()
    ids = np.arange(50)
    for row in q @ c:
        at = topk.best(row, ids, 7, 5)
        assert sorted((-row[i], i) for i in at) == sorted((-s, i) for i, s in enumerate(row) if i != 7)[:5]


# ---- sharding


def test_shards_are_even_gapless_and_stable(spark):
    def place(n, shards=16, odd=True):
        rows = [(i, i % 7, "x") for i in range(n)] + ([(None, 1, "x"), (None, 1, "x"), (3, 0, "x"), (3, 3, "x")] if odd else [])
        return sharding.shard(spark.createDataFrame(rows, "doc_id long, size int, shard string"), "doc_id", ["size"], shards).collect()

    got = place(1000)
    count = Counter(x.shard for x in got)
    assert len(got) == 1004 and len(count) == 16 and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(count[s]))
    before = {x.doc_id: x.shard for x in place(2000, 16, False)}
    after = {x.doc_id: x.shard for x in place(2000, 17, False)}
    assert sum(before[i] != after[i] for i in before) < 0.35 * 2000  # a plain modulus moves 94 %
    assert len(place(0, odd=False)) == 0
    assert len({(x.shard, x.slot) for x in place(5, odd=False)}) == 5


def test_walk_against_plain():
    r = random.Random(6)
    for _ in range(50):
        shards = r.randint(1, 5)
        _, owners = sharding.ring(shards, 3)
        counts = {a: r.randint(0, 9) for a in range(len(owners))}
        n = sum(counts.values())
        runs = sharding.walk(counts, owners, shards)
        got = Counter()
        for a, lo, hi, s, slot in runs:
            assert slot == got[s]
            got[s] += hi - lo
        assert sum(got.values()) == n and all(got[s] == n // shards + (s < n % shards) for s in range(shards))
        for a, c in counts.items():
            assert sorted(i for b, lo, hi, _, _ in runs if b == a for i in range(lo, hi)) == list(range(c))


def test_keys_walk_the_ring_one_by_one(spark):
    """Against a plain walk: arc by arc, keys at home before those that come by, each key to the first point whose shard has room."""
    shards, points, n = 5, 8, 700
    positions, owners = sharding.ring(shards, points)
    rows = [(i if i % 9 else None, i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, size int").repartition(3)
    got = {(r.doc_id, r["size"]): (r.shard, r.slot) for r in sharding.shard(df, "doc_id", ["size"], shards, points).collect()}
    at = {(r.doc_id, r["size"]): r.h for r in df.withColumn("h", F.xxhash64("doc_id", "size")).collect()}
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used, want, passing = [0] * shards, {}, []
    home = {}
    for key, h in at.items():
        home.setdefault(next((i for i, p in enumerate(positions) if h <= p), 0), []).append((h, key[0] is not None, key[0] or 0, key))
    for lap in (0, 1):
        for arc, shard in enumerate(owners):
            queue = (sorted(home.get(arc, [])) if not lap else []) + passing
            passing = []
            for item in queue:
                if used[shard] < room[shard]:
                    want[item[-1]] = (shard, used[shard])
                    used[shard] += 1
                else:
                    passing.append(item)
    assert got == want


# ---- near duplicates


def plain_print(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def plain_groups(prints, distance=2):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


def near_texts(n=120):
    r = random.Random(9)
    vocab = ["w%d" % i for i in range(60)]
    bases = [r.choices(vocab, k=r.randint(40, 120)) for _ in range(6)]
    out = [None, "", " \t\n", "one", "one two", "One TWO three", "one two three", "é É ▁ a b"]
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_plain(spark):
    texts = near_texts()
    ids = [900 - i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], "doc_id long, text string, fp string, root string").repartition(5)
    prints = [plain_print(t) for t in texts]
    groups = plain_groups(prints)
    least = {}
    for i, g in zip(ids, groups):
        least[g] = min(i, least.get(g, i))
    got = {x.doc_id: x for x in simhash.near_duplicates(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, p, g in zip(ids, prints, groups):
        assert got[i].fp % (1 << 64) == p and got[i].component_id == least[g]
    kept = simhash.one_of_each(df, "doc_id", "text")
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(least.values())


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "x y z"), (4, "x y z"), (4, "q r s t u"), (2, "x y z"), (None, "solo one here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.component_id or -1) for x in simhash.near_duplicates(df, "doc_id", "text").collect())
    assert got == [(-1, -1)] * 3 + [(2, 2), (4, 2), (4, 2), (4, 4)]
    kept = sorted((x.doc_id or -1, x.text) for x in simhash.one_of_each(df, "doc_id", "text").collect())
    assert kept == [(-1, "a b c d"), (-1, "solo one here"), (2, "x y z"), (4, "q r s t u")]
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("bucket", [2, 200])
def test_links_of_crowded_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(bucket)
    prints = set()
    for _ in range(4):
        base = r.getrandbits(64)
        for _ in range(60):
            x = base
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    of = {x.node: x.root for x in components.components(simhash.links(nodes)).collect()}
    groups = plain_groups(prints)
    mine = [of.get(s, s) for s in signed]
    assert len(set(zip(mine, groups))) == len(set(mine)) == len(set(groups))


def test_plan_covers_the_distance():
    r = np.random.default_rng(3)
    sample = r.integers(-(1 << 63), 1 << 63, 800)
    for rows in (1_000, 10**6, 10**9, 10**11):
        probed = simhash.plan(sample, rows, 2)
        assert sum(c for _, c in probed) == 3
        bits = [b for g, _ in probed for b in g]
        assert len(bits) == len(set(bits))
    assert simhash.plan(sample[:0], 0, 2)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
