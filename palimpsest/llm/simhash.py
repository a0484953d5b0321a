"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit for each of 64 majorities over the hashes of its shingles. Fingerprints
at most `distance` bits apart link. The bits are grouped into partitions of bits that go together (by
their correlation on a bounded sample of fingerprints, see SAMPLE), and the distance is shared out among the partitions
unequally: with allowances c_i that sum to distance + 1, two linked fingerprints differ in fewer than
c_i bits of some partition i. Dynamic programming picks the c_i that cost least, by numbers of
candidates and probes estimated on the sample. The sample decides what it costs, never what is found.

Probing: each distinct fingerprint goes to the bucket of its bits in partition i, and of all bits
fewer than c_i from those. Within a bucket all are verified on all 64 bits. A bucket of more
than BUCKET fingerprints is never compared in pairs: its fingerprints are sent to themselves and to each value one
bit away instead. Two that are at most 2 bits apart meet there, at most 65 can meet, and all that meet are at most 2 bits
apart. So no task and no step grows with the square of a bucket.

Equal fingerprints are one node of the graph, whatever the number of their documents; components are
found by alternating stars (see components).

Defined results: a null or empty text, or one of white space, has no words and fingerprint zero, which links
like any other; a text of fewer words than a shingle is one shingle; a null id is kept, and its component is the
smallest id that it reaches, or null if it reaches none; repeated ids and rows each keep a row. Other columns have no part in it, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut, forget, map_batches, partitions, texts
from palimpsest.llm.components import components

BITS = 64
#: Distinct fingerprints that plan() looks at, at most.
SAMPLE = 5000
#: Distinct fingerprints of a bucket that are compared in pairs.
BUCKET = 200


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text, as a signed long; words are parted by ASCII white space, A-Z made small."""
    return int(fingerprints([text], shingle, seed)[0])


def fingerprints(docs: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(docs), np.int64)
    for d, text in enumerate(docs):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes = [xxh64_intdigest(joined, seed)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-shingle]]).tolist()
            hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        h = np.array(hashes, np.uint64)
        count = np.zeros(BITS, np.int64)
        for lo in range(0, len(h), 1 << 14):
            count += np.unpackbits(h[lo : lo + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[d] = np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0]
    return out


def with_fingerprint(df: DataFrame, doc_id: str, text: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp), fp a signed long."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(texts(b.column(1)), shingle, seed))], names=["doc_id", "fp"])

        return run

    return map_batches(df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("_t")), "doc_id long, fp long", make)


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The bits dealt to partitions of near-equal size, each bit to the one whose bits it correlates with most."""
    bits = (sample[:, None] >> np.arange(BITS)) & 1
    if len(sample) > 1:
        x = bits - bits.mean(0)
        spread = np.sqrt((x * x).mean(0))
        near = np.abs(x.T @ x / len(x)) / np.maximum(np.outer(spread, spread), 1e-12)
    else:
        near = np.zeros((BITS, BITS))
    np.fill_diagonal(near, 0)
    size = [BITS // parts + (p < BITS % parts) for p in range(parts)]
    left = set(range(BITS))
    out = []
    for p in range(parts):
        first = max(left, key=lambda b: (near[b, list(left)].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size[p]:
            b = max(left, key=lambda b: (near[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def masks(groups: list[list[int]]) -> list[int]:
    """Each partition's bits as a signed long."""
    out = []
    for g in groups:
        m = sum(1 << b for b in g)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def flips(group: list[int], most: int) -> list[int]:
    """All patterns of at most `most` bits of a partition."""
    return [m - (1 << 64) if m >> 63 else m for k in range(most + 1) for c in combinations(group, k) for m in [sum(1 << b for b in c)]]


def plan(sample: np.ndarray, rows: int, distance: int, parts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, allowance) of each partition that is probed: the cheapest allowances that sum to distance + 1."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    n = max(1, len(sample))
    for m in parts:
        groups = grouped_bits(sample, m)
        cost = np.full((m, distance + 2), np.inf)
        for p, (group, mask) in enumerate(zip(groups, masks(groups), strict=True)):
            cost[p, 0] = 0.0
            values, counts = np.unique(sample & np.int64(mask), return_counts=True)
            for c in range(1, distance + 2):
                probes = len(group) ** (c - 1) if c > 1 else 0
                if 1 + probes > 200:
                    continue
                pairs = float((counts * (counts - 1) / 2).sum())
                for f in flips(group, c - 1)[1:]:
                    at = np.searchsorted(values, values ^ np.int64(f))
                    at[at == len(values)] = 0
                    pairs += float((counts * counts[at] * (values[at] == values ^ np.int64(f))).sum() / 2)
                # a pair is verified in a few nanoseconds, a probe is shuffled and sorted in a few microseconds
                cost[p, c] = (pairs + 1) * (rows / n) ** 2 * 1e-8 + rows * (1 + probes) * 5e-6
        total = np.full((m + 1, distance + 2), np.inf)
        total[0, 0] = 0.0
        choice = np.zeros((m + 1, distance + 2), np.int64)
        for p in range(m):
            for s in range(distance + 2):
                for c in range(s + 1):
                    if total[p, s - c] + cost[p, c] < total[p + 1, s]:
                        total[p + 1, s], choice[p + 1, s] = total[p, s - c] + cost[p, c], c
        if best is None or total[m, distance + 1] < best[0]:
            chosen, s = [], distance + 1
            for p in range(m, 0, -1):
                c = int(choice[p, s])
                s -= c
                if c:
                    chosen.append((groups[p - 1], c))
            best = (float(total[m, distance + 1]), chosen[::-1])
    return best[1]


def _near(fps: np.ndarray, distance: int) -> np.ndarray:
    """(fingerprint, one of its group) for the groups that links of at most `distance` bits make of a bucket."""
    x = fps[:, None] ^ fps[None, :]
    near = np.bitwise_count(x.view(np.uint64)) <= distance
    root = np.arange(len(fps))
    while True:
        new = np.where(near, root[None, :], len(fps)).min(1)
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(fps)))
    return np.stack([fps[at], fps[root[at]]], 1)


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = [_near(np.unique(flat[a:z]), distance) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp): links that connect all that are at most `distance` bits apart."""
    if not 0 <= distance <= 2:
        raise ValueError("distances of 0, 1 and 2 bits are offered")
    spark = nodes.sparkSession
    rows = nodes.count()
    sample = np.array(sorted(r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()), np.int64)
    probed = plan(sample, rows, distance)
    keys = []
    for i, (group, c) in enumerate(probed):
        (mask,) = masks([group])
        own = F.col("fp").bitwiseAND(F.lit(mask))
        keys += [F.struct(F.lit(i).alias("i"), own.bitwiseXOR(F.lit(f)).alias("key")) for f in flips(group, c - 1)]
    sent = nodes.select("fp", F.explode(F.array(*keys)).alias("to")).select("fp", "to.i", "to.key")
    counted = sent.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(sent.join(counted, ["i", "key"]))
    small = (
        met.where(F.col("n") <= BUCKET)
        .groupBy("i", "key")
        .agg(F.collect_list("fp").alias("fps"))  # BUCKET at most
        .select("fps")
        .mapInArrow(_verify(distance), "a long, b long")
    )
    crowded = met.where(F.col("n") > BUCKET).select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *[F.lit(f) for f in flips(list(range(BITS)), 1)[1:]])
    around = (
        crowded.select("fp", F.explode(F.transform(near, lambda f: F.col("fp").bitwiseXOR(f))).alias("at"))
        .groupBy("at")
        .agg(F.collect_list("fp").alias("fps"))  # 65 at most: those one bit from `at`, and itself
        .where(F.size("fps") > 1)
    )
    if distance == 2:
        linked = around.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    else:
        linked = around.select("fps").mapInArrow(_verify(distance), "a long, b long")
    return small.unionByName(linked)


def _resolved(df: DataFrame, doc_id: str, text: str, distance: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, component_id) of each fingerprint."""
    marked = cut(with_fingerprint(df, doc_id, text, shingle, seed))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(of, nodes.fp == of.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, doc_id: str, text: str, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of each row: the smallest doc_id among those it reaches by links."""
    marked, named = _resolved(df, doc_id, text, distance, shingle, seed)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, doc_id: str, text: str, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """df, all columns, with one row of each component: that of the smallest doc_id; of several that have it, the first by text, then by the whole row as JSON."""
    marked, named = _resolved(df, doc_id, text, distance, shingle, seed)
    n = marked.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if n.rows == n.ids:  # ids name rows
        # those that go are few beside those that stay, and their table's size is known: small, it is broadcast, and the texts stay where they are
        gone = cut(marked.join(named, "fp").where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
        return df.join(gone, df[doc_id].cast("long") == gone["doc_id"], "left_anti")
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("print", T.LongType())])

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(texts(b.column(1)), shingle, seed))], names=schema.names)

        return run

    rows = map_batches(df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), df[text].alias("t")), schema, make).join(named, F.col("print") == named["fp"])
    first = rows.where(F.col("row")[doc_id].cast("long").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min_by("row", F.struct(F.col("row")[text], F.to_json("row"))).alias("row"))
    return first.select(*(F.col("row")[c].alias(c) for c in df.columns))
