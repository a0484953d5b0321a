"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse vectors: a dimension is a term, a quantised component its weight. Candidates lie in
blocks as posting lists, term by term; each term of a query scatters its weight times the postings
into a dense score array, one score for each candidate of the block. A partition selection leaves
the k best of a block, and a ranked merge the k best of all blocks.

Queries and candidates meet in a grid of blocks: both sides have blocks of bounded size and a block
of queries is copied to each slot of candidates. Nothing is broadcast, no task sees more than two
blocks at a time, and a lost task is computed again from its two inputs.

Vectors with a component whose quantised size reaches WIDE lie in blocks of their own. Where the sums of a pair of blocks may exceed a long,
they are worked out in integers of any size; a score that is among the best and does not fit a long stops the query with an error, as does a
component whose quantised size reaches 2**63.

Defined results: a vector that is null, or holds null or a non-finite component, takes no part; nor does a row with a null id. An
empty vector takes part and scores 0. Vectors of unequal length score over the dimensions they share.
Equal vectors are separate candidates; of equal scores the smaller id goes first; a repeated id is
one candidate for each of its rows, and one query whose list ranks the scores of its distinct vectors
together, less any row of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions

WIDE = 1 << 26
CANDIDATES = 4096
QUERIES = 2048
#: Queries whose score arrays are filled at once, so that these stay in a core's cache.
AT_ONCE = 32


def quantised(df: DataFrame, vec_id: str, embedding: str, scale: int = 256, *more: Column) -> DataFrame:
    """(id, terms): floor(scale * x), x as double, for each vector that takes part; `more` columns come behind."""
    size = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = lambda x: F.when(F.abs(size(x)) < float(1 << 63), F.floor(size(x))).otherwise(F.raise_error(F.lit("a quantised component does not fit a long")))
    bad = F.exists(df[embedding], lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(df[vec_id].isNotNull() & df[embedding].isNotNull() & ~bad).select(df[vec_id].cast("long").alias("id"), F.transform(df[embedding], whole).cast("array<long>").alias("terms"), *more)


def _blocks(rows: int):
    """Packs (id, terms) into rows of (ids, width, weights), the weights term by term, as 32-bit integers or, in blocks of wide vectors, as 64-bit ones."""

    def pack(ids: list[int], vectors: list[np.ndarray], kind) -> pa.RecordBatch:
        width = max(map(len, vectors))
        m = np.zeros((len(ids), width), kind)
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        return pa.RecordBatch.from_pydict(
            {
                "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "width": pa.array([width], pa.int32()),
                "weights": pa.array([np.ascontiguousarray(m.T).tobytes()], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {np.int32: ([], []), np.int64: ([], [])}
        for b in batches:
            lists = b.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, lo, hi in zip(b.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                v = flat[lo:hi]
                kind = np.int64 if len(v) and (v.max() >= WIDE or v.min() <= -WIDE) else np.int32
                ids, vectors = held[kind]
                ids.append(i)
                vectors.append(v)
                if len(ids) >= rows:
                    yield pack(ids, vectors, kind)
                    held[kind] = ([], [])
        for kind, (ids, vectors) in held.items():
            if ids:
                yield pack(ids, vectors, kind)

    return run


def _matrix(raw: bytes, width: int, rows: int) -> np.ndarray:
    """(terms, rows) of weights, from a packed block."""
    kind = np.int64 if width and rows and len(raw) == 8 * width * rows else np.int32
    return np.frombuffer(raw, kind).reshape(width, rows)


def fitting(q: np.ndarray, c: np.ndarray) -> type:
    """The integers that hold all scores of two blocks: 64-bit ones, or those of any size."""
    most = lambda m: max(int(m.max()), -int(m.min())) if m.size else 0
    return np.int64 if most(q) * most(c) * max(1, min(len(q), len(c))) < 1 << 63 else object


def accumulate(query: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of all candidates for each query: (queries, terms) and (terms, candidates), term at a time, in postings' type of integer."""
    scores = np.zeros((len(query), postings.shape[1]), postings.dtype)
    for term in range(min(query.shape[1], len(postings))):
        rows = np.flatnonzero(query[:, term])
        if len(rows):
            listed = np.flatnonzero(postings[term])
            weights = query[rows, term].astype(postings.dtype)[:, None]
            if 2 * len(listed) >= postings.shape[1]:
                scores[rows] += weights * postings[term]
            else:
                scores[rows[:, None], listed[None, :]] += weights * postings[term][listed]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, without rows of the query's own id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        s = scores[at]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above, equal = at[s > least], at[s == least]
        rest = k - len(above)
        if len(equal) > rest:
            equal = equal[np.argpartition(ids[equal], rest - 1)[:rest]] if rest else equal[:0]
        at = np.concatenate([above, equal])
    return at


def _search(k: int):
    names = ("query_id", "vec_id", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for qi, qw, qm, ci, cw, cm in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                q_ids, c_ids = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                q, c = _matrix(qm, qw, len(q_ids)), _matrix(cm, cw, len(c_ids))
                c, q = c.astype(fitting(q, c)), np.ascontiguousarray(q.T)
                for lo in range(0, len(q_ids), AT_ONCE):
                    scores = accumulate(q[lo : lo + AT_ONCE], c)
                    for own, s in zip(q_ids[lo : lo + AT_ONCE], scores, strict=True):
                        at = best(s, c_ids, own, k)
                        if s.dtype == object and any(not -(1 << 63) <= x < 1 << 63 for x in s[at]):
                            raise OverflowError("a score does not fit a long")
                        for x, v in zip(out, (np.full(len(at), own), c_ids[at], s[at].astype(np.int64)), strict=True):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in out], names=list(names))

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, slots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates; both sides as quantised() makes them."""
    spark = candidates.sparkSession
    slots = slots or partitions(spark)
    schema = "ids binary, width int, weights binary"
    blocks = candidates.repartition(slots).mapInArrow(_blocks(CANDIDATES), schema)
    asked = queries.distinct().coalesce(max(1, slots // 8)).mapInArrow(_blocks(QUERIES), schema)
    left = blocks.select(F.spark_partition_id().alias("slot"), F.col("ids").alias("c_ids"), F.col("width").alias("c_width"), F.col("weights").alias("c_weights"))
    right = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # dealt by number: no later plan joins slots in one task, which would undo the spread of the search
    met = (
        right.repartition(slots, "slot")
        .join(left.repartition(slots, "slot"), "slot")
        .select("ids", "width", "weights", "c_ids", "c_width", "c_weights")
        .mapInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
