"""Benchmark decontamination with a distributed positional inverted index.

index() stores the postings of all training tokens as a table in the shared folder, one row for each block of documents: the block's terms, how many
postings each has, and the ascending positions of all of them, term by term (as differences). Documents are read once, nothing is shuffled, and no
row is larger than a block (an Arrow batch, or one document where that is longer).

search() looks up every phrase of the test set in every block: phrases of which a term has no posting are left out; of each other
one the rarest term's list, less the term's offset, gives the candidate places, and the lists of the other terms, less their offsets, are
intersected with it from rare to common (a binary search in the list for each place that is left) until none are left or all agree. With
a slop, a phrase has a place where each term has a posting of the same document at most that many words from where it would stand; the
places do not depend on blocks, on the partitioning, or on which term is rarest.

The test set is read in portions of at most TEST_BYTES (measured before a portion is taken; a longer item is cut into pieces that overlap by a
window less one word), each a broadcast that is dropped when its pass over the stored index is written. A larger test set takes more passes over the index.

Defined results: a null or empty text has no words and hits nothing; an item without words has no phrase; an item of null id hits like any other
but has no name, so it is not among the items of a document; an item shorter than a window is one phrase; items that share a phrase are both named; a repeated item is named once; an item with several texts
has the phrases of all. Equal documents have equal results, and each repeated row has its own. Other columns have no part in a result, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut, forget, map_batches, texts

WINDOW = 13
TEST_BYTES = 2 << 20
#: Candidate places examined at once in a worker.
PLACES = 1 << 20
#: A-Z to a-z; bytes that are not of a word to a space. Bytes of characters beyond ASCII are of a word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUNS = "array<struct<first:long,last:long>>"


def tokens(docs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct terms of documents, the term (its place in that list) of each word, and the number of words of each document."""
    raw = b" ".join([*docs, b""]).translate(FOLD)
    data = np.frombuffer(raw, np.uint8)
    of_word = data != 32
    edge = np.diff(of_word.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.concatenate([[0], np.cumsum(last - first)])
    letters = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[of_word])])
    coded = letters.dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs], dtype=np.int64)])
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(np.searchsorted(first, bounds))


class Phrases:
    """The distinct phrases of a portion of the test set, as places in its words, and the items that have each."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.terms, words, n = tokens([t for _, t in items])
        self.words = words.astype(np.int32)
        per_item = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        of = np.repeat(np.arange(len(items)), per_item)
        start = np.repeat(np.cumsum(n) - n, per_item) + np.arange(len(of)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        length = np.minimum(n[of], window)
        self.window = window
        rows = np.ascontiguousarray(self._rows(start, length))
        _, at, same = np.unique(rows.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True) if len(rows) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.start, self.length = start[at], length[at]
        pairs = np.unique(np.stack([same, of], 1), axis=0)
        names = [i for i, _ in items]
        self.owner = pairs[:, 1].astype(np.int32)
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(at) + 1))
        self.names = names

    def _rows(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The terms of phrases, -1 beyond a phrase's length."""
        at = np.arange(self.window)
        inside = at[None, :] < length[:, None]
        if not len(self.words):
            return np.full((len(start), self.window), -1, np.int32)
        return np.where(inside, self.words[np.where(inside, start[:, None] + at[None, :], 0)], np.int32(-1))

    def live(self, count: np.ndarray) -> np.ndarray:
        """Phrases all of whose terms have postings."""
        missing = np.concatenate([[0], np.cumsum(count[self.words] == 0)])
        return np.flatnonzero(missing[self.start + self.length] == missing[self.start])


class Postings:
    """The positional inverted index of one block: ascending positions term by term, and the first position of each document."""

    def __init__(self, terms: list[bytes], count: np.ndarray, positions: np.ndarray, n_words: np.ndarray):
        self.terms, self.count, self.positions, self.n_words = terms, count, positions, n_words
        self.first = np.concatenate([[0], np.cumsum(n_words)])

    @classmethod
    def of(cls, docs: list[bytes]) -> Postings:
        terms, words, n_words = tokens(docs)
        return cls(terms, np.bincount(words, minlength=len(terms)), np.argsort(words, kind="stable"), n_words)

    def of_terms(self, wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For terms of a test set: the number of postings, the start of the list, and all postings as ascending numbers list * size + position."""
        place = {t: i for i, t in enumerate(self.terms)}
        at = np.array([place.get(t, -1) for t in wanted], np.int64)
        start = np.concatenate([[0], np.cumsum(self.count)])
        size = max(1, len(self.positions))
        keys = np.repeat(np.arange(len(self.terms)), self.count) * size + self.positions
        return np.where(at >= 0, np.append(self.count, 0)[at], 0), at, start, keys


def find(index: Postings, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of each occurrence in the block, exact or within the slop."""
    count, list_of, start, keys = index.of_terms(phrases.terms)
    live = phrases.live(count) if len(phrases.start) else np.zeros(0, np.int64)
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    size = max(1, len(index.positions))
    near = np.arange(-slop, slop + 1)
    weight = 0
    lo = 0
    while lo < len(live):
        some = live[lo : lo + PLACES // phrases.window]
        terms = phrases._rows(phrases.start[some], phrases.length[some])
        rarity = np.where(terms >= 0, count[terms], np.iinfo(np.int64).max)
        weight = np.cumsum(rarity.min(1) * len(near))
        n = max(1, int(np.searchsorted(weight, PLACES, "right")))
        some, terms, rarity = some[:n], terms[:n], rarity[:n]
        lo += len(some)
        order = np.argsort(rarity, axis=1, kind="stable")
        offset = order[:, 0]
        term = terms[np.arange(len(some)), offset]
        n = count[term]
        of = np.repeat(np.arange(len(some)), n)
        place = index.positions[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[list_of[term]], n)] - offset[of]
        if slop:
            both = np.unique(np.stack([np.repeat(of, len(near)), (place[:, None] + near[None, :]).ravel()], 1), axis=0)
            of, place = both[:, 0], both[:, 1]
        length = phrases.length[some][of]
        keep = (place >= 0) & (place + length <= len(index.positions))
        of, place, length = of[keep], place[keep], length[keep]
        doc = np.searchsorted(index.first, place, "right") - 1
        keep = place + length <= index.first[doc + 1]  # the whole phrase in one document
        of, place, doc = of[keep], place[keep], doc[keep]
        for k in range(0 if slop else 1, phrases.window):
            if not len(place):
                break
            at = order[of, k]
            wanted = terms[of, at]
            left = list_of[wanted] * size + np.maximum(place + at - slop, index.first[doc])
            right = list_of[wanted] * size + np.minimum(place + at + slop, index.first[doc + 1] - 1)
            hit = keys[np.minimum(np.searchsorted(keys, left), len(keys) - 1)]
            keep = (wanted < 0) | ((hit >= left) & (hit <= right))
            of, place, doc = of[keep], place[keep], doc[keep]
        found[0].append(some[of])
        found[1].append(place)
    return np.concatenate(found[0]), np.concatenate(found[1])


def block_hits(index: Postings, phrases: Phrases, slop: int = 0) -> Iterator[tuple[int, np.ndarray, list]]:
    """(words, hit words as runs of first and after-last, names of items found) of each document of a block."""
    phrase, place = find(index, phrases, slop)
    n_docs = len(index.n_words)
    doc = np.searchsorted(index.first, place, "right") - 1
    # one place between documents, so that no run goes on into the next
    spaced = place + doc
    edge = np.zeros(len(index.positions) + n_docs + 1, np.int64)
    np.add.at(edge, spaced, 1)
    np.add.at(edge, spaced + phrases.length[phrase], -1)
    covered = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]]))
    runs = np.stack([np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)], 1)
    first = index.first + np.arange(n_docs + 1)
    n = phrases.owner_at[phrase + 1] - phrases.owner_at[phrase]
    item = phrases.owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.owner_at[phrase], n)]
    pairs = np.unique(np.stack([np.repeat(doc, n), item], 1), axis=0)
    of_run = np.searchsorted(first, runs[:, 0], "right") - 1
    run_at, item_at = np.searchsorted(of_run, np.arange(n_docs + 1)), np.searchsorted(pairs[:, 0], np.arange(n_docs + 1))
    for d in range(n_docs):
        yield int(index.n_words[d]), runs[run_at[d] : run_at[d + 1]] - first[d], sorted({phrases.names[i] for i in pairs[item_at[d] : item_at[d + 1], 1]} - {None})


def hits(docs: list[bytes], phrases: Phrases, slop: int = 0) -> Iterator[tuple[int, np.ndarray, list]]:
    """block_hits() of documents that are given as texts."""
    return block_hits(Postings.of(docs), phrases, slop)


def index(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The stored index: (block, ids, n_words, terms, counts, positions), a row for each block; counts and positions as 32-bit integers, positions as differences."""
    kind = df.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("n_words", T.ArrayType(T.LongType())),
            *(T.StructField(c, T.BinaryType()) for c in ("terms", "counts", "positions")),
        ]
    )

    def make():
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), iter(range(1 << 62))

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            p = Postings.of(texts(b.column(1)))
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}:{next(done)}"]), whole(b.column(0)), whole(pa.array(p.n_words, pa.int64())), pa.array([b" ".join(p.terms)], pa.binary()),
                    pa.array([p.count.astype("<i4").tobytes()], pa.binary()), pa.array([np.diff(p.positions, prepend=0).astype("<i4").tobytes()], pa.binary()),
                ],
                names=schema.names,
            )

        return run

    return cut(map_batches(df.select(df[doc_id].alias("id"), df[text].alias("text")), schema, make))


def _pieces(window: int, most: int):
    """(item, text) to pieces of at most about `most` bytes, cut between words; each begins with the last window - 1 words of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [t] if len(t) <= most else t.translate(FOLD).split()
                lo = 0
                while lo < len(words):
                    hi, size = lo, 0
                    while hi < len(words) and (size <= most or hi < lo + window):
                        size += len(words[hi]) + 1
                        hi += 1
                    out[0].append(i)
                    out[1].append(b" ".join(words[lo:hi]))
                    lo = hi if hi == len(words) else hi - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], names=["i", "t"])

    return run


def portions(tests: DataFrame, item_id: str, text: str, window: int = WINDOW) -> list[DataFrame]:
    """The test set's pieces, in portions of at most TEST_BYTES (or of one piece, where a single word is longer)."""
    source = tests.select(tests[item_id].cast("string").alias("i"), tests[text].cast("binary").alias("t")).where("t is not null")
    source = source.mapInArrow(_pieces(window, TEST_BYTES // 8), "i string, t binary").distinct()
    whole = source.agg(F.sum(F.octet_length("t")).alias("size"), F.max(F.octet_length("t")).alias("most")).first()
    n = (whole["size"] or 0) * 2 // TEST_BYTES + 1
    if n == 1:
        return [source]
    while True:
        dealt = source.withColumn("portion", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
        if dealt.groupBy("portion").agg(F.sum(F.octet_length("t")).alias("size")).agg(F.max("size")).first()[0] <= max(TEST_BYTES, whole["most"]):
            dealt = cut(dealt)
            return [dealt.where(F.col("portion") == k).select("i", "t") for k in range(n)]
        n *= 2


def _pass(stored: DataFrame, phrases, slop: int, every: bool) -> DataFrame:
    """(block, doc, id, n_words, runs, items) of documents that hit something, or of every one."""
    kind = stored.schema["ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("block", T.StringType()), T.StructField("doc", T.IntegerType()), T.StructField("id", kind), T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                block, n_words, terms, count, positions = (b.column(c)[r].as_py() for c in (0, 2, 3, 4, 5))
                index_ = Postings(terms.split(b" ") if terms else [], np.frombuffer(count, "<i4").astype(np.int64), np.cumsum(np.frombuffer(positions, "<i4"), dtype=np.int64), np.array(n_words, np.int64))
                rows = [(d, n, runs, items) for d, (n, runs, items) in enumerate(block_hits(index_, phrases.value, slop)) if every or len(runs)]
                d = [x[0] for x in rows]
                ids = b.column(1)[r].values.take(pa.array(d, pa.int32()))
                lengths = np.concatenate([[0], np.cumsum([len(x[2]) for x in rows])]).astype(np.int32)
                flat = np.concatenate([np.zeros((0, 2), np.int64), *(x[2] for x in rows)])
                runs = pa.ListArray.from_arrays(pa.array(lengths), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["first", "last"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(d), pa.string()), pa.array(d, pa.int32()), ids, pa.array([x[1] for x in rows], pa.int64()), runs, pa.array([x[3] for x in rows], pa.list_(pa.string()))], names=schema.names
                )

    return stored.mapInArrow(run, schema)


def _merged(runs):
    """Runs of several passes, sorted and those that touch or overlap as one."""
    start = F.struct(F.expr(f"cast(array() as {RUNS})").alias("out"), F.lit(None).cast("struct<first:long,last:long>").alias("open"))

    def step(s, x):
        joins = x["first"] <= s["open"]["last"]
        longer = F.struct(s["open"]["first"].alias("first"), F.greatest(s["open"]["last"], x["last"]).alias("last"))
        return (
            F.when(s["open"].isNull(), F.struct(s["out"].alias("out"), x.alias("open")))
            .when(joins, F.struct(s["out"].alias("out"), longer.alias("open")))
            .otherwise(F.struct(F.concat(s["out"], F.array(s["open"])).alias("out"), x.alias("open")))
        )

    return F.aggregate(F.array_sort(runs), start, step, lambda s: F.when(s["open"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["open"]))))


def search(stored: DataFrame, tests: DataFrame, item_id: str, test_text: str, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(id, n_words, runs, items) of each document of a stored index: its hit words as runs of first and after-last, and the names of the items found, sorted."""
    sc = stored.sparkSession.sparkContext
    parts = portions(tests, item_id, test_text, window)
    found = []
    for k, part in enumerate(parts):
        phrases = sc.broadcast(Phrases([(r.i, bytes(r.t)) for r in part.collect()], window))
        rows = _pass(stored, phrases, slop, every=not k)
        if len(parts) == 1:
            return rows.select("id", "n_words", "runs", "items")
        found.append(cut(rows))
        phrases.destroy()
    whole = reduce(DataFrame.unionByName, found).groupBy("block", "doc").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items")
    )  # an entry for each pass at most
    return whole.select("id", "n_words", _merged(F.col("runs")).alias("runs"), F.array_sort(F.array_distinct("items")).alias("items"))


def _hit(runs) -> object:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"])


def digests(docs: DataFrame, doc_id: str, text: str, tests: DataFrame, item_id: str, test_text: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    stored = index(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), "doc_id", "text")
    found = search(stored, tests, item_id, test_text).select(F.col("id").alias("doc_id"), "n_words", _hit(F.col("runs")).alias("n_hit"), "items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, text: str, tests: DataFrame, item_id: str, test_text: str) -> DataFrame:
    """docs, all columns, without those that are contaminated: hit words are at least a twentieth of all.

    Texts are told by their SHA-256; only those of contaminated ones meet the documents again.
    """
    named = F.sha2(docs[text].cast("binary"), 256)
    stored = index(docs.select(named.alias("sha"), docs[text].alias("text")), "sha", "text")
    found = search(stored, tests, item_id, test_text)
    hit = _hit(F.col("runs"))
    dirty = cut(found.where((hit > 0) & (20 * hit >= F.col("n_words"))).select("id").distinct())
    forget(stored)
    return docs.join(dirty, named == dirty["id"], "left_anti")
