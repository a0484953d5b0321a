"""Removal of repeated substrings by longest-previous-factor arrays, over all documents.

A byte is removed if it lies in a string of `length` bytes that also starts earlier: in a smaller
document, or before in the same one. Positions are ordered by (document, start); matches never cross
documents; they are judged on the input.

Suffixes that share `length` bytes share more than their order: the least hash of the GRAM-byte strings in them, at
the same offset. So a text is cut into segments, maximal runs of windows (strings of `length` bytes) with one such
anchor, and only segments of equal anchors can share a window:

1. Each task cuts its texts into segments and drops all but the first of equal ones, then sends (anchor,
   hash of the segment, position) to the anchor's partition, as packed arrays, one row for each task and partition.
2. A partition keeps the first of equal segments; the others lie wholly in a later copy and are removed as they
   are. First segments whose anchor has others are looked at in full.
3. Those segments' bytes are fetched from their documents and sent to the anchor's partition, where their
   windows are sorted as suffixes of bounded depth. Previous and next smaller positions in that
   order give the longest previous factor of each window, LPF; windows with LPF >= length are removed.
   An anchor with more than CROWD different segments is not sorted in one place: its windows are sent on as segments of their own,
   each to the partition of its own hash, and step 2's rule decides.
4. Removed runs meet their document again; what is left is hashed or returned.

Anchors of passages that stand in a large part of all documents are told beforehand from a sample of SAMPLE documents (hot_anchors()):
their segments, once equal ones of a chunk are dropped, leave step 1 as windows at once, so that no anchor gathers more than a
small share of the input. Which anchors are taken so changes the cost, never the result.

Packed arrays make a hot anchor one row for each task, whatever the copies; the number of partitions follows the bytes of the input
(PART_BYTES each), so that no task's memory grows with it.
Segments are compared by two 64-bit hashes; windows that are looked at in full are compared byte by byte.

Defined results: a null text is an empty one; texts shorter than `length` lose nothing; a null id comes
before all others; rows that share an id are ordered by their text, equal ones in any order, so that one of repeated rows stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, partitions
from palimpsest.llm.merkle import numbered

LENGTH = 100
GRAM = 32
#: Bytes of text cut into segments at once, and segments held before they are sent.
CHUNK = 1 << 20
HELD = 600_000
PART_BYTES = 64 << 20
#: Different segments of an anchor that are sorted together.
CROWD = 4000
#: Documents looked at for hot anchors, about; the share of them that makes an anchor hot; and how many are told to all tasks.
SAMPLE = 20_000
HOT_SHARE = 0.005
HOT_ANCHORS = 20_000
#: Windows sorted at once, unless one anchor has more.
SORTED = 60_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SEGMENTS, WINDOWS, RUNS, NEEDED, CROWDED, DOC = range(6)
#: part: the partition; kind: one of the above; then arrays of one entry for each segment or run; bytes: of all segments, or a document.
ROW = "part int, kind int, id binary, sub binary, start binary, len binary, key binary, hash binary, bytes binary"
COLUMNS = ("id", "sub", "start", "len", "key", "hash")
KINDS = (np.int64, np.int32, np.int64, np.int64, np.uint64, np.uint64)
Arrays = dict[str, np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def hashes(data: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """Hash of the n bytes from each place, for powers of two n."""
    out, h, n, power = {}, BYTES[data], 1, MULTIPLIER
    while True:
        if n in sizes:
            out[n] = h
        if n >= max(sizes):
            return out
        with np.errstate(over="ignore"):
            h = h[:-n] * power + h[n:] if len(h) > n else h[:0]
            power = power * power
        n *= 2


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def block(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def segment_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Of all bytes of segments, at least length and less than 2 * length long, from hashes of block(length) bytes."""
    b = block(length)
    with np.errstate(over="ignore"):
        out = mix(h[start])
        for at in (start + length - b, end - length, end - b):
            out = mix(out * MULTIPLIER + h[at])
        return mix(out + (end - start).astype(np.uint64))


def segments(texts: list[bytes], length: int) -> tuple[Arrays, np.ndarray]:
    """Segments of texts: doc (place in the list), start, len, key (of the anchor), hash and place (start in all texts); and hashes of blocks."""
    gram = min(GRAM, block(length) // 2)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = len(data) - length + 1
    h = hashes(data, {gram, block(length)})
    key = mix(h[gram])
    # order by hash, then place: the first of equal ones is the anchor
    ranked = (key & ~np.uint64(0xFFFFFF)) | np.arange(len(key), dtype=np.uint64)
    anchor = (sliding_least(ranked, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[:n]
    valid = np.arange(n) + length <= ends[doc]
    new = np.ones(n + 1, bool)
    new[1:-1] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~valid[1:]
    start = np.flatnonzero(new[:-1] & valid)
    end = np.flatnonzero(new[1:] & valid) + length
    of = doc[start]
    a = {"doc": of, "start": start - (ends - sizes)[of], "len": end - start, "key": key[anchor[start]], "hash": segment_hash(h[block(length)], start, end, length), "place": start}
    return a, h[block(length)]


def as_windows(a: Arrays, h: np.ndarray, length: int) -> Arrays:
    """Each window of segments as a segment of its own; places in h, the hashes of blocks."""
    n = a["len"] - length + 1
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key, hash_ = window_hashes(h, np.repeat(a["place"], n) + offset, length)
    return {"id": np.repeat(a["id"], n), "sub": np.repeat(a["sub"], n), "start": np.repeat(a["start"], n) + offset, "len": np.full(len(offset), length, np.int64), "key": key, "hash": hash_}


def window_hashes(h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and hash of the windows that start at places of h."""
    first, last = h[at], h[at + length - block(length)]
    with np.errstate(over="ignore"):
        return mix(mix(first) * MULTIPLIER + last), mix(last * MULTIPLIER + mix(first) + np.uint64(1))


def among(key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each key is one of the sorted hot ones."""
    if not len(hot):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    return hot[at] == key


def pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A text in overlapping pieces of about CHUNK bytes, each with its offset, so that each window lies in one."""
    for at in range(0, max(1, len(text) - length + 1), CHUNK):
        yield at, text[at : at + CHUNK + length - 1]


def taken(a: Arrays, at) -> Arrays:
    return {k: v[at] for k, v in a.items()}


def joined(parts: list[Arrays]) -> Arrays:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, k) for c, k in zip(COLUMNS, KINDS, strict=True)}


def firsts(a: Arrays) -> tuple[Arrays, Arrays]:
    """The first of equal (key, hash), in order of key, and all others."""
    a = taken(a, np.lexsort((a["start"], a["sub"], a["id"], a["hash"], a["key"])))
    first = np.ones(len(a["key"]), bool)
    first[1:] = (a["key"][1:] != a["key"][:-1]) | (a["hash"][1:] != a["hash"][:-1])
    return taken(a, first), taken(a, ~first)


def merged(a: Arrays) -> Arrays:
    """Runs by document and start, those that touch as one."""
    a = taken(a, np.lexsort((a["start"], a["sub"], a["id"])))
    n = len(a["id"])
    if n < 2:
        return a
    same = (a["id"][1:] == a["id"][:-1]) & (a["sub"][1:] == a["sub"][:-1])
    doc = np.concatenate([[0], np.cumsum(~same)])
    # runs of one document end before those of the next begin, if each document has its own stretch
    wide = int((a["start"] + a["len"]).max()) + 1
    if doc[-1] >= (1 << 62) // wide:
        raise OverflowError("texts of 2**31 bytes and as many documents in one task are beyond Spark's own limits")
    reach = np.maximum.accumulate(doc * wide + a["start"] + a["len"])
    new = np.concatenate([[True], ~same | (doc[1:] * wide + a["start"][1:] > reach[:-1])])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [n - 1]])
    out = taken(a, at)
    out["len"] = reach[last] - doc[at] * wide - out["start"]
    return out


def doc_part(ids: np.ndarray, subs: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.int64).view(np.uint64) * MULTIPLIER + subs.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def rows(kind: int, a: Arrays, part: np.ndarray, data: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each partition that has entries."""
    order = np.argsort(part, kind="stable")
    a, part = taken(a, order), part[order]
    at = np.concatenate([np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), [len(part)]]) if len(part) else np.zeros(1, np.int64)
    for lo in range(0, len(at) - 1, 64):
        cols: list[list] = [[] for _ in range(9)]
        for x, y in zip(at[lo : lo + 64], at[lo + 1 : lo + 65]):
            cols[0].append(int(part[x]))
            cols[1].append(kind)
            for c, name, t in zip(cols[2:8], COLUMNS, KINDS, strict=True):
                # runs carry no keys
                c.append(a[name][x:y].astype(t).tobytes() if name in a and not (kind == RUNS and name in ("key", "hash")) else None)
            cols[8].append(b"".join(data[i] for i in order[x:y]) if data is not None else None)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["part", "kind", *COLUMNS, "bytes"])


def read(b: pa.RecordBatch) -> Iterator[tuple[int, Arrays, bytes]]:
    for r in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
        a = {c: np.frombuffer(x, t) for c, x, t in zip(COLUMNS, r[1:7], KINDS, strict=True) if x is not None}
        n = len(a["id"])
        yield r[0], {c: a.get(c, np.zeros(n, t)) for c, t in zip(COLUMNS, KINDS, strict=True)}, r[7]


def key_part(key: np.ndarray, parts: int) -> np.ndarray:
    return (key % np.uint64(parts)).astype(np.int32)


def _runs(a: Arrays, parts: int) -> Iterator[pa.RecordBatch]:
    if len(a["id"]):
        a = merged(a)
        yield from rows(RUNS, a, doc_part(a["id"], a["sub"], parts))


def _sent(kind: int, held: list[Arrays], parts: int, removed: list[Arrays] = ()) -> Iterator[pa.RecordBatch]:
    first, other = firsts(joined(held))
    yield from rows(kind, first, key_part(first["key"], parts))
    yield from _runs(joined([other, *removed]), parts)


def _cut_up(parts: int, length: int, hot) -> Callable:
    """Step 1: (id, sub, text) to segments, first ones only, and runs of the others. hot.value: sorted keys of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Arrays] = []
        removed: list[Arrays] = []
        n = size = 0
        some: list[tuple[int, int, int, bytes]] = []

        def flush() -> None:
            nonlocal n
            a, h = segments([s[3] for s in some], length)
            of = a.pop("doc")
            ids, subs, at = (np.array([s[i] for s in some], t) for i, t in ((0, np.int64), (1, np.int32), (2, np.int64)))
            a |= {"id": ids[of], "sub": subs[of], "start": a["start"] + at[of]}
            if (is_hot := among(a["key"], hot.value)).any():
                first, other = firsts(taken(a, is_hot))
                removed.append(other)
                held.append(as_windows(first, h, length))
                n += len(held[-1]["id"])
                a = taken(a, ~is_hot)
            held.append(a)
            n += len(a["id"])
            some.clear()

        for b in batches:
            for i, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not t or len(t) < length:
                    continue
                for at, piece in pieces(t, length):
                    some.append((i, s, at, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        flush()
                        size = 0
                if n >= HELD:
                    yield from _sent(SEGMENTS, held, parts, removed)
                    held.clear()
                    removed.clear()
                    n = 0
        if some:
            flush()
        if held:
            yield from _sent(SEGMENTS, held, parts, removed)

    return run


def _sift(parts: int) -> Callable:
    """Step 2: of equal segments the first stays; those whose anchor has others are needed in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Arrays] = []
        for b in batches:
            for kind, a, _ in read(b):
                if kind == RUNS:
                    yield from rows(RUNS, a, doc_part(a["id"], a["sub"], parts))
                else:
                    held.append(a)
        first, other = firsts(joined(held))
        held.clear()
        yield from _runs(other, parts)
        if len(first["key"]):
            at = np.flatnonzero(np.concatenate([[True], first["key"][1:] != first["key"][:-1]]))
            each = np.diff(np.concatenate([at, [len(first["key"])]]))
            each = np.repeat(each, each)
            for kind, pick in ((NEEDED, (each > 1) & (each <= CROWD)), (CROWDED, each > CROWD)):
                a = taken(first, pick)
                yield from rows(kind, a, doc_part(a["id"], a["sub"], parts))

    return run


def _fetch(parts: int, length: int, unpack) -> Callable:
    """Step 3a: needed segments, then documents, to segments with their bytes; crowded ones to windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: list[tuple[int, Arrays]] = []
        asked: Arrays | None = None
        out: list[Arrays] = []
        data: list[bytes] = []
        held: list[Arrays] = []
        n = size = 0
        for b in batches:
            for kind, a, raw in read(b):
                if kind != DOC:
                    wanted.append((kind, a))
                    continue
                if asked is None:
                    asked = joined([a for _, a in wanted]) | {"kind": np.concatenate([np.zeros(0, np.int64), *(np.full(len(a["id"]), k) for k, a in wanted)])}
                    asked = taken(asked, np.lexsort((asked["start"], asked["sub"], asked["id"])))
                    wanted.clear()
                i, s = int(a["id"][0]), int(a["sub"][0])
                lo, hi = np.searchsorted(asked["id"], i, "left"), np.searchsorted(asked["id"], i, "right")
                if lo == hi:
                    continue
                mine = taken(asked, slice(lo, hi))
                mine = taken(mine, mine["sub"] == s)
                text = unpack(raw)
                whole = taken(mine, mine["kind"] == NEEDED)
                if len(whole["id"]):
                    whole.pop("kind")
                    out.append(whole)
                    for x, y in zip(whole["start"].tolist(), whole["len"].tolist(), strict=True):
                        data.append(text[x : x + y])
                        size += y
                crowd = taken(mine, mine["kind"] == CROWDED)
                for x, y in zip(crowd["start"].tolist(), crowd["len"].tolist(), strict=True):
                    w = _windows(text[x : x + y], length)
                    k = len(w["key"])
                    held.append(w | {"id": np.full(k, i, np.int64), "sub": np.full(k, s, np.int32), "start": x + np.arange(k), "len": np.full(k, length, np.int64)})
                    n += k
                if size > 4 * CHUNK:
                    a = joined(out)
                    yield from rows(NEEDED, a, key_part(a["key"], parts), data)
                    out, data, size = [], [], 0
                if n >= HELD:
                    yield from _sent(WINDOWS, held, parts)
                    held, n = [], 0
        if out:
            a = joined(out)
            yield from rows(NEEDED, a, key_part(a["key"], parts), data)
        if held:
            yield from _sent(WINDOWS, held, parts)

    return run


def _windows(text: bytes, length: int) -> Arrays:
    b = block(length)
    key, hash_ = window_hashes(hashes(np.frombuffer(text, np.uint8), {b})[b], np.arange(len(text) - length + 1), length)
    return {"key": key, "hash": hash_}


def longest_previous(sorted_position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """LPF of each suffix, in suffix order, from positions in suffix order and common prefixes of neighbours (common[i]: of i - 1 and i).

    The previous (next) smaller position of a suffix is the nearest before (after) it in suffix order that
    starts earlier; its common prefix is the least on the way. All chains are followed at once, each step doubling
    as it passes over what a neighbour has passed already.
    """
    n = len(sorted_position)
    out = np.zeros(n, np.int64)
    for p, c in ((sorted_position, common), (sorted_position[::-1], np.concatenate([[0], common[1:][::-1]]))):
        to = np.arange(n) - 1
        reach = c.astype(np.int64).copy()
        reach[:1] = 0
        while True:
            far = np.flatnonzero((to >= 0) & (reach > 0) & (p[np.maximum(to, 0)] >= p))
            if not len(far):
                break
            via = to[far]
            reach[far] = np.minimum(reach[far], np.where(to[via] >= 0, reach[via], 0))
            to[far] = to[via]
        reach[to < 0] = 0
        out = np.maximum(out, reach if p is sorted_position else reach[::-1])
    return out


def previous_factors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, LPF up to length) of each window of texts that are given in order of position."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) - length + 1 for t in texts])
    of = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = offset + np.repeat(np.cumsum(n + length - 1) - (n + length - 1), n)
    window = np.lib.stride_tricks.sliding_window_view(data, length)[place]
    order = np.argsort(window.view(f"V{length}").ravel(), kind="stable")
    ranked = window[order]
    differ = ranked[1:] != ranked[:-1]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.where(differ.any(1), differ.argmax(1), length)
    lpf = np.zeros(len(order), np.int64)
    lpf[order] = longest_previous(place[order], common)
    return of, offset, lpf


def _factor(parts: int, length: int) -> Callable:
    """Step 3b: LPF of the windows of each anchor's segments; windows sent on their own as in step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Arrays] = []
        windows: list[Arrays] = []
        data: list[bytes] = []
        for b in batches:
            for kind, a, raw in read(b):
                if kind == RUNS:
                    yield from rows(RUNS, a, doc_part(a["id"], a["sub"], parts))
                elif kind == WINDOWS:
                    windows.append(a)
                else:
                    held.append(a)
                    ends = np.cumsum(a["len"]).tolist()
                    data += [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        if windows:
            yield from _runs(firsts(joined(windows))[1], parts)
            windows.clear()
        a = joined(held)
        order = np.lexsort((a["start"], a["sub"], a["id"], a["key"]))
        a = taken(a, order)
        new = np.flatnonzero(np.concatenate([[True], a["key"][1:] != a["key"][:-1]])) if len(order) else np.zeros(0, np.int64)
        bounds = [*new.tolist(), len(order)]
        total = np.concatenate([[0], np.cumsum(a["len"] - length + 1)])
        lo = 0
        found: list[Arrays] = []
        for hi in range(1, len(bounds)):
            if hi < len(bounds) - 1 and total[bounds[hi + 1]] - total[bounds[lo]] <= SORTED:
                continue
            x, y = bounds[lo], bounds[hi]
            lo = hi
            some = [data[i] for i in order[x:y]]
            # anchors differ, so windows of different anchors do; order by key, then position, orders each anchor's windows by position
            of, offset, lpf = previous_factors(some, length)
            hit = np.flatnonzero(lpf >= length)
            if len(hit):
                g = x + of[hit]
                found.append({"id": a["id"][g], "sub": a["sub"][g], "start": a["start"][g] + offset[hit], "len": np.full(len(hit), length, np.int64), "key": np.zeros(len(hit), np.uint64), "hash": np.zeros(len(hit), np.uint64)})
                found = [merged(joined(found))] if sum(len(f["id"]) for f in found) > 2_000_000 else found
        yield from _runs(joined(found), parts)

    return run


def _counted(length: int) -> Callable:
    """Of sampled texts: (key, hash) of the segments of each anchor, each once for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[np.ndarray] = []
            some: list[bytes] = []
            whole = (t for t in b.column(0).to_pylist() if t and len(t) >= length)
            for piece in (*(p for t in whole for _, p in pieces(t, length)), None):
                if some and (piece is None or sum(map(len, some)) > CHUNK):
                    a, _ = segments(some, length)
                    found.append(np.stack([a["key"], a["hash"]], 1))
                    some = []
                if piece is not None:
                    some.append(piece)
            if found:
                both = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in (0, 1)], names=["key", "hash"])

    return run


def hot_anchors(texts: DataFrame, rows_: int, length: int) -> np.ndarray:
    """Sorted keys of at most HOT_ANCHORS anchors that have the most different segments in a sample of about SAMPLE documents.

    All segments of the sample are counted together, so what is found does not depend on how the documents lie.
    """
    share = min(1.0, SAMPLE / max(1, rows_))
    segments_ = texts.sample(False, share, 7).select("text").mapInArrow(_counted(length), "key long, hash long").distinct()
    counted = segments_.groupBy("key").agg(F.count("*").alias("n"))
    found = counted.where(F.col("n") >= max(100, int(HOT_SHARE * min(SAMPLE, rows_)))).orderBy(F.desc("n"), "key").limit(HOT_ANCHORS).collect()
    return np.sort(np.array([r.key for r in found], np.int64).view(np.uint64))


def packer():
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress


def unpack(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _documents(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packer()
        for b in batches:
            ids, subs = b.column(0).to_numpy(), b.column(1).to_numpy()
            part = doc_part(ids, subs, parts)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part), pa.array([DOC] * n, pa.int32()), pa.array([x.tobytes() for x in ids.astype(np.int64)], pa.binary()), pa.array([x.tobytes() for x in subs.astype(np.int32)], pa.binary()),
                    *(pa.nulls(n, pa.binary()) for _ in range(4)), pa.array([pack(x or b"") for x in b.column(2).to_pylist()], pa.binary()),
                ],
                names=["part", "kind", *COLUMNS, "bytes"],
            )

    return run


def _finish(emit: Callable[[int, list[tuple[int, int]], bytes], tuple], schema: pa.Schema, nulls: int = 0) -> Callable:
    """Step 4: runs, then documents, to results. The first `nulls` documents of id NO_ID have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Arrays] = []
        runs: Arrays | None = None
        for b in batches:
            out = []
            for kind, a, raw in read(b):
                if kind != DOC:
                    held.append(a)
                    continue
                if runs is None:
                    runs = merged(joined(held))
                    held.clear()
                i, s = int(a["id"][0]), int(a["sub"][0])
                lo, hi = np.searchsorted(runs["id"], i, "left"), np.searchsorted(runs["id"], i, "right")
                mine = taken(runs, slice(lo, hi))
                mine = taken(mine, mine["sub"] == s)
                out.append((None if i == NO_ID and s < nulls else i, *emit(list(zip(mine["start"].tolist(), (mine["start"] + mine["len"]).tolist(), strict=True)), unpack(raw))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def left(runs: list[tuple[int, int]], text: bytes) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _digest(runs: list[tuple[int, int]], text: bytes) -> tuple:
    return len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left(runs, text)).hexdigest()


def _whole(runs: list[tuple[int, int]], text: bytes) -> tuple:
    return left(runs, text), [{"first": a, "last": b} for a, b in runs]


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
WHOLE = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
NO_ID = -(1 << 63)


def remove_repeats(df: DataFrame, doc_id: str, text: str, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """(doc_id, kept: the bytes left, removed: array of (first, last) byte runs), or digests of these."""
    if length < 8:
        raise ValueError("strings of 8 bytes and more are looked for")
    spark = df.sparkSession
    source = df.select(F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)).alias("id"), df[doc_id].isNull().alias("none"), df[text].cast("binary").alias("text"))
    if source.groupBy("id").count().where("count > 1").limit(1).count():
        # rows of one id are numbered in ranges of their texts, as many rows may have none
        source = numbered(source.withColumn("named", ~F.col("none")), ["id"], ["named", "text"]).withColumn("sub", F.col("_pos").cast("int"))
    else:
        source = source.withColumn("sub", F.lit(0))
    source = source.select("id", "sub", "text", "none")
    no_id = source.where("none").count() if df.schema[doc_id].nullable else 0
    whole = source.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).first()
    size = whole["size"] or 0
    parts = max(partitions(spark), size // PART_BYTES)
    texts = source.select("id", "sub", "text")
    deal = lambda d: d.repartitionById(parts, F.col("part"))
    hot = spark.sparkContext.broadcast(hot_anchors(texts, whole["n"], length))
    sifted = cut(deal(texts.mapInArrow(_cut_up(parts, length, hot), ROW)).mapInArrow(_sift(parts), ROW))
    documents = texts.mapInArrow(_documents(parts), ROW)
    wanted = sifted.where(F.col("kind").isin(NEEDED, CROWDED))
    fetched = deal(wanted.unionByName(documents)).sortWithinPartitions("kind").mapInArrow(_fetch(parts, length, unpack), ROW)
    factored = deal(fetched).mapInArrow(_factor(parts, length), ROW)
    removed = sifted.where(F.col("kind") == RUNS).unionByName(factored)
    kind = DIGEST if digest else WHOLE
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "doc_id long, kept binary, removed array<struct<first:long,last:long>>"
    out = deal(removed.unionByName(documents)).sortWithinPartitions("kind").mapInArrow(_finish(_digest if digest else _whole, kind, no_id), ddl)
    return out
