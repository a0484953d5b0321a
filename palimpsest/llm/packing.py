"""Sum-of-squares packing of documents into windows of tokens.

A document is its token ids and an end mark. Its full windows are cut off first. What is left goes, online, to the fill level that leaves the sum of the squared
counts of partially filled windows least: `counts` has, for each level, how many open windows are filled so far, and a remainder of s tokens takes a window of level h
to level h + s (h = 0: a new one). So levels that many windows wait at are left and those that none has are filled, and few windows stay open.

Each task packs its own documents, with no shuffle; its open windows hold at most `most_open` x `window` ids. When there are more of them, or the task ends, they are closed:
the fullest are filled with the pieces of the emptiest, which may be cut, and the last one is cut into windows whose lengths are powers of two. A sequence is padded to the
window unless its length is a power of two, so nothing is padded; a task adds at most log2(window) short sequences. Only such closing cuts documents that fit a window.

Texts of any length are encoded in parts, and a document's ids are held once.

Defined results: a null text is an empty one, whose only id is the end mark; a null or repeated id of a document stays what it is, and each row is a document of its own. Which
documents share a window follows from how the rows lie. Columns other than the id and the text have no part in it. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import texts

WINDOW = 1024
MOST_OPEN = 4096
PART = 1 << 20
#: The characters of Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
CUT = re.compile(f"[^{WHITE}](?=[{WHITE}])")
#: Fixed value: how byte-level vocabularies of this kind part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def plain_ranks(settings: dict) -> dict[bytes, int] | None:
    """The tokens of a byte-level vocabulary as bytes, with their ids; None where a tokenizer does more than to join bytes in the order of its ids."""
    before, model = settings.get("pre_tokenizer") or {}, settings["model"]
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not settings.get("normalizer")
    joins = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not usual or odd or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(joins)):
        return None
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others have characters from 256 on
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    special = {t["content"] for t in settings.get("added_tokens", [])}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """The ids of a text as little-endian unsigned 32-bit integers, as the tokenizers library has them by a file of it, without special ones added.

    A plain byte-level vocabulary is given to tiktoken, which has the same ids several times as fast; a text that holds an added token stays with the library. Long texts
    are encoded in parts, cut before white space that follows another character: no token reaches over such a place.
    """
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    library = tokenizers.Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()

    ranks = plain_ranks(settings)
    if ranks is None:
        return whole
    fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = [t["content"] for t in settings.get("added_tokens", [])]

    def encode(text: str) -> bytes:
        if any(t in text for t in added):
            return whole(text)
        return b"".join(array("I", fast(part)).tobytes() for part in parts(text, PART))

    return encode


def parts(text: str, most: int) -> Iterator[str]:
    """A text in parts of about `most` characters, cut before white space that follows another character."""
    at = 0
    while len(text) - at > most:
        m = CUT.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:] if at else text


Piece = tuple[object, int, bytes, int]  # document, start, ids, tokens of the document


class Packer:
    """The open windows of a task. put() and close() hand out whole windows, as lists of pieces."""

    def __init__(self, window: int, most_open: int) -> None:
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level(self, size: int) -> int:
        """The level, 0 for a new window, that a remainder of `size` tokens takes; of equal choices the fullest."""
        top = self.window - size
        leaves = np.where(self.counts[: top + 1] > 0, 1 - 2 * self.counts[: top + 1], np.iinfo(np.int64).max // 2)
        leaves[0] = 0
        comes = 2 * self.counts[size:] + 1
        comes[-1] = 0  # a full window is no longer open
        change = leaves + comes
        return top - int(np.argmin(change[::-1]))

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece shorter than a window."""
        size = len(piece[2]) // 4
        h = self.level(size)
        held = []
        if h:
            held = self.open[h].pop()
            self.counts[h] -= 1
        held.append(piece)
        if h + size == self.window:
            yield held
        else:
            self.open[h + size].append(held)
            self.counts[h + size] += 1
            if self.counts.sum() > self.most_open:
                yield from self.close(False)

    def close(self, last: bool = True) -> Iterator[list[Piece]]:
        """Fill the fullest open windows from the emptiest, cutting pieces; what is left over stays open or, at last, becomes windows of 2**k tokens."""
        held = [w for level in reversed(self.open) for w in level]
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        size = lambda w: sum(len(p[2]) for p in w) // 4
        lo, hi = 0, len(held) - 1
        while lo < hi:
            room = self.window - size(held[lo])
            while room and lo < hi:
                piece = held[hi].pop()
                n = len(piece[2]) // 4
                if n > room:
                    held[hi].append((piece[0], piece[1] + room, piece[2][4 * room :], piece[3]))
                    piece = (piece[0], piece[1], piece[2][: 4 * room], piece[3])
                    n = room
                held[lo].append(piece)
                room -= n
                if not held[hi]:
                    hi -= 1
            if not room:
                yield held[lo]
                lo += 1
        if lo == hi and held[lo]:
            rest = held[lo]
            if not last:
                self.open[size(rest)].append(rest)
                self.counts[size(rest)] += 1
                return
            left = size(rest)
            while left:
                part, room = [], 1 << (left.bit_length() - 1)
                left -= room
                while room:
                    doc, start, ids, tokens = rest.pop(0)
                    n = min(room, len(ids) // 4)
                    part.append((doc, start, ids[: 4 * n], tokens))
                    if 4 * n < len(ids):
                        rest.insert(0, (doc, start + n, ids[4 * n :], tokens))
                    room -= n
                yield part


def pack(df: DataFrame, doc_id: str, text: str, path: str, window: int = WINDOW, end: int = 0, most_open: int = MOST_OPEN) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of each piece: ids as little-endian unsigned 32-bit integers, gapless in its sequence from offset 0.

    `path` names a file of the tokenizers library that every executor has. `window` is a power of two.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("a window is a power of two")
    mark = np.array([end], "<u4").tobytes()
    rows = 8192

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(window, most_open)
        task, n = TaskContext.get().partitionId() << 33, 0
        out: list[tuple] = []
        kind = None

        def sealed(pieces: list[Piece]) -> None:
            nonlocal n
            offset = 0
            for doc, start, ids, tokens in pieces:
                out.append((doc, start, len(ids) // 4, ids, tokens, task + n, offset))
                offset += len(ids) // 4
            n += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            kind = b.schema.field(0).type
            for doc, raw in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids = encode(raw.decode("utf-8", "replace")) + mark
                tokens = len(ids) // 4
                full = tokens - tokens % window
                for start in range(0, full, window):
                    sealed([(doc, start, ids[4 * start : 4 * (start + window)], tokens)])
                    if len(out) >= rows:
                        yield flushed()
                if full < tokens:
                    for w in packer.put((doc, full, ids[4 * full :], tokens)):
                        sealed(w)
                if len(out) >= rows:
                    yield flushed()
        for w in packer.close():
            sealed(w)
            if len(out) >= rows:
                yield flushed()
        if out:
            yield flushed()

    return df.select(df[doc_id].alias("id"), df[text].alias("text")).mapInArrow(run, f"id {df.schema[doc_id].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", doc_id)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of whole sequences, from the pieces that pack() gives. At most a window's ids meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
