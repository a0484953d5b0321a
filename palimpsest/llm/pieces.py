"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised by longest prefixes through the model's compiled character map, and each byte
of the normalised text remembers the source byte it comes from. The normalised text is cut into pieces by the library, whose own normalising is
taken out of the model (without_normalising()), and the pieces are
projected to byte spans of the source: consecutive, ascending, and together the whole text. A
byte-fallback piece spans its own byte where the character map leaves the character alone.

Where the model has no character map, no character is a prefix of a key: normalising puts a space mark before the text and for each space, and the
projection is a running sum of the pieces' lengths. A text that holds a space mark itself, and any other model, is normalised character by character.

Defined results: a null text is an empty one; an empty text has no pieces and decodes to itself. Rows are encoded each for itself,
so repeated rows have equal pieces; other columns stay as they are, but that those named ids, ends and decoded give way to the results.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import map_batches

SPACE = "▁"


def fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, raw[i : i + n]
            i += n


def without_normalising(model: bytes) -> bytes:
    """The model with a normaliser that changes nothing: texts are taken as normalised already."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    field = lambda number, value: varint(number << 3 | 2) + varint(len(value)) + value
    # name, and no mark before a text, no spaces removed, no spaces as marks
    plain = field(1, b"identity") + b"".join(bytes([n << 3, 0]) for n in (3, 4, 5))
    return b"".join(field(number, plain if number == 3 else value) for number, _, value in fields(model))


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 and the replacements it points to."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, text: bytes, start: int) -> tuple[int, bytes]:
        """Length of the longest key that is a prefix of text[start:], and its replacement; (0, b"") if none."""
        length, value, node, unit = 0, -1, 0, self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(start, len(text)):
            node ^= text[k]
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                length, value = k + 1 - start, self.units[node] & 0x7FFFFFFF
        return (length, self.texts[value : self.texts.index(b"\0", value)]) if length else (0, b"")


class Normaliser:
    """Normalised text with, for each of its bytes and its end, the source byte that it starts from."""

    def __init__(self, charsmap: bytes, dummy: bool, collapse: bool, escape: bool):
        self.map, self.dummy, self.collapse, self.mark = CharacterMap(charsmap), dummy, collapse, SPACE.encode() if escape else b" "

    def parts(self, text: bytes) -> Iterator[tuple[bytes, int, int]]:
        i, end = 0, len(text)
        while i < end:
            n, to = self.map.longest(text, i) if self.map.units else (0, b"")
            if not n:
                lead = text[i]
                n = 1 if lead < 192 else 2 if lead < 224 else 3 if lead < 240 else 4
                to = text[i : i + n]
            yield to, i, i + n
            i += n

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, at = bytearray(), []
        end = 0
        spaced = self.collapse
        started = False
        for to, a, b in self.parts(text):
            if self.collapse:
                while spaced and to.startswith(b" "):
                    to = to[1:]
            if not to:
                if not started:
                    end = b
                continue
            if not started:
                started = True
                if self.dummy:
                    out += self.mark
                    at += [a] * len(self.mark)
            whole = to == text[a:b]
            for k, x in enumerate(to):
                one = self.mark if x == 32 else bytes([x])
                out += one
                at += [a + k if whole else a] * len(one)
            spaced = self.collapse and to.endswith(b" ")
            end = b
        if self.collapse:
            while out.endswith(self.mark):
                del out[-len(self.mark) :]
                end = at[-1]
                del at[-len(self.mark) :]
        return bytes(out), np.array([*at, end], np.int64)


class Pieces:
    """Encodes and decodes with one model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=without_normalising(model))
        kinds, words, charsmap, dummy, collapse, escape, suffix = [], [], b"", True, True, True, False
        for number, _, value in fields(model):
            if number == 1:
                piece = {n: v for n, _, v in fields(value)}
                words.append(piece[1].decode())
                kinds.append(piece.get(3, 1))
            elif number == 2:
                spec = {n: v for n, _, v in fields(value)}
                suffix = bool(spec.get(24, 0))
            elif number == 3:
                spec = {n: v for n, _, v in fields(value)}
                charsmap, dummy, collapse, escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.words, self.byte = words, [k == 6 for k in kinds]
        self.normalise = Normaliser(charsmap, dummy, collapse, escape)
        self.plain = dummy and escape and not (charsmap or collapse or suffix)
        #: Of each id: its decimal text, its text in UTF-8, and the source bytes it spans where a space mark stands for a space.
        self.decimal = [str(i) for i in range(len(words))]
        self.utf8 = [bytes([int(w[3:-1], 16)]) if k == 6 else b"" if k == 3 else w.replace(SPACE, " ").encode() for w, k in zip(words, kinds, strict=True)]
        self.spans = np.array([0 if k == 2 else len(x) for x, k in zip(self.utf8, kinds, strict=True)], np.int64)
        self.odd = {i for i, k in enumerate(kinds) if k in (2, 3)}

    def normalised(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and its alignment where that is more than a mark for each space."""
        if self.plain and SPACE not in text:
            return (SPACE + text.replace(" ", SPACE) if text else "", None)
        normal, at = self.normalise(text.encode())
        return normal.decode(), at

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, str]]:
        """Ids, the source byte where each piece ends, and the decoded text of each text."""
        normal = [self.normalised(t) for t in texts]
        for (text, at), ids in zip(normal, self.bare.encode([t for t, _ in normal], num_threads=1), strict=True):
            if at is None and self.odd.isdisjoint(ids):
                # a piece's source bytes are its own, a mark's one; the first mark stands for none
                yield ids, self.spans[ids].cumsum() - 1, self.decode(ids)
                continue
            yield ids, self._project(text, ids, at), self.lib.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: the first space mark goes, and bytes that are not UTF-8 are its to replace."""
        if not self.plain or not self.odd.isdisjoint(ids):
            return self.lib.decode(ids)
        raw = b"".join(map(self.utf8.__getitem__, ids))
        try:
            return (raw[1:] if raw.startswith(b" ") else raw).decode()
        except UnicodeDecodeError:
            return self.lib.decode(ids)

    def _project(self, normal: str, ids: list[int], at: np.ndarray | None) -> np.ndarray:
        """Where pieces of a normalised text end in its source."""
        raw = normal.encode()
        if at is None:  # a mark for each space, and one before the text
            steps = np.frombuffer(raw.replace(SPACE.encode(), b"\0\0 "), np.uint8) != 0
            at = np.concatenate([[0], np.maximum(steps.cumsum() - 1, 0)])
        surfaces = self.bare.encode(normal, out_type=str) if not self.odd.isdisjoint(ids) else None
        ends = np.zeros(len(ids), np.int64)
        i = 0
        for k, x in enumerate(ids):
            i += 1 if self.byte[x] else len((surfaces[k] if x in self.odd else self.words[x]).encode())
            ends[k] = at[min(i, len(at) - 1)]
        return ends


@functools.lru_cache(2)
def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def encode(df: DataFrame, text: str, model: str, keep: list[str], ends: bool = True) -> DataFrame:
    """The keep columns with ids (array), ends (the source byte where each piece ends, unless not asked for) and decoded, in place of columns of these names."""
    keep = [c for c in keep if c not in ("ids", "decoded", *["ends"] * ends)]
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("ends", T.ArrayType(T.LongType()))] * ends, T.StructField("decoded", T.StringType())]
    schema = T.StructType([*(df.schema[c] for c in keep), *more])

    def make():
        pieces = load(model)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            done = list(pieces.encode([x or "" for x in b.column(1).to_pylist()]))
            columns = [pa.array([x[0] for x in done], pa.list_(pa.int32())), *[pa.array([x[1] for x in done], pa.list_(pa.int64()))] * ends, pa.array([x[2] for x in done], pa.string())]
            return pa.RecordBatch.from_arrays([*b.column(0).flatten(), *columns], names=schema.names)

        return run

    return map_batches(df.select(F.struct(*(df[c] for c in keep)).alias("row"), df[text].alias("text")), schema, make)


def digests(df: DataFrame, doc_id: str, text: str, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ends): the digests of encode()'s results, and the source byte where each piece ends."""

    def make():
        pieces = load(model)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, decoded, ends = [], [], [], []
            for i, e, d in pieces.encode([x or "" for x in b.column(1).to_pylist()]):
                n.append(len(i))
                ids.append(hashlib.sha256(",".join(map(pieces.decimal.__getitem__, i)).encode()).hexdigest())
                decoded.append(hashlib.sha256(d.encode()).hexdigest())
                ends.append(e)
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *ends]), pa.int64()))
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), spans],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends"],
            )

        return run

    source = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return map_batches(source, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends array<long>", make)
