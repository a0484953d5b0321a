"""Secrets in text: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The patterns find assignments, access keys and long hexadecimal runs. Beyond these, each run of characters that
keys are made of, MIN_TOKEN and longer, is scored by two first-order Markov models over its characters, one
of random strings and one of ordinary identifiers and words, both counted on labelled samples (train()).
A run that has a letter and more than VARIED different characters (lines, fillers and padding have fewer; of random runs of this length not one in a million has), touches no match of a pattern, and whose log-likelihood ratio is THRESHOLD or more (LETTERS_THRESHOLD, if it
has no digit), is a span of its own, of kind "model". All of it is column expressions: no row leaves the JVM.

Places are in code points, last exclusive. Defined results: a null text is an empty one, which has no
spans; matches that fail a length are dropped, and what they covered is not searched again. Rows are searched each for itself, so repeated rows have
equal spans; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.spans import folded, places

#: Patterns, least lengths and what the length is taken of; letters of the assignment's name in either case.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
VALUE = "[A-Za-z0-9+/_.=-]+$"
LONG_HEX = "[0-9a-f]{32,}"
#: Runs that the models score, the longest ordinary words being shorter mostly; natural log units over the whole run.
MIN_TOKEN = 16
THRESHOLD = 12.0
LETTERS_THRESHOLD = 16.0
VARIED = 4
TOKEN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(SYMBOLS) + 1


def random_samples(n: int = 1500, seed: str = "keys") -> list[str]:
    """Strings drawn evenly from the alphabets that keys use: base 64, base 64 for addresses, base 62, hexadecimal, upper case with digits."""
    alphabets = [SYMBOLS[:62] + "+/", SYMBOLS[:62] + "-_", SYMBOLS[:62], "0123456789abcdef", SYMBOLS[26:62]]
    out = []
    for i in range(n):
        raw = b"".join(hashlib.sha256(f"{seed}{i}.{k}".encode()).digest() for k in range(2))
        alphabet = alphabets[i % len(alphabets)]
        out.append("".join(alphabet[b % len(alphabet)] for b in raw[: 20 + raw[63] % 24]))
    return out


#: Words that identifiers of programs are made of.
PARTS = """
get set is has to from read write open close load save find index count size length name value key type list map array node tree path file line
text word page table row column field record data info item user account group order event message request response session server client host
port address config option default global local public private static final class object method function param result error exception handler
listener manager factory builder service controller model view helper util test mock temp total average minimum maximum first last next previous
start end begin finish create update delete remove insert append copy move parse format render encode decode encrypt decrypt compress hash check
validate verify match search replace split join merge sort filter reduce transform convert compute calculate estimate schedule execute process
thread queue stack buffer cache stream channel socket network protocol version number string integer float double boolean date time zone year
month day hour minute second the and that with this have for not are but what all were when your can there use each which how their other about
international communication responsibility understanding administration transformation environment independent characteristics infrastructure
""".split()


def ordinary_samples(n: int = 3000, seed: str = "names") -> list[str]:
    """Identifiers, file names and words, joined in the ways that programs and texts join them."""
    out = list(PARTS)
    for i in range(n):
        raw = hashlib.sha256(f"{seed}{i}".encode()).digest()
        words = [PARTS[int.from_bytes(raw[2 * k : 2 * k + 2], "big") % len(PARTS)] for k in range(2 + raw[20] % 4)]
        style = raw[21] % 8
        number = str(raw[22] % 100 + (1900 if raw[23] % 4 == 0 else 0)) if raw[24] % 4 == 0 else ""
        if style == 0:
            s = words[0] + "".join(w.capitalize() for w in words[1:]) + number
        elif style == 1:
            s = "".join(w.capitalize() for w in words) + number
        elif style == 2:
            s = "_".join(words) + ("_" + number if number else "")
        elif style == 3:
            s = "-".join(words) + ("-" + number if number else "")
        elif style == 4:
            s = "_".join(words).upper() + ("_" + number if number else "")
        elif style == 5:
            s = "/".join(words) + number
        elif style == 6:  # dates and times
            y, m, d, h = 1980 + raw[25] % 60, 1 + raw[26] % 12, 1 + raw[27] % 28, raw[28] % 24
            s = (f"{y}-{m:02}-{d:02}T{h:02}-{raw[29] % 60:02}-{raw[30] % 60:02}Z", f"{words[0]}-{y}-{m:02}-{d:02}", f"{words[0]}_{y}{m:02}{d:02}_{h:02}{raw[29] % 60:02}{raw[30] % 60:02}")[raw[31] % 3]
        else:  # numbered things
            s = f"{words[0]}-{int.from_bytes(raw[25:28], 'big')}-{int.from_bytes(raw[28:31], 'big')}"
        out.append(s)
    return out


def train(samples: Iterable[tuple[str, int]]) -> list[float]:
    """Log-likelihood ratios of each pair of characters (first * SIZE + second; 0 stands for any other and for the start), from (string, 1 if random)."""
    place = {c: i + 1 for i, c in enumerate(SYMBOLS)}
    pairs: tuple[Counter, Counter] = (Counter(), Counter())
    firsts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in samples:
        last = 0
        for c in text:
            now = place.get(c, 0)
            pairs[label][last, now] += 1
            firsts[label][last] += 1
            last = now
    odds = lambda k, a, b: (pairs[k][a, b] + 0.5) / (firsts[k][a] + 0.5 * SIZE)
    return [math.log(odds(1, a, b) / odds(0, a, b)) for a in range(SIZE) for b in range(SIZE)]


@functools.lru_cache(1)
def default_model() -> tuple[float, ...]:
    return tuple(train([*((s, 1) for s in random_samples()), *((s, 0) for s in ordinary_samples())]))


def ratio(token: Column, model: Iterable[float]) -> Column:
    """Log-likelihood ratio of a string, random against ordinary."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    at = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(SYMBOLS), c))
    return F.aggregate(
        at,
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.element_at(table, s["last"] * SIZE + x + 1)).alias("sum")),
        lambda s: s["sum"],
    )


def _kind(name: str, found: Column, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["first"].alias("first"), F.lit(order).alias("order"), x["last"].alias("last"), F.lit(name).alias("kind")))


def with_rows(df: DataFrame, text: str, model: Iterable[float] | None = None) -> DataFrame:
    """(row: a struct of df's columns, spans: array<struct<first, order, last, kind>>, all spans by place, then by kind as listed above)."""
    model = default_model() if model is None else model
    t = F.coalesce(df[text].cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<first:int,last:int,word:string>>)")

    def where(pattern: str, found: Column) -> Column:
        return F.when(t.rlike(pattern), found).otherwise(none)

    # columns of their own: the optimiser keeps what is costly and used twice from being worked out twice
    patterns = {
        "_assign": where(ASSIGN, F.filter(places(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["word"], ASSIGN, 2)) >= 8)),
        "_access": where(ACCESS, F.filter(places(t, ACCESS), lambda x: F.length(x["word"]) >= 16)),
        "_hex": where(LONG_HEX, places(t, LONG_HEX)),
        "_likely": where(TOKEN, F.filter(places(t, TOKEN), lambda x: x["word"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.regexp_extract_all(x["word"], F.lit("."), F.lit(0)))) > VARIED))),
    }
    found = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), *(c.alias(n) for n, c in patterns.items()))
    base = F.concat(_kind("assign", F.col("_assign"), 0), _kind("access", F.col("_access"), 1), _kind("hex", F.col("_hex"), 2))
    found = found.select("row", "_likely", base.alias("_base"))
    scored = F.filter(
        "_likely",
        lambda x: ~F.exists("_base", lambda b: (b["first"] < x["last"]) & (x["first"] < b["last"])) & (ratio(x["word"], model) >= F.when(x["word"].rlike("[0-9]"), THRESHOLD).otherwise(LETTERS_THRESHOLD)),
    )
    return found.select("row", F.array_sort(F.concat("_base", _kind("model", scored, 3))).alias("spans"))


def with_secrets(df: DataFrame, text: str, into: str = "secrets", model: Iterable[float] | None = None) -> DataFrame:
    """df with the spans of its secrets, in place of a column of that name."""
    return with_rows(df, text, model).select(*(F.col("row")[c].alias(c) for c in df.columns if c != into), F.col("spans").alias(into))


def listed(spans: Column) -> Column:
    """kind:first:last of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["order"] < 3)


def _of(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def digests(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans)."""
    found = with_secrets(df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")), "text")
    s = F.col("secrets")
    return found.select(
        "doc_id",
        *(F.size(_of(s, k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "model")),
        F.sha2(listed(base_spans(s)), 256).alias("base_sha256"),
        listed(s).alias("spans"),
    )


def redacted(df: DataFrame, text: str, mark: str = "[SECRET]") -> DataFrame:
    """df, all columns and rows, with each secret of the text column replaced by the mark; spans that overlap become one."""
    body, spans = F.col("row")[text], F.col("spans")

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["first"] >= s["state"], F.concat(F.substring(body, s["state"] + 1, x["first"] - s["state"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["state"], x["last"]).alias("state"), F.concat(s["out"], F.array(gap)).alias("out"))

    after = F.substring(body, F.array_max(F.transform(spans, lambda x: x["last"])) + 1, F.length(body))
    parts = F.concat(F.array_join(folded(spans, F.lit(0), step, "array<string>"), ""), after)
    new = F.when(F.size(spans) > 0, parts).otherwise(body)
    return with_rows(df, text).select(*((new if c == text else F.col("row")[c]).alias(c) for c in df.columns))
