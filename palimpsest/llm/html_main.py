"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of tags and text runs. Words score positive and tags negative, with weights
counted on labelled pages (train()): pages composed at random, and a bounded sample of the table's own pages that name their article (learned()). A tag's weight is the log odds that it stands in main text, and the
names of elements (tag, classes, id, role) whose words are rarely main text mark subtrees as apart. Such a subtree
scores nothing, so that an advert in the middle does not part an article in two. One linear scan
finds the contiguous region of the highest score; where an article element (or, without one, a main element) holds at least half of its words, the region is that element, with its
title and its last line. The region's words, less those of subtrees that are apart, are the text.

Within an article the markup goes before names: a section, heading, paragraph, list or table is not judged by its id, which is there to be linked to, and a part that holds more than half of
the article's words is not apart whatever it is called.

Text of the region: character references decoded, white space within a block as one space, blocks
trimmed and joined by one newline in page order; nothing is shortened. A line break is white space.

Defined results: a null or empty page, and one without words, has an empty text; of equal regions the
first wins; unclosed tags, comments and quotes end where browsers would end them or at the end of the page. Given the weights, pages are read each for
itself, so repeated rows have equal texts (learned() takes weights from the whole table: the same for a table however its rows lie or repeat); other columns have no part in it, whatever their names.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import map_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?/][^a-zA-Z][^>]*>?|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SCOPE = re.compile(r"""\brole\s*=\s*["']?(article|main)\b""", re.I)
WORD = re.compile(r"[A-Za-z]+")
#: Elements whose content is not markup: it goes up to their own end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Never text of an article, by the meaning of the element.
APART = {"head", "script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "canvas", "object", "select", "button", "datalist", "form", "nav", "menu", "dialog"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Elements that group blocks; only of these does the tag itself say what the words are for.
SECTIONS = {"nav", "header", "footer", "aside", "section", "menu", "details", "fieldset", "figure", "table", "address"}
#: Of these, the ones that are not the text of an article they stand in.
BESIDE = {"nav", "footer", "aside", "menu"}
#: Lowest weights: of tags that part a page, and of those within a part, where a short last paragraph must outweigh its own.
LEAST, LEAST_INNER, UNKNOWN = -3.0, -0.25, -0.05
#: Pages that learned() takes at most, their longest in characters, and the words from which an article is one.
SAMPLE, LONGEST, MARKED = 300, 50_000, 30
#: Elements whose id names a place in a text, not a part of a page.
LINKED = {"section", "figure", "p", "blockquote", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Never apart themselves, whatever they are called: they hold the whole page or the article.
WHOLE = {"html", "body", "main", "article"}


@dataclass(frozen=True)
class Weights:
    word: float
    tags: dict[str, float]
    names: dict[str, float]
    least: float = -1.5

    def apart(self, name: str, rest: str, inside: bool = False) -> bool:
        """Whether an element's words are rarely main text; inside an article, its names are judged by articles where they were seen in one."""
        if name in APART:
            return True
        if name in WHOLE or scope(name, rest):
            return False
        odds = lambda x: self.names.get(f"in {x}", self.names.get(x, 0.0)) if inside else self.names.get(x, 0.0)
        own = called(rest, not (inside and name in LINKED))
        return any(odds(x) < self.least for x in ((name, *own) if name in (BESIDE if inside else SECTIONS) else own))


def called(rest: str, ids: bool = True) -> set[str]:
    """The words, in lower case and behind a point, of an element's classes, role and, on request, id."""
    return {f".{w.lower()}" for kind, value in NAMES.findall(rest) if ids or kind.lower() != "id" for w in WORD.findall(value)} if "=" in rest else set()


def scope(name: str, rest: str) -> str | None:
    """article or main, for elements that are such by tag or role."""
    if name in ("article", "main"):
        return name
    m = SCOPE.search(rest) if "=" in rest else None
    return m[1].lower() if m else None


def tokens(page: str):
    """(kind, value, rest): "open" or "close" with a tag's name, "text" with a run of text."""
    at = 0
    while True:
        m = TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if m["end"]:
            yield "close", name, ""
            continue
        yield "open", name, m["rest"]
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                yield "text", page[at:stop], ""
            at = stop
    if at < len(page):
        yield "text", page[at:], ""


def nested(seen: list[tuple[str, str, str]]) -> list[int]:
    """For each token the place of the open element it stands in, -1 for none; an end tag stands in the element it closes.

    An end tag closes the nearest open element of its name, but none around an article from inside it; where each name is open is kept, so that no tag searches the stack.
    """
    up: list[int] = []
    stack: list[int] = []
    open_at: dict[str, list[int]] = {}
    held = [-1]  # where elements are open that no other name's end tag closes
    for k, (kind, value, _) in enumerate(seen):
        if kind == "open":
            if value == "p" and stack and seen[stack[-1]][1] == "p":
                stack.pop()
                open_at["p"].pop()
            up.append(stack[-1] if stack else -1)
            if value not in VOID:
                open_at.setdefault(value, []).append(len(stack))
                if value in ("article", "main", "body"):
                    held.append(len(stack))
                stack.append(k)
        elif kind == "close":
            at = open_at[value][-1] if open_at.get(value) else -1
            closes = at >= 0 and (at > held[-1] or value in WHOLE)
            up.append(stack[at] if closes else stack[-1] if stack else -1)
            while closes and len(stack) > at:
                open_at[seen[stack.pop()][1]].pop()
                if held[-1] == len(stack):
                    held.pop()
        else:
            up.append(stack[-1] if stack else -1)
    return up


class Parsed:
    """The tokens of a page, which of them lie apart, which tags stand inside an article, and the elements that are articles."""

    def __init__(self, page: str, weights: Weights) -> None:
        self.seen = seen = list(tokens(page))
        up = nested(seen)
        n = len(seen)
        words = [len(value.split()) if kind == "text" and (up[k] < 0 or seen[up[k]][1] not in RAW) else 0 for k, (kind, value, _) in enumerate(seen)]
        self.words = list(words)
        for k in range(n - 1, -1, -1):  # of an element: all below it
            if up[k] >= 0:
                words[up[k]] += words[k]
        total = sum(self.words)
        self.apart, self.inside, self.articles = [False] * n, [False] * n, []
        article = [-1] * n  # the innermost article around or at a token
        last = list(range(n))
        for k, (kind, value, rest) in enumerate(seen):
            above = up[k]
            article[k] = article[above] if above >= 0 else -1
            self.apart[k] = above >= 0 and self.apart[above]
            if kind == "open":
                self.inside[k] = article[k] >= 0
                if not self.apart[k] and weights.apart(value, rest, self.inside[k]):
                    # what holds most of an article, or as a form most of a page, wraps it
                    around = words[article[k]] if article[k] >= 0 and value not in APART else total if value == "form" else 0
                    self.apart[k] = 2 * words[k] <= around or not around
                if kind_ := scope(value, rest):
                    if not self.apart[k]:
                        self.articles.append((kind_, k))
                    article[k] = k
            elif kind == "close":
                self.inside[k] = article[k] >= 0 and article[k] != above
        for k in range(n - 1, -1, -1):
            if up[k] >= 0:
                last[up[k]] = max(last[up[k]], last[k])
        self.last = last

    def around(self, first: int, after: int) -> tuple[int, int]:
        """The article, or else main element, that holds at least half of a region's words, or the region; the outermost first."""
        shown = [0]
        for n, apart in zip(self.words, self.apart, strict=True):
            shown.append(shown[-1] + (0 if apart else n))
        for name in ("article", "main"):
            for kind, a in self.articles:
                z = self.last[a] + 1
                if kind == name and shown[min(z, after)] - shown[min(max(a, first), min(z, after))] > 0 and 2 * (shown[min(z, after)] - shown[max(a, first)]) >= shown[after] - shown[first]:
                    return a, z
        return first, after


def region(scores: list[float]) -> tuple[int, int]:
    """First and after-last place of the contiguous run of the highest sum; (0, 0) if no sum is positive."""
    best = low = total = 0.0
    start = 0
    found = (0, 0)
    for i, s in enumerate(scores):
        total += s
        if total - low > best:
            best, found = total - low, (start, i + 1)
        if total <= low:
            low, start = total, i + 1
    return found


def extract(page: str, weights: Weights) -> str:
    p = Parsed(page, weights)

    def score(k: int, kind: str, value: str) -> float:
        if p.apart[k]:
            return 0.0
        if kind == "text":
            return weights.word * p.words[k]
        return max(weights.tags.get(value, UNKNOWN), LEAST_INNER if p.inside[k] else LEAST)

    first, after = region([score(k, kind, value) for k, (kind, value, _) in enumerate(p.seen)])
    if after:
        first, after = p.around(first, after)
    blocks: list[str] = []
    parts: list[str] = []
    for k in range(first, after):
        kind, value, _ = p.seen[k]
        if kind == "text":
            if not p.apart[k]:
                parts.append(html.unescape(value))
        elif value in BLOCKS:
            blocks.append("".join(parts))
            parts = []
        elif value == "br":
            parts.append(" ")
    blocks.append("".join(parts))
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def train(pages: Iterable[tuple[str, str]]) -> Weights:
    """Weights from (html, main text) pairs. A text run counts as main text if its words lie within the main text."""
    neutral = Weights(1.0, {}, {}, -math.inf)
    tags: Counter = Counter()
    inside: Counter = Counter()
    names: Counter = Counter()
    of_main: Counter = Counter()
    words = Counter()
    for page, main in pages:
        main = f" {' '.join(main.split())} "
        stack: list[tuple[str, set[str]]] = []
        recent = False
        pending: list[str] = []
        for kind, value, rest in tokens(page):
            if kind == "text":
                t = " ".join(html.unescape(value).split())
                if not t:
                    continue
                is_main = t in main and not any(n in APART for n, _ in stack)
                n = len(t.split())
                words[is_main] += n
                around = [k for k, (name, _) in enumerate(stack) if name in ("article", "main")]
                for x in {("in " if around and k > around[0] else "") + x for k, (name, more) in enumerate(stack) for x in (name, *more)}:
                    names[x] += n
                    of_main[x] += n * is_main
                for x in pending:  # tags between two runs belong to the main text if both of them do
                    tags[x] += 1
                    inside[x] += recent and is_main
                pending, recent = [], is_main
                continue
            pending.append(value)
            if kind == "open" and value not in VOID:
                stack.append((value, called(rest)))
            elif kind == "close" and any(n == value for n, _ in stack):
                while stack.pop()[0] != value:
                    pass
        for x in pending:
            tags[x] += 1
    odds = lambda a, n: math.log((a + 1) / (n - a + 1))
    base = odds(words[True], words[True] + words[False])
    return Weights(
        word=max(0.5, min(1.0, base)),
        tags={x: min(-0.05, max(LEAST if x in SECTIONS | WHOLE | {"div", "head"} else LEAST_INNER, odds(inside[x], n))) for x, n in tags.items()},
        names={x: odds(of_main[x], n) for x, n in names.items()},
        least=neutral.least if not names else -1.5,
    )


def labelled(pages: int = 300, seed: int = 7) -> list[tuple[str, str]]:
    """Pages with their main text, composed at random from the parts that pages have; all words are made up."""
    r = random.Random(seed)
    sound = "ka lo mi ne ru ta vo sil dor pen ash wer".split()

    def prose(a: int, b: int) -> str:
        return " ".join("".join(r.choices(sound, k=r.randint(1, 4))) for _ in range(r.randint(a, b))).capitalize() + "."

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(r.randint(a, b))) + "</ul>"

    #: Names that pages give to parts which are not of the article.
    other = {
        "advert": ["ad", "ads", "advert", "advertisement", "adsbox", "banner", "sponsor", "sponsored", "promo", "promotion"],
        "side": ["sidebar", "aside", "widget", "related", "recommended", "trending", "tags", "complementary"],
        "menu": ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "toolbar", "topbar"],
        "top": ["header", "masthead", "logo", "site-header"],
        "bottom": ["footer", "copyright", "colophon", "site-footer", "contentinfo", "legal"],
        "note": ["cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "alert"],
        "talk": ["comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus"],
        "share": ["share", "sharing", "social", "follow", "login", "search", "paywall"],
    }
    tag_of = {"side": "aside", "menu": "nav", "top": "header", "bottom": "footer"}

    def part(kind: str) -> str:
        name = r.choice(other[kind])
        tag = tag_of[kind] if kind in tag_of and r.random() < 0.5 else r.choice(["div", "div", "section"])
        attr = f' {r.choice(["class", "class", "id"])}="{name}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        body = {"menu": lambda: links(3, 9), "bottom": lambda: f"&copy; {prose(3, 14)}", "top": lambda: f"<h1>{prose(1, 4)}</h1>"}.get(kind)
        text = body() if body else r.choice([lambda: prose(4, 30), lambda: f"<p>{prose(4, 30)}</p>" * r.randint(1, 3), lambda: links(2, 6)])()
        return f"<{tag}{attr}>{text}</{tag}>"

    out = []
    for _ in range(pages):
        lines, main = [], []
        for k in range(r.randint(2, 12)):
            t = prose(6, 60)
            main.append(t)
            linked = t.replace(" ", f' <a href="/{k}">', 1).replace(" ", "\0", 2).replace(" ", "</a> ", 1).replace("\0", " ") if t.count(" ") > 4 and r.random() < 0.3 else t
            tag = "h1" if not k else r.choice(["p", "p", "p", "p", "p", "h2", "blockquote", "li"])
            lines.append(f"<ul><li>{linked}</li></ul>" if tag == "li" else f"<{tag}>{linked}</{tag}>")
        if r.random() < 0.5:
            lines.insert(r.randint(1, len(lines)), part(r.choice(["advert", "share", "note", "side", "talk", "bottom"])))
        tag, attr = r.choice([("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="post"'), ("section", ' class="entry body text"')])
        if tag in WHOLE and r.random() < 0.4:  # a title may have a header of its own
            lines[0] = r.choice(["<header>{}</header>", '<header class="post-header">{}</header>', '<div class="entry-header">{}</div>', '<div id="article-header">{}</div>']).format(lines[0])
        before = [part(k) for k in ("note", "top", "menu", "advert") if r.random() < 0.7]
        after = [part(k) for k in ("side", "talk", "share", "note", "bottom") if r.random() < 0.6]
        out.append(
            (
                f"<html><head><title>{main[0]}</title><style>p{{}}</style></head><body>{''.join(before)}<{tag}{attr}>{''.join(lines)}</{tag}>{''.join(after)}</body></html>",
                "\n".join(main),
            )
        )
    return out


@functools.lru_cache(1)
def default_weights() -> Weights:
    return train(labelled())


def self_labelled(pages: Iterable[str], weights: Weights) -> list[tuple[str, str]]:
    """(page, main text) of pages that name their article themselves: those with one article element (or, without one, one main element) of MARKED words."""
    out = []
    for page in pages:
        for name in ("article", "main"):
            found = re.findall(f"<{name}[\\s>].*?(?:</{name}\\s*>|\\Z)", page, re.S | re.I)
            if found:
                main = extract(found[0], weights) if len(found) == 1 else ""
                if len(main.split()) >= MARKED:
                    out.append((page, main))
                break
    return out


def learned(df: DataFrame, page: str, sample: int = SAMPLE) -> Weights:
    """Weights from composed pages and from at most `sample` different pages of df that name their article themselves: those of the least hash, none longer than LONGEST characters.

    So the names that a site gives to its parts, whatever they are, are learned from where its own pages put them. `sample` hashes and pages of bounded length reach the driver.
    """
    short = df.where(F.length(df[page]) <= LONGEST).select(df[page].alias("page"), F.xxhash64(df[page]).alias("h"))
    least = [r.h for r in short.select("h").distinct().orderBy("h").limit(sample).collect()]
    chosen = [r.page for r in short.where(F.col("h").isin(least)).groupBy("h").agg(F.min("page").alias("page")).select("page").collect()] if least else []
    return train([*labelled(), *self_labelled(sorted(chosen), default_weights())])


def main_text(df: DataFrame, page: str, keep: list[str], weights: Weights | None = None) -> DataFrame:
    """The keep columns with text (the main text) and n_chars (its code points), in place of columns of these names."""
    keep = [c for c in keep if c not in ("text", "n_chars")]
    weights = weights or default_weights()
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [extract(x, weights) if x else "" for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([*b.column(0).flatten(), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=schema.names)

        return run

    return map_batches(df.select(F.struct(*(df[c] for c in keep)).alias("row"), df[page].alias("page")), schema, make)
