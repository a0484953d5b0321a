"""Parsers: a text to a tree of nodes, as nested (kind, start, end, children, name) over the text's characters."""

from __future__ import annotations

import ast
import io
import json
import re
import tokenize
from collections.abc import Callable
from dataclasses import dataclass, field


from palimpsest.functions.languages import BRACES, SCRIPTS


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    name: str | None = None


class Unparsed(Exception):
    """The text is not of the language."""


_JSON = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)|(?P<mark>[{}\[\],:]))""", re.S)


def parse_json(text: str) -> Node:
    """document > object > pair > (key, value), array, string, number, true, false, null."""
    root = Node("document", 0, len(text))
    stack = [root]
    key: Node | None = None
    for m in _tokens(_JSON, text):
        kind = m.lastgroup
        start, end = m.span(kind)
        top = stack[-1]
        if kind == "mark":
            c = m[kind]
            if c in "{[":
                node = Node("object" if c == "{" else "array", start, end)
                _value(stack, node)
                stack.append(node)
            elif c in "}]":
                while len(stack) > 1 and stack[-1].kind == "pair":
                    stack.pop()
                if len(stack) == 1 or (stack[-1].kind == "object") != (c == "}"):
                    raise Unparsed(text[:80])
                stack.pop().end = end
                _close(stack, end)
        elif top.kind == "object" and kind == "string":
            key = Node("key", start, end)
            pair = Node("pair", start, end, [key], json.loads(m[kind], strict=False))
            top.children.append(pair)
            stack.append(pair)
        else:
            _value(stack, Node(m[kind] if kind == "word" else kind, start, end))
            _close(stack, end)
    if len(stack) != 1 or len(root.children) != 1:
        raise Unparsed(text[:80])
    return root


def _tokens(pattern: re.Pattern, text: str):
    at = 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            if text[at:].strip():
                raise Unparsed(text[:80])
            return
        yield m
        at = m.end()


def _value(stack: list[Node], node: Node) -> None:
    stack[-1].children.append(node)


def _close(stack: list[Node], end: int) -> None:
    if stack[-1].kind == "pair" and len(stack[-1].children) == 2:
        stack.pop().end = end


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?P<name>[^\s=/>"']+)(?:\s*=\s*(?P<value>"[^"]*"|'[^']*'|[^\s>]+))?""")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style"}


def parse_html(text: str) -> Node:
    """document > element > (tag_name, attributes > attribute > (attribute_name, attribute_value), text, comment, element)."""
    root = Node("document", 0, len(text))
    stack = [root]
    at = 0

    def words(a: int, b: int) -> None:
        part = text[a:b]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            stack[-1].children.append(Node("text", a + lead, a + len(part.rstrip())))

    while m := _TAG.search(text, at):
        words(at, m.start())
        at = m.end()
        if not m["name"]:
            stack[-1].children.append(Node("comment" if m[0].startswith("<!--") else "doctype", m.start(), m.end()))
            continue
        name = m["name"].lower()
        if m["end"]:
            if any(n.name == name for n in stack[1:]):
                while stack[-1].name != name:
                    stack.pop().end = m.start()
                stack.pop().end = m.end()
            continue
        if name == "p" and stack[-1].name == "p":
            stack.pop().end = m.start()
        node = Node(f"{name}_element" if name in _RAW else "element", m.start(), m.end(), [Node("tag_name", *m.span("name"))], name)
        attributes = [
            Node("attribute", m.start("rest") + a.start(), m.start("rest") + a.end(), [Node("attribute_name", m.start("rest") + a.start("name"), m.start("rest") + a.end("name"))] + ([Node("attribute_value", m.start("rest") + a.start("value"), m.start("rest") + a.end("value"))] if a["value"] else []))
            for a in _ATTRIBUTE.finditer(m["rest"])
        ]
        if attributes:
            node.children.append(Node("attributes", attributes[0].start, attributes[-1].end, attributes))
        stack[-1].children.append(node)
        if name in _RAW:
            end = re.compile(f"</{name}\\s*>", re.I).search(text, at)
            stop, last = (end.start(), end.end()) if end else (len(text), len(text))
            if text[at:stop].strip():
                node.children.append(Node("raw_text", at, stop))
            node.end = at = last
        elif name not in _VOID and not m["rest"].endswith("/"):
            stack.append(node)
    words(at, len(text))
    for n in stack[1:]:
        n.end = len(text)
    return root


def parse_xml(text: str) -> Node:
    """As HTML, but names keep their case and every element must close."""
    import xml.parsers.expat as expat

    p = expat.ParserCreate("utf-8")
    try:
        p.Parse(text.encode(), True)
    except (expat.ExpatError, UnicodeEncodeError) as e:
        raise Unparsed(str(e)) from e
    return parse_html(text)


_PARTS = {ast.Load, ast.Store, ast.Del}


def parse_python(text: str) -> Node:
    """The nodes of Python's own grammar, with comments under the innermost node whose lines hold them."""
    try:
        tree = ast.parse(text)
        comments = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError, MemoryError) as e:
        raise Unparsed(str(e)) from e
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    raw = [line.encode() for line in lines]

    def place(row: int, col: int) -> int:
        return starts[row - 1] + len(raw[row - 1][:col].decode(errors="ignore"))

    def build(n: ast.AST) -> Node:
        span = (place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset)) if hasattr(n, "lineno") else None
        children = [build(c) for c in ast.iter_child_nodes(n) if type(c) not in _PARTS]
        children.sort(key=lambda c: (c.start, c.end))
        if span is None:
            span = (children[0].start, max(c.end for c in children)) if children else (-1, -1)
        start = min([span[0], *(c.start for c in children if c.start >= 0)])
        return Node(type(n).__name__, start, span[1], [c for c in children if c.start >= 0 or c.children], getattr(n, "name", None) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None)

    root = build(tree)
    root.start, root.end = 0, len(text)
    for t in comments:
        a, b = starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]
        at = root
        while inner := next((c for c in at.children if c.start <= a and b <= c.end and c.children), None):
            at = inner
        at.children.append(Node("comment", a, b))
        at.children.sort(key=lambda c: (c.start, c.end))
    return root


def parse_text(text: str) -> Node:
    """document > block (between empty lines) > line > word."""
    root = Node("document", 0, len(text))
    block: Node | None = None
    for m in re.finditer(r"[^\n]*\n?", text):
        line = m[0].rstrip("\r\n")
        if not line.strip():
            block = None
            continue
        if block is None:
            block = Node("block", m.start(), m.start())
            root.children.append(block)
        node = Node("line", m.start(), m.start() + len(line), [Node("word", m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", line)])
        block.children.append(node)
        block.end = node.end
    return root


#: Language -> parser. More are added by register(); a language without one has no tree.
PARSERS: dict[str, Callable[[str], Node]] = {"JSON": parse_json, "HTML": parse_html, "XML": parse_xml, "Python": parse_python, "Text": parse_text, "MarkDown": parse_text}


def register(language: str, parser: Callable[[str], Node]) -> None:
    PARSERS[language] = parser


def parse(text: str, language: str | None) -> Node | None:
    """The tree of a text, or None without a parser or where it fails."""
    if language in BRACES and language not in PARSERS:
        from palimpsest.operators import code  # noqa: F401  (registers them)
    if (language in SCRIPTS or language == "YAML") and language not in PARSERS:
        from palimpsest.operators import scripts  # noqa: F401  (registers them)
    parser = PARSERS.get(language or "")
    if not parser:
        return None
    try:
        return parser(text)
    except (Unparsed, RecursionError):
        return None
