"""A parser for languages of braces: one grammar of brackets, statements and calls for all of them, with what differs in a table.

document > statement > (identifier, number, string, call > (identifier..., parentheses), parentheses, brackets, block > statement...). A statement is a
function, declaration, import or <keyword>_statement where its words say so; functions and declarations have names. Operators and
separators are no nodes: they are the text between nodes, which hashes of trees take in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from palimpsest.operators.parsers import Node, Unparsed, register


@dataclass(frozen=True)
class Style:
    """How a language writes comments and strings."""

    line: str = "//"
    nested: bool = True  # whether /* */ are comments
    quotes: str = '"'  # of strings of any length
    raw: str = ""  # quotes of strings that may run over lines


C_LIKE, SCRIPT = Style(), Style(quotes="\"'", raw="`")
STYLES = {
    **dict.fromkeys(("C", "CPP", "CSharp", "Java", "Rust", "Scala", "ProtoBuf"), C_LIKE),
    "Go": Style(raw="`"), "Kotlin": Style(raw='"""'), "Swift": Style(raw='"""'), "Dart": Style(quotes="\"'", raw="'''"),
    **dict.fromkeys(("JavaScript", "TypeScript", "TSX"), SCRIPT), "PHP": Style(line="//|#(?!\\[)", quotes="\"'"), "CSS": Style(line="(?!)", quotes="\"'"),
}
FUNCTION_WORDS = {"func", "fn", "fun", "function"}
DECLARATION_WORDS = {"class", "struct", "interface", "enum", "trait", "impl", "object", "namespace", "module", "mod", "record", "protocol", "extension", "message", "service", "union", "type", "mixin"}
IMPORT_WORDS = {"import", "use", "using", "include", "require", "package", "from", "export"}
FLOW_WORDS = {"if", "else", "for", "foreach", "while", "do", "switch", "match", "when", "case", "default", "try", "catch", "finally", "return", "throw", "break", "continue", "select", "loop", "guard", "defer"}
#: Operators that a statement does not end behind, or before, at the end of a line.
OPEN_END, OPEN_START = set("+-*/%=&|^<>?:.,~"), set("+*/%=&|^<>?:.,")
CLOSING = {"{": "}", "(": ")", "[": "]"}
GROUP = {"{": "block", "(": "parentheses", "[": "brackets"}


def pattern(style: Style) -> re.Pattern:
    raw = "|".join(f"{q}(?:\\\\.|(?!{q}).)*+{q}" if q != "`" else "`(?:\\\\.|[^`\\\\])*+`" for q in ([style.raw] if style.raw else []))
    strings = "|".join(f"{q}(?:\\\\.|[^{q}\\\\\n])*+{q}" for q in style.quotes)
    chars = r"'(?:\\(?:u\{?[0-9a-fA-F]+\}?|x[0-9a-fA-F]+|.)|[^'\\\n])'"
    comments = f"(?:{style.line})[^\n]*" + (r"|/\*(?:[^*]|\*(?!/))*+\*/" if style.nested else "")
    return re.compile(
        rf"(?P<space>[ \t\r\f\v]+)|(?P<newline>\n)|(?P<comment>{comments})|(?P<string>{f'{raw}|' if raw else ''}{strings}|{chars})"
        rf"|(?P<number>\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<identifier>[^\W\d][\w$]*|[$@#][\w$]+)|(?P<open>[{{(\[])|(?P<close>[}})\]])|(?P<mark>.)",
        re.S,
    )


PATTERNS = {name: pattern(style) for name, style in STYLES.items()}


class _Open:
    """A group that is being read: its node, the statement or item under way, and the last mark before now."""

    def __init__(self, node: Node, opener: str):
        self.node, self.opener = node, opener
        self.parts: list[Node] = []
        self.words: list[str] = []


def _call(parts: list[Node], group: Node, text: str) -> Node | None:
    """The identifiers right before a group of arguments, joined by dots and colons, with it as a call."""
    n = len(parts)
    at = group.start
    while n and parts[n - 1].kind in ("identifier", "call") and text[parts[n - 1].end : at].strip() in (("", "!", "?.", "?") if n == len(parts) else (".", "::", "->", "?.", "!!.")):
        n -= 1
        at = parts[n].start
        if parts[n].kind == "call":
            break
    if n == len(parts) or text[parts[-1].start : parts[-1].end] in FLOW_WORDS | FUNCTION_WORDS | DECLARATION_WORDS:
        return None
    out = Node("call", parts[n].start, group.end, [*parts[n:], group])
    del parts[n:]
    return out


def _statement(o: _Open, text: str) -> None:
    """Close the statement (in a block) or item (in other groups) under way."""
    parts = o.parts
    if not parts:
        return
    o.parts = []
    words, o.words = o.words, []
    if o.opener not in ("", "{"):
        o.node.children.append(parts[0] if len(parts) == 1 else Node("item", parts[0].start, parts[-1].end, parts))
        return
    if len(parts) == 1 and parts[0].kind in ("comment", "block"):
        o.node.children.append(parts[0])
        return
    kind, name = "statement", None
    has_block = any(p.kind == "block" for p in parts)
    told = next((w for w in words if w in FUNCTION_WORDS | DECLARATION_WORDS), None)
    if words and words[0].lstrip("#@") in IMPORT_WORDS and not has_block:
        kind = "import"
    elif words and words[0] in FLOW_WORDS:
        kind = f"{words[0]}_statement"
    elif told and (has_block or told in FUNCTION_WORDS):
        kind = "function" if told in FUNCTION_WORDS else "declaration"
        name = _name_after(parts, told, text)
    elif has_block and (call := next((p for p in parts if p.kind == "call"), None)) and "=" not in text[parts[0].start : call.start]:
        kind, name = "function", text[call.children[-2].start : call.children[-2].end]
    o.node.children.append(Node(kind, parts[0].start, parts[-1].end, parts, name))


def _name_after(parts: list[Node], word: str, text: str) -> str | None:
    flat = [c for p in parts for c in (p.children if p.kind == "call" else [p]) if c.kind == "identifier"]
    shown = [text[c.start : c.end] for c in flat]
    return shown[shown.index(word) + 1] if word in shown and shown.index(word) + 1 < len(shown) else None


def parse_code(text: str, language: str) -> Node:
    root = Node("document", 0, len(text))
    stack = [_Open(root, "")]
    last = ""  # the last mark, if nothing but space follows it
    ended = False  # a line has ended since the last token
    for m in PATTERNS[language].finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        o = stack[-1]
        if kind == "space":
            continue
        if kind == "newline":
            ended = True
            continue
        first = text[start]
        if ended and o.opener in ("", "{") and o.parts and not (last and last in OPEN_END) and not (kind == "mark" and first in OPEN_START) and not (kind == "open" and first == "{"):
            _statement(o, text)
        ended = False
        if kind == "mark":
            last = first
            if first == ";" or (first == "," and o.opener in ("(", "[")):
                _statement(o, text)
                last = ""
            continue
        last = ""
        if kind == "open":
            stack.append(_Open(Node(GROUP[first], start, end), first))
        elif kind == "close":
            if len(stack) == 1 or CLOSING[o.opener] != first:
                raise Unparsed(text[:80])
            _statement(o, text)
            stack.pop()
            o.node.end = end
            up = stack[-1]
            call = _call(up.parts, o.node, text) if o.opener == "(" else None
            up.parts.append(call or o.node)
        elif kind == "comment" and o.opener in ("", "{") and not o.parts:
            o.node.children.append(Node("comment", start, end))
        else:
            o.parts.append(Node(kind, start, end))
            if kind == "identifier":
                o.words.append(m[0])
    _statement(stack[0], text)
    if len(stack) != 1:
        raise Unparsed(text[:80])
    return root


def _parser(language: str):
    return lambda text: parse_code(text, language)


for _name in STYLES:
    register(_name, _parser(_name))
