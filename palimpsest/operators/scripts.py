"""Parsers for languages whose blocks are told by words (Ruby, Lua, shell, Vim script) or by indentation (YAML).

Scripts have the kinds of operators.code: document > statement > (identifier, number, string, call, parentheses, brackets, block > statement...). What
opens, parts and closes a block is a table for each language. YAML is document > (pair > (key, scalar, flow, ...), item > ..., comment).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

from palimpsest.operators.parsers import Node, Unparsed, register

CLOSING = {"{": "}", "(": ")", "[": "]"}
#: What a header waits for before its block: a word, the end of its line, its parameters, or nothing.
LINE, PARAMETERS, NOW = "line", "(", ""


@dataclass(frozen=True)
class Words:
    """How a language writes tokens, and which words open, part and close its blocks."""

    comment: str
    string: str
    identifier: str
    opens: dict[str, str]  # word -> what its block waits for
    parts: dict[str, str]  # the same for words between two blocks of a statement
    closes: re.Pattern
    begins: frozenset = frozenset()  # words that end a header, beside the end of its line
    free: bool = False  # whether words that close or part do so anywhere, not only where a statement starts
    first_only: frozenset = frozenset()  # parting words that, in a free language, part only where a statement starts
    anywhere: frozenset = frozenset()  # words that open a block in the middle of a statement
    before: frozenset = frozenset()  # marks behind which any opening word opens a block
    ends: frozenset = frozenset()  # marks behind which a line goes on
    starts: frozenset = frozenset()  # marks with which a line goes on
    heredoc: str = "(?!)"
    braces: bool = True  # whether braces hold statements
    loose: bool = False  # whether a closing bracket may stand alone
    lines: bool = False  # whether brackets end with their line
    separators: frozenset = frozenset(";")
    functions: frozenset = frozenset()
    declarations: frozenset = frozenset()
    imports: frozenset = frozenset()
    tokens: re.Pattern = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "tokens", re.compile(
            rf"(?P<space>[ \t\r\f\v]+|\\\r?\n)|(?P<newline>\n)|(?P<comment>{self.comment})|(?P<heredoc>{self.heredoc})|(?P<string>{self.string})"
            rf"|(?P<number>\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<identifier>{self.identifier})|(?P<open>[{{(\[])|(?P<close>[}})\]])|(?P<mark>\|\||&&|&\.|::|\\.|.)",
            re.S | re.M,
        ))


RUBY = Words(
    comment=r"#[^\n]*|^=begin\b(?:(?!^=end).)*+(?:^=end[^\n]*)?",
    string=(
        r'"(?:\\.|#\{(?:[^{}"]|"[^"\n]*"|\{[^{}]*\})*+\}|[^"\\])*+"|\'(?:\\.|[^\'\\])*+\'|`(?:\\.|[^`\\])*+`|(?:%[wWiIqQrxs]|(?<=[=(,]\s)%)(?:\[(?:[^\[\]]|\[[^\[\]]*\])*+\]'
        r"|\((?:[^()]|\([^()]*\))*+\)|\{(?:[^{}]|\{[^{}]*\})*+\}|<[^>]*>|\|[^|]*\|)|(?<=[(,=~!|&\s])/(?![\s=])(?:\\.|[^/\\\n])++/[a-z]*"
    ),
    identifier=r":?[^\W\d]\w*(?:[?!](?!=))?(?::(?!:))?|[@$]{1,2}\w+",
    opens={**dict.fromkeys(("if", "unless", "while", "until", "for", "case", "class", "module", "def"), LINE), "begin": NOW, "do": NOW},
    parts={**dict.fromkeys(("elsif", "when", "rescue", "in"), LINE), "else": NOW, "ensure": NOW},
    closes=re.compile("end"), begins=frozenset(("then", "do")), free=True, first_only=frozenset(("rescue", "in")), anywhere=frozenset(("def", "do")),
    before=frozenset(("=", "(", "|", "||", "&&", ",", "[", "{", "<", "!")), ends=frozenset(("+", "-", "*", "/", "%", "=", "&&", "||", "^", "<", ".", "&.", ",", "::")),
    starts=frozenset((".", "&.", "||", "&&", "?")), heredoc=r"<<[-~]?(?P<q>['\"]?)(?P<tag>[A-Z_]\w*)(?P=q)",
    functions=frozenset(("def",)), declarations=frozenset(("class", "module")), imports=frozenset(("require", "require_relative", "include", "extend", "load")),
)
LUA = Words(
    comment=r"--\[(?P<c>=*)\[.*?(?:\](?P=c)\]|\Z)|--[^\n]*",
    string=r'\[(?P<s>=*)\[.*?(?:\](?P=s)\]|\Z)|"(?:\\.|[^"\\\n])*+"|\'(?:\\.|[^\'\\\n])*+\'',
    identifier=r"[^\W\d]\w*",
    opens={"function": PARAMETERS, "if": "then", "for": "do", "while": "do", "do": NOW, "repeat": NOW},
    parts={"elseif": "then", "else": NOW},
    closes=re.compile("end|until"), free=True, anywhere=frozenset(("function", "if", "for", "while", "do", "repeat")),
    ends=frozenset("+-*/%=^<>.,~"), starts=frozenset("+*/%=^<>.,:"), braces=False,
    functions=frozenset(("function",)), imports=frozenset(("require", "dofile")),
)
SHELL = Words(
    comment=r"(?<!\S)#[^\n]*",
    string=(
        r"\"(?:\\.|\$\((?:\\.|[^()\"'\\]|'[^']*'|\"(?:\\.|[^\"\\])*+\"|\((?:[^()\"']|'[^']*'|\"[^\"]*\")*+\))*+\)|\$\{(?:[^{}\"]|\"[^\"{}]*\")*+\}|[^\"\\])*+\""
        r"|\$'(?:\\.|[^'\\])*+'|'[^']*'|`(?:\\.|[^`\\])*+`"
    ),
    identifier=r"[^\W\d][\w-]*|\$(?:\w+|[#?@*!$-])",
    opens={"if": "then", "while": "do", "until": "do", "for": "do", "select": "do", "case": "in"},
    parts={"elif": "then", "else": NOW},
    closes=re.compile("fi|done|esac"), before=frozenset(("|", "||", "&&", "&", "!")), ends=frozenset(("|", "||", "&&")),
    heredoc=r"(?<!<)<<-?[ \t]*(?P<q>['\"]?)(?P<tag>[A-Za-z_]\w*)(?P=q)", loose=True,
    functions=frozenset(("function",)), imports=frozenset(("source",)),
)
VIM = Words(
    comment=r"(?<![^\n])[ \t]*\"[^\n]*|\"(?!(?:\\.|[^\"\\\n])*+\")[^\n]*",
    string=r"\"(?:\\.|[^\"\\\n])*+\"|'(?:''|[^'\n])*+'",
    identifier=r"[&$@]?[^\W\d][\w:#]*",
    opens=dict.fromkeys(("if", "for", "while", "try", "function", "func", "fu", "fun", "def"), LINE),
    parts=dict.fromkeys(("else", "elseif", "catch", "finally"), LINE),
    closes=re.compile("end?(?:if?)?|endf[a-z]*|endw[a-z]*|endt[a-z]*|enddef"), starts=frozenset("\\"), braces=False, loose=True, lines=True, separators=frozenset("|"),
    functions=frozenset(("function", "func", "fu", "fun", "def")), imports=frozenset(("source", "runtime", "import")),
)
LANGUAGES = {"LUA": LUA, "ShellScript": SHELL, "Vimscript": VIM}
FLOW = {"if", "unless", "while", "until", "for", "case", "begin", "select", "try", "repeat", "do", "return", "break", "next"}


class _Frame:
    """A group or block that is being read: its node, the statement or item under way, and what a header in it waits for."""

    def __init__(self, node: Node, opener: str):
        self.node, self.opener = node, opener
        self.parts: list[Node] = []
        self.words: list[str] = []
        self.waits: str | None = None


class _Reader:
    def __init__(self, text: str, words: Words):
        self.text, self.w = text, words
        self.root = Node("document", 0, len(text))
        self.stack = [_Frame(self.root, "")]
        self._lines: dict[str, list[int]] | None = None

    def line_of(self, tag: str, at: int) -> int:
        """The end of the next line that is nothing but the tag."""
        if self._lines is None:
            self._lines = defaultdict(list)
            for m in re.finditer(r"^[ \t]*(\w+)[ \t\r]*$", self.text, re.M):
                self._lines[m[1]].append(m.end(1))
        ends = self._lines.get(tag, [])
        i = bisect_left(ends, at)
        if i == len(ends):
            raise Unparsed(tag)
        return ends[i]

    def holds_statements(self, f: _Frame) -> bool:
        return f.opener in ("", "word") or (f.opener == "{" and self.w.braces)

    def open_block(self, at: int) -> None:
        self.stack[-1].waits = None
        self.stack.append(_Frame(Node("block", at, at), "word"))

    def close_block(self) -> _Frame:
        f = self.stack.pop()
        if f.opener != "word":
            raise Unparsed(self.text[:80])
        self.statement(f)
        up = self.stack[-1]
        if kids := f.node.children:
            f.node.start, f.node.end = kids[0].start, kids[-1].end
            up.parts.append(f.node)
        return up

    def close_groups(self) -> None:
        """Close all groups that are open where a line has ended."""
        while (f := self.stack[-1]).opener in CLOSING:
            self.statement(f)
            self.stack.pop()
            f.node.end = f.node.children[-1].end if f.node.children else f.node.start + 1
            self.stack[-1].parts.append(f.node)

    def statement(self, f: _Frame) -> None:
        """Close the statement (in a block) or item (in other groups) under way."""
        parts, words = f.parts, f.words
        f.parts, f.words, f.waits = [], [], None
        if not parts:
            return
        if not self.holds_statements(f):
            f.node.children.append(parts[0] if len(parts) == 1 else Node("item", parts[0].start, parts[-1].end, parts))
            return
        if len(parts) == 1 and parts[0].kind in ("comment", "block"):
            f.node.children.append(parts[0])
            return
        kind, name = "statement", None
        block = any(p.kind == "block" for p in parts)
        told = next((x for x in words if x in self.w.functions | self.w.declarations), None)
        if told and (told in self.w.functions or words[0] == told):
            kind = "function" if told in self.w.functions else "declaration"
            name = self.name_after(parts, told)
        elif words and words[0] in FLOW:
            kind = f"{words[0]}_statement"
        elif not block and any(x in self.w.imports for x in words[:3]):
            kind = "import"
        elif parts[0].kind == "call" and parts[-1].kind == "block" and len(parts) == 2 and self.w is SHELL:
            kind, name = "function", self.text[parts[0].start : parts[0].children[-1].start]
        f.node.children.append(Node(kind, parts[0].start, parts[-1].end, parts, name))

    def name_after(self, parts: list[Node], word: str) -> str | None:
        at = next((i for i, p in enumerate(parts) if self.text[p.start : p.end] == word), len(parts))
        for p in parts[at + 1 : at + 2]:
            if p.kind == "call":
                return self.text[p.start : p.children[-1].start]
            if p.kind == "identifier":
                return self.text[p.start : p.end]
        return None

    def call(self, parts: list[Node], group: Node) -> Node | None:
        """The identifiers right before a group of arguments, joined by dots and colons, with it as a call."""
        n = len(parts) - 1
        if n < 0 or parts[n].kind not in ("identifier", "call") or parts[n].end != group.start or self.text[parts[n].start : parts[n].end] in self.w.opens:
            return None
        while n and parts[n - 1].kind in ("identifier", "call") and self.text[parts[n - 1].end : parts[n].start] in (".", ":", "::", "&."):
            n -= 1
        out = Node("call", parts[n].start, group.end, [*parts[n:], group])
        del parts[n:]
        return out

    def word(self, node: Node, last: str) -> None:
        w, f, said = self.w, self.stack[-1], self.text[node.start : node.end]
        plain = last not in (".", "&.", "::") and not (f.words and f.words[-1] == "def" and f.parts[-1].kind == "identifier")
        starts = not f.parts
        if plain and w.closes.fullmatch(said) and (w.free or starts) and (f.waits is not None or f.opener == "word"):
            if f.waits is None:
                f = self.close_block()
            f.waits = None
        elif plain and said in w.parts and (starts or (w.free and said not in w.first_only) or f.waits == LINE) and (f.waits is not None or f.opener == "word"):
            if f.waits is None:
                f = self.close_block()
            f.parts.append(node)
            f.words.append(said)
            if w.parts[said] == NOW:
                self.open_block(node.end)
            else:
                f.waits = w.parts[said]
            return
        elif plain and f.waits is not None and (said == f.waits or (f.waits == LINE and said in w.begins)):
            f.parts.append(node)
            self.open_block(node.end)
            return
        elif plain and said in w.opens and f.waits is None and (starts or said in w.anywhere or last in w.before):
            f.parts.append(node)
            f.words.append(said)
            if w.opens[said] == NOW:
                self.open_block(node.end)
            else:
                f.waits = w.opens[said]
            return
        f.parts.append(node)
        f.words.append(said)

    def read(self) -> Node:
        w, text, at = self.w, self.text, 0
        last, ended = "", False  # the last mark, if nothing but space follows it; whether a line has ended since
        while at < len(text):
            m = w.tokens.match(text, at)
            kind, start, at = m.lastgroup, m.start(), m.end()
            if kind == "space":
                continue
            if kind == "newline":
                ended = True
                continue
            if ended and w.lines and m[0][0] != "\\":
                self.close_groups()
            f = self.stack[-1]
            if ended and f.parts and last not in w.ends and not (kind == "mark" and m[0][0:2] in w.starts | {s + m[0][1:2] for s in w.starts if m[0][0] == "\\"}):
                if f.waits == LINE:
                    self.open_block(start)
                elif f.waits is None and self.holds_statements(f):
                    self.statement(f)
                f = self.stack[-1]
            ended = False
            if kind == "mark":
                last = m[0]
                if last in ("'", '"', "`") and w is not VIM:
                    raise Unparsed(text[start : start + 80])
                if last in w.separators and f.waits == LINE:
                    self.open_block(at)
                elif (last in w.separators and f.waits is None) or (last == "," and not self.holds_statements(f)):
                    self.statement(f)
                continue
            if kind == "comment":
                lead = len(m[0]) - len(m[0].lstrip())
                node = Node("comment", start + lead, at)
                (f.node.children if self.holds_statements(f) and not f.parts else f.parts).append(node)
                continue
            if kind == "open":
                self.stack.append(_Frame(Node("block" if m[0] == "{" and w.braces else "parentheses" if m[0] == "(" else "brackets", start, at), m[0]))
            elif kind == "close":
                if CLOSING.get(f.opener) != m[0]:
                    if w.loose:
                        last = m[0]
                        continue
                    raise Unparsed(text[:80])
                self.statement(f)
                self.stack.pop()
                f.node.end = at
                up = self.stack[-1]
                up.parts.append((self.call(up.parts, f.node) if m[0] == ")" else None) or f.node)
                if up.waits == PARAMETERS and m[0] == ")":
                    self.open_block(at)
            elif kind == "identifier":
                self.word(Node(kind, start, at), last)
            else:
                if kind == "heredoc":
                    at = self.line_of(m["tag"], at)
                f.parts.append(Node("string" if kind == "heredoc" else kind, start, at))
            last = ""
        if w.lines:
            self.close_groups()
        if len(self.stack) != 1 or self.stack[0].waits:
            raise Unparsed(text[:80])
        self.statement(self.stack[0])
        return self.root


_YAML_ITEM = re.compile(r"-(?=[ \t\r]|$)[ \t]*")
_YAML_KEY = re.compile(r"""(?P<key>"(?:\\.|[^"\\])*+"|'(?:''|[^'])*+'|[^\s#\[\]{},"'&*!|>%@`-][^:#\n]*?(?::(?=\S)[^:#\n]*?)*|-\S[^:#\n]*?|[?&*!][^\s:]*)[ \t]*:(?=[ \t\r]|$)[ \t]*""")
_YAML_FLOW = re.compile(r"""[^\s\[\]{},:"'][^\[\]{},:"']*|"(?:\\.|[^"\\])*+"|'(?:''|[^'])*+'""")
_YAML_QUOTED = re.compile(r""""(?:\\.|[^"\\])*+"|'(?:''|[^'])*+'""")
_YAML_COMMENT = re.compile(r"(?:^|(?<=[ \t]))#[^\n]*")


def parse_yaml(text: str) -> Node:
    """document > (pair > (key, value...), item > value..., comment), by the columns at which keys and dashes stand.

    A value is a scalar, a flow (brackets and braces on a line) or a block_scalar, whose lines stand deeper than its key.
    """
    root = Node("document", 0, len(text))
    stack: list[tuple[int, Node]] = [(-1, root)]
    literal: int | None = None  # the column of the line whose block scalar is being read

    def leaf(kind: str, a: int, b: int, children: list[Node] | None = None) -> None:
        stack[-1][1].children.append(Node(kind, a, b, children or []))
        stack[-1][1].end = max(stack[-1][1].end, b)

    def pop() -> None:
        _, n = stack.pop()
        stack[-1][1].end = max(stack[-1][1].end, n.end)

    at = 0
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        body = line.strip()
        if not body:
            continue
        column = len(line) - len(line.lstrip(" "))
        if literal is not None:
            if column > literal:
                kids = stack[-1][1].children
                if kids and kids[-1].kind == "block_scalar":
                    kids[-1].end = begin + len(line.rstrip())
                    stack[-1][1].end = kids[-1].end
                else:
                    leaf("block_scalar", begin + column, begin + len(line.rstrip()))
                continue
            literal = None
        if line.startswith(("---", "...", "%")):
            while len(stack) > 1:
                pop()
            leaf("marker", begin, begin + len(line.rstrip()))
            continue
        if body[0] == "#":
            while len(stack) > 1 and stack[-1][0] >= column:
                pop()
            leaf("comment", begin + column, begin + len(line.rstrip()))
            continue
        first = column
        while True:
            if m := _YAML_ITEM.match(line, column):
                while len(stack) > 1 and (stack[-1][0] > column or (stack[-1][0] == column and stack[-1][1].kind == "item")):
                    pop()
                node = Node("item", begin + column, begin + column + 1)
            elif m := _YAML_KEY.match(line, column):
                while len(stack) > 1 and stack[-1][0] >= column:
                    pop()
                a, b = m.span("key")
                node = Node("pair", begin + a, begin + b, [Node("key", begin + a, begin + b)], line[a:b].strip("\"'"))
            else:
                break
            stack[-1][1].children.append(node)
            stack.append((column, node))
            column = m.end()
        rest = line[column:].rstrip()
        if not rest:
            continue
        quoted = _YAML_QUOTED.match(rest)
        note = _YAML_COMMENT.search(rest, quoted.end() if quoted else 0)
        value = rest[: note.start()].rstrip() if note else rest
        if value:
            a, b = begin + column, begin + column + len(value)
            if value[0] in "[{":
                leaf("flow", a, b, [Node("scalar", a + w.start(), a + w.start() + len(w[0].rstrip())) for w in _YAML_FLOW.finditer(value)])
            else:
                leaf("scalar", a, b)
                if re.fullmatch(r"(?:[!&]\S+[ \t]+)*[|>][-+0-9]*", value):
                    literal = first if stack[-1][1].kind == "item" else stack[-1][0]
        if note:
            leaf("comment", begin + column + note.start(), begin + column + note.end())
    while len(stack) > 1:
        pop()
    return root


def _parser(words: Words):
    return lambda text: _Reader(text, words).read()


for _name, _words in LANGUAGES.items():
    register(_name, _parser(_words))
register("Ruby", _parser(RUBY))
register("YAML", parse_yaml)
