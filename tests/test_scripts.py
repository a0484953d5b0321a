"""Trees of languages whose blocks are told by words or by indentation."""

import random
import time

import pytest

from palimpsest.functions.languages import SCRIPTS
from palimpsest.operators import matching, trees

RUBY = 'require "set"\n\n# one\nclass Shop < Base\n  def total(xs)\n    return 0 if xs.nil?\n    xs.each do |x|\n      puts "#{x["a"]} end"\n    end\n    y = if a then b else c end\n    case y\n    when 1 then 2\n    else 3\n    end\n  rescue KeyError => e\n    log(e.class)\n  end\nend\n'
LUA = 'local m = require("m")\n-- one\nfunction M.add(a, b)\n  local t = { x = 1, f = function(y) return y end }\n  if a then b = 2 elseif c then d() else e() end\n  for i = 1, 3 do print([[ end ]]) end\n  repeat a = a - 1 until a < 0\n  return a +\n    b\nend\n'
SHELL = 'source lib.sh\n# don\'t\nrun() {\n  if [ -z "$(cat "$1" | grep "a b")" ]; then\n    echo fi done\n  else\n    cat x | while read -r l; do echo "$l"; done < y\n  fi\n  case "$1" in\n    a|b) run ;;\n    *) cat <<-EOF\nif "\n\tEOF\n  esac\n}\n'
VIM = '" one\nfunction! s:Go(a) abort\n  if a:a ==# "x" | return | endif\n  let l = [1,\n        \\ 2]\n  for i in l\n    echo \'don\'\'t\' " say\n  endfor\nendfunction\nsource x.vim\n'
YAML = '# one\na: 1\nb:\n- x: "p: q"  # note\n  y: [1, two]\n- z\nc: |\n  not: a key\n\n  # text\nd: {e: f}\n---\ng:\n  h: http://x/y\n'
TEXTS = {"Ruby": RUBY, "LUA": LUA, "ShellScript": SHELL, "Vimscript": VIM, "YAML": YAML}


def said(t, kind):
    return [t.text_all[t.start[i] : t.end[i]] for i in range(t.n) if t.kind[i] == kind]


def names(t):
    return [(t.kind[i], t.name[i]) for i in range(t.n) if t.name[i]]


def test_ruby():
    t = trees.build(RUBY, "Ruby")
    assert names(t) == [("declaration", "Shop"), ("function", "total")]
    assert [t.kind[c] for c in t.children[0]] == ["import", "comment", "declaration"]
    assert said(t, "return_statement") == ["return 0 if xs.nil?"] and said(t, "case_statement")[0].endswith("else 3\n    end")
    assert "log(e.class)" in said(t, "call")


def test_lua():
    t = trees.build(LUA, "LUA")
    assert [t.kind[c] for c in t.children[0]] == ["import", "comment", "function"] and ("function", "M.add") in names(t)
    assert said(t, "return_statement") == ["return y", "return a +\n    b"] and len(said(t, "if_statement")) == 1 and said(t, "repeat_statement")[0].endswith("a < 0")


def test_shell():
    t = trees.build(SHELL, "ShellScript")
    assert [t.kind[c] for c in t.children[0]] == ["import", "comment", "function"] and names(t) == [("function", "run")]
    assert len(said(t, "if_statement")) == 1 and said(t, "case_statement")[0].endswith("esac") and "<<-EOF\nif \"\n\tEOF" in said(t, "string")


def test_vim():
    t = trees.build(VIM, "Vimscript")
    assert [t.kind[c] for c in t.children[0]] == ["comment", "function", "import"] and names(t) == [("function", "s:Go")]
    assert said(t, "for_statement")[0].endswith("endfor") and said(t, "comment") == ['" one', '" say'] and "[1,\n        \\ 2]" in said(t, "brackets")


def test_yaml():
    t = trees.build(YAML, "YAML")
    assert [n for _, n in names(t)] == ["a", "b", "x", "y", "c", "d", "g", "h"]
    assert said(t, "block_scalar") == ["not: a key\n\n  # text"] and said(t, "flow") == ["[1, two]", "{e: f}"] and "http://x/y" in said(t, "scalar")
    assert said(t, "comment") == ["# one", "# note"] and said(t, "item") == ['- x: "p: q"  # note\n  y: [1, two]', "- z"]


@pytest.mark.parametrize("language", [*SCRIPTS, "YAML"])
def test_trees_are_nested_sets_of_places(language):
    r = random.Random(1)
    words = ["if ", "then ", "end", "do ", "fi", "done", "case ", "in ", "else ", "function ", "def ", "(", ")", "{", "}", "[", "]", '"', "'", "\n", "\n", "  ", "- ", "a: ", "x", "|", ";", "#", "<<A", "endif", "--", "\\", ".", "1", "é"]
    texts = [*TEXTS.values(), "", "\n", "a", *("".join(r.choices(words, k=40)) for _ in range(400))]
    read = 0
    for text in texts:
        t = trees.build(text, language)
        if t is None:
            continue
        read += 1
        for i in range(1, t.n):
            p = t.parent[i]
            assert t.start[p] <= t.start[i] <= t.end[i] <= t.end[p]
        assert t.size[0] == t.n
        for kids in t.children:
            assert all(t.end[a] <= t.start[b] for a, b in zip(kids, kids[1:], strict=False))
    assert read > 10


@pytest.mark.parametrize("language", [*SCRIPTS, "YAML"])
@pytest.mark.parametrize("part", ['"\\', "$(", '"$(', "#{", "if x\n", "<<A\n", "'", "a: ", "- ", "%w[", "do ", "[", "/a "])
def test_any_text_is_read_in_a_moment(language, part):
    begun = time.perf_counter()
    trees.build(part * (30_000 // len(part)), language)
    assert time.perf_counter() - begun < 8


def test_texts_that_do_not_close_have_no_tree():
    assert trees.build("def f\n", "Ruby") is None and trees.build("if a then", "LUA") is None and trees.build("echo 'a", "ShellScript") is None


@pytest.mark.parametrize(("language", "old", "new"), [("Ruby", "return 0", "return 1"), ("LUA", "1, 3", "1, 4"), ("ShellScript", "a b", "a c"), ("Vimscript", '"x"', '"y"'), ("YAML", "two", "three")])
def test_edits_are_matched(language, old, new):
    text = TEXTS[language]
    ops = [x["op"] for x in matching.match(trees.build(text, language), trees.build(text.replace(old, new), language)).rows()]
    assert ops.count("Update") >= 1 and "Delete" not in ops and "Insert" not in ops
    assert {x["op"] for x in matching.match(trees.build(text, language), trees.build(text, language)).rows()} == {"Identical"}
