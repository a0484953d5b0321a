"""Languages and file types of paths, and the node kinds that mean something in each language."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language.
EXTENSION_LANGUAGE = {
    "bash": "ShellScript", "sh": "ShellScript", "bazel": "Bazel", "c": "C", "h": "C", "cc": "CPP", "cpp": "CPP", "cxx": "CPP", "hpp": "CPP",
    "hh": "CPP", "hxx": "CPP", "cs": "CSharp", "css": "CSS", "scss": "CSS", "dart": "Dart", "el": "Lisp", "go": "Go", "html": "HTML",
    "java": "Java", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "json": "JSON", "kt": "Kotlin", "lua": "LUA", "md": "MarkDown",
    "php": "PHP", "proto": "ProtoBuf", "py": "Python", "r": "R", "rb": "Ruby", "rs": "Rust", "scala": "Scala", "sql": "SQL", "swift": "Swift",
    "ts": "TypeScript", "tsx": "TSX", "vim": "Vimscript", "yaml": "YAML", "yml": "YAML", "xml": "XML", "xht": "XML", "xhtml": "XML",
}

# File extension -> (category, subtype) where it is not code of a language.
EXTENSION_TYPE = {
    **dict.fromkeys("ini cfg toml conf".split(), ("Configuration", "")),
    **dict.fromkeys("txt csv rst txtpb pbtxt stderr doc diff".split(), ("Data", "Text")),
    **dict.fromkeys("gz zip tar bz2 xz lz4 zst br 7z rar".split(), ("Data", "Archive")),
    **dict.fromkeys("svg jpg jpeg png gif webp bmp tiff tif".split(), ("Data", "Image")),
    **dict.fromkeys("mp3 waw flac acc ogg m4a".split(), ("Data", "Audio")),
    **dict.fromkeys("mp4 mkv mov avi webm".split(), ("Data", "Video")),
    **dict.fromkeys("ttf otf woff woff2".split(), ("Data", "Font")),
    **dict.fromkeys("sqlite db mdb accdb parquet feather arrow orc".split(), ("Data", "Database")),
    **dict.fromkeys("bin dat exe dll class so o wasm symbols idl types po".split(), ("Data", "Binary")),
}

# File name -> (category, subtype); names go before extensions.
NAME_TYPE = {
    "BUILD": ("Code", "Build"), "Makefile": ("Code", "Build"), "Dockerfile": ("Code", "Build"), "OWNERS": ("Configuration", "DevEx"),
    ".gitignore": ("Configuration", "DevEx"), "LICENSE": ("Documentation", "Legal"), "README": ("Documentation", "General"), "README.md": ("Documentation", "General"),
}

# Parts of paths that are not looked at.
SKIPPED_PATHS = [
    "/.gitignore", "/.gitkeep", "/.git/", "/.github/", "third_party", "3rdparty", "security/nss/gtests/freebl_gtest/kat",
    "blob/4.x/3rdparty/openexr/Half/toFloat.h", "libavcodec/metasound_data.h", "libavcodec/on2avcdata.c", "libavcodec/dcadata.c",
    "libavcodec/hq_hqadata.h", "libavcodec/ralfdata.h", "libavcodec/twinvq_data.h", "swiftlang-swift.git/test",
]

# Node kinds of comments.
COMMENT_KINDS = ["comment", "line_comment", "block_comment", "js_comment", "html_comment", "xml_comment", "css_comment", "c_comment", "cpp_comment"]

# Kinds of our own parsers (see operators.trees), by what they mean.
ANCHORS = {
    "Python": ["Module", "FunctionDef", "AsyncFunctionDef", "ClassDef", "Import", "ImportFrom"],
    "HTML": ["document", "element", "script_element", "style_element"],
    "XML": ["document", "element"],
    "JSON": ["document"],
    "Text": ["document", "block"],
}
#: Languages of braces, which share a parser (see operators.code) and its kinds.
BRACES = ["C", "CPP", "CSharp", "Java", "Rust", "Scala", "ProtoBuf", "Go", "Kotlin", "Swift", "Dart", "JavaScript", "TypeScript", "TSX", "PHP", "CSS"]
#: Languages of words that open and close blocks (see operators.scripts), with the same kinds.
SCRIPTS = ["Ruby", "LUA", "ShellScript", "Vimscript"]
ANCHORS |= dict.fromkeys([*BRACES, *SCRIPTS], ["document", "function", "declaration", "import"]) | {"YAML": ["document", "pair"]}
COMMUTATIVE = {"JSON": ["object"], "HTML": ["attributes"], "XML": ["attributes"], "Python": ["alias_list"]}
IDENTIFIERS = ["identifier", "Name", "Attribute", "arg", "alias", "word", "tag_name", "attribute_name", "key"]
LITERALS = ["Constant", "JoinedStr", "string", "number", "true", "false", "null", "attribute_value"]
FLOW = {"Python": {"Match": "Match", "If": "If"}, **dict.fromkeys([*BRACES, *SCRIPTS], {"if_statement": "If", "switch_statement": "Switch", "match_statement": "Match", "when_statement": "Match", "case_statement": "Switch"})}
BLOCKS = {"Python": ["FunctionDef", "AsyncFunctionDef", "ClassDef", "If", "For", "While", "With", "Try", "Match"], "HTML": ["element"], "XML": ["element"], "JSON": ["object", "array"], "Text": ["block"], "YAML": ["pair", "item"], **dict.fromkeys([*BRACES, *SCRIPTS], ["block", "function", "declaration"])}
IMPORTS = {"Python": ["Import", "ImportFrom"], **dict.fromkeys([*BRACES, *SCRIPTS], ["import"])}
CALLS = {"Python": ["Call"], **dict.fromkeys([*BRACES, *SCRIPTS], ["call"])}
GENERIC = ["punctuation", "Load", "Store", "Del", "operator"]
OPERATOR_FAMILIES = {
    "Python": [["Add", "Sub"], ["Mult", "Div", "FloorDiv", "Mod"], ["Eq", "NotEq"], ["Lt", "LtE", "Gt", "GtE"], ["And", "Or"], ["LShift", "RShift"], ["BitAnd", "BitOr", "BitXor"]],
}
# What the last part of a callee contains, in lower case, if the call only reports.
DIAGNOSTIC_WORDS = [
    "printf", "fprintf", "sprintf", "eprintln", "eprint", "panic", "bail", "unreachable", "todo", "unimplemented", "assert",
    "log", "error", "err", "warn", "warning", "info", "debug", "trace", "fatal", "critical", "die",
]


def _map(d: dict, value=lambda v: F.lit(v)) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), value(v)) for k, v in d.items()))


def without_test(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.test)+$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, in lower case; null without one, or if only a dot leads the name."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.element_at(F.split(name, r"\."), -1)))


def language(path: Column) -> Column:
    """By extension, after any trailing .test; Unknown otherwise."""
    return F.coalesce(F.try_element_at(_map(EXTENSION_LANGUAGE), extension(without_test(path))), F.lit("Unknown"))


def file_type(path: Column) -> Column:
    """struct<category, subtype>: by file name, by extension, as code of a language, or Unknown."""
    pair = lambda v: F.struct(F.lit(v[0]).alias("category"), F.lit(v[1]).alias("subtype"))
    ext = extension(path)
    return F.coalesce(
        F.try_element_at(_map(NAME_TYPE, pair), file_name(path)),
        F.when(F.map_contains_key(_map(EXTENSION_LANGUAGE), F.coalesce(ext, F.lit(""))), pair(("Code", "Uncategorized"))),
        F.try_element_at(_map(EXTENSION_TYPE, pair), ext),
        pair(("Unknown", "")),
    )


def skipped(path: Column) -> Column:
    """Whether a path is not to be looked at."""
    out = F.lit(False)
    for part in SKIPPED_PATHS:
        out = out | F.contains(path, F.lit(part))
    return out


def in_table(language_: Column, kind: Column, table: dict[str, list[str]]) -> Column:
    """Whether (language, kind) is in a table such as ANCHORS: a literal map lookup, no join."""
    return F.coalesce(F.array_contains(F.try_element_at(_map(table, lambda v: F.array(*map(F.lit, v))), language_), kind), F.lit(False))


def kinds_compatible(a: Column, b: Column, language_: Column) -> Column:
    """Same kind, both like identifiers, or both of one operator family of the language."""
    family = F.lit(False)
    for lang, families in OPERATOR_FAMILIES.items():
        for f in families:
            family = family | ((language_ == lang) & a.isin(f) & b.isin(f))
    return (a == b) | (a.isin(IDENTIFIERS) & b.isin(IDENTIFIERS)) | family


# Node kinds of string literals, and languages whose local names are told apart.
STRING_KINDS = ["string_literal", "interpreted_string_literal", "string", "raw_string_literal"]
LOCAL_NAMES = ["Kotlin", "CSharp", "ShellScript"]


def is_string(kind: Column) -> Column:
    """Whether a node is a string literal, in other parsers' kinds or in our own."""
    return kind.isin(*STRING_KINDS, "JoinedStr", "attribute_value")


def has_local_names(language_: Column) -> Column:
    return language_.isin(*LOCAL_NAMES)


def extension_of(language_: Column) -> Column:
    """The first extension that names a language; null for others."""
    first: dict[str, str] = {}
    for ext, name in EXTENSION_LANGUAGE.items():
        first.setdefault(name, ext)
    return F.try_element_at(_map(first), language_)


def with_other_language(mine: Column, contents: Column, other: Column) -> Column:
    """A side's language; that of the other side where this one is empty and unknown."""
    return F.when((F.coalesce(contents, F.lit("")) == "") & (F.coalesce(mine, F.lit("Unknown")) == "Unknown"), other).otherwise(mine)
