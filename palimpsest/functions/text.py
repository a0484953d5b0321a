"""Scalar functions over text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: what generators write at the head of their files. Looked for in each of the first GENERATED_LINES lines.
GENERATED = (
    r"(?i)@generated\b|auto(?:matically)?\s+generated\b|this\s+(?:file\s+)?(?:was|is)\s+(?:an?\s+)?auto(?:matically)?\s+generated(?:\s+file)?\b"
    r"|code\s+generated\s+by\b|generated\s+by\b|<auto-generated>|do\s+not\s+edit(?:\s+this\s+file)?\b"
)
GENERATED_LINES = 50
TOO_LARGE = 1 << 20
#: Fixed sentences for each class of change.
SUMMARY_LABELS = {
    "NoChanges": "No changes - files are identical",
    "NewFile": "New file - everything inserted",
    "DeletedFile": "Deleted file - everything removed",
    "WhitespaceOnly": "Whitespace changes only",
    "CommentOnly": "Comment changes only",
    "RefactorMovedOnly": "Refactor - code moved, no content changes",
}


def lines(text: Column) -> Column:
    """Lines without their ends and without an empty one after the last end, as diffs count them."""
    split = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    return F.when(F.length(text) == 0, F.expr("cast(array() as array<string>)")).when(
        text.endswith("\n"), F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0)))
    ).otherwise(split)


def rows(text: Column) -> Column:
    """All lines, with an empty one after the last end, as labels count them."""
    return F.split(text, "\n", -1)


def line_feeds(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "\n", ""))).cast("long")


def is_generated(text: Column) -> Column:
    return F.exists(F.slice(F.split(text, "\n", GENERATED_LINES + 1), 1, GENERATED_LINES), lambda x: x.rlike(GENERATED))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    return F.when(
        F.length(text) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))
    ).otherwise(F.expr("cast(array() as array<string>)"))


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def similar_leaves(a: Column, b: Column, least: float = 0.6) -> Column:
    """Equal, or sharing enough pairs of characters; a text of one character is only like itself."""
    x, y = bigrams(a), bigrams(b)
    return (a == b) | ((F.size(x) > 0) & (F.size(y) > 0) & (dice(x, y) >= least))


def without_white_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def import_path(text: Column) -> Column:
    """Trimmed, unquoted, with forward slashes and without leading ./ parts."""
    bare = F.regexp_replace(F.trim(text), "^[\"'<]+|[\"'>]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\\", "/"), r"^(\./)+", "")


def pair_name(language: Column, repository: Column, commit: Column, path: Column) -> Column:
    """<language>-x-<repository>-<first 8 of the commit>-<file stem>, in lower case."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]+", "-")
    return F.lower(F.concat_ws("-", language, F.lit("x"), clean(repository), F.substring(commit, 1, 8), clean(stem)))


def change_counts(inserted: Column, deleted: Column, updated: Column) -> Column:
    """+12 -4 ~2, without parts that are zero."""
    part = lambda sign, n: F.when(n > 0, F.concat(F.lit(sign), n.cast("string")))
    return F.concat_ws(" ", part("+", inserted), part("-", deleted), part("~", updated))


def summary_label(summary: Column) -> Column:
    out = None
    for k, v in SUMMARY_LABELS.items():
        out = F.when(summary == k, v) if out is None else out.when(summary == k, v)
    return out


def code_span(text: Column) -> Column:
    """A Markdown code span that holds any text, bars escaped for tables."""
    safe = F.regexp_replace(text, r"\|", r"\\|")
    return F.when(F.contains(text, F.lit("`")), F.concat(F.lit("`` "), safe, F.lit(" ``"))).otherwise(F.concat(F.lit("`"), safe, F.lit("`")))


def tex(text: Column) -> Column:
    """Text for TeX: its special characters escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\textbackslash{}"), r"([&%$#_{}])", r"\\$1")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def repeats(text: Column) -> Column:
    """';'-joined numbers as an array; empty parts are left out, a blank cell is null."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(text) != "", F.transform(parts, lambda x: x.cast("double")))


def joined_repeats(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ";")


def last_callee_word(callee: Column) -> Column:
    return F.lower(F.regexp_extract(callee, r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1))


def search(text: Column, query: Column) -> Column:
    """array<struct<row, col>> (from 0) of all places, overlapping too, where the query stands, whatever its case."""
    q = F.lower(query)
    found = F.transform(
        rows(text),
        lambda line, row: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.length(line) - F.length(q) + 1, F.lit(1))), lambda i: F.lower(F.substring(line, i, F.length(q))) == q),
            lambda i: F.struct(row.alias("row"), (i - 1).alias("col")),
        ),
    )
    return F.when(F.length(q) > 0, F.flatten(found)).otherwise(F.expr("cast(array() as array<struct<row:int,col:int>>)"))


def trimmed(text: Column) -> Column:
    """Without white space at both ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def shown_reason(column: Column) -> Column:
    """`name:source` as `name (source)`."""
    return F.regexp_replace(column, "^([^:]+):(.+)$", "$1 ($2)")
