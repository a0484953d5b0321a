"""Places of pattern matches and rewriting of text, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches of a pattern, leftmost first, none overlapping: an array of strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def gaps(text: Column, pattern: str) -> Column:
    """What lies before, between and after the matches: one string more than there are matches."""
    return F.split(text, pattern, -1)


def folded(items: Column, start: Column, step, kind: str, block: int = 256) -> Column:
    """The array `out` of step(struct<state, out>, item) over all items, where each step appends to `out`, of type `kind`.

    Appending copies, so a block of items is folded on its own before its part is appended: the cost of long arrays does not grow with their square.
    """
    none = F.expr(f"cast(array() as {kind})")

    def of(xs: Column) -> Column:
        def one(s: Column, b: Column) -> Column:
            part = F.aggregate(F.slice(xs, b * block + 1, F.lit(block)), F.struct(s["state"].alias("state"), none.alias("out")), step)
            return F.element_at(F.transform(F.array(part), lambda p: F.struct(p["state"].alias("state"), F.concat(s["out"], p["out"]).alias("out"))), 1)

        blocks = F.sequence(F.lit(0), F.floor(F.size(xs) / block).cast("int"))
        return F.aggregate(blocks, F.struct(start.alias("state"), none.alias("out")), one, lambda s: s["out"])

    return F.element_at(F.transform(F.array(items), of), 1)


def places(text: Column, pattern: str) -> Column:
    """array<struct<first, last, word>> of the matches, in code points, last exclusive."""
    found, rest = matches(text, pattern), gaps(text, pattern)

    def step(s: Column, x: Column) -> Column:
        first = s["state"] + x["g"]
        return F.struct(
            (first + x["n"]).alias("state"),
            F.concat(s["out"], F.array(F.struct(first.alias("first"), (first + x["n"]).alias("last"), x["m"].alias("word")))).alias("out"),
        )

    items = F.zip_with(found, F.slice(rest, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))
    return folded(items, F.lit(0), step, "array<struct<first:int,last:int,word:string>>")
