"""Reports: one text from a small aggregate, made by Spark and joined on the driver's side of a single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def _joined(rows: DataFrame, order: list[Column], line: Column, sep: str = "\n") -> DataFrame:
    """All lines of a table of bounded size, in order, as one text."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select(*(o.alias(n) for o, n in zip(order, names, strict=True)), line.alias("_line"))
    return keyed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*names, "_line"))), lambda x: x["_line"]), sep).alias("report"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return _joined(rows, order, cells).select(F.concat(F.lit(head), "report").alias("report"))


def top_kinds(ranked: DataFrame) -> DataFrame:
    """Markdown of (language, kind, total, percentage, rank)."""
    shown = ranked.select("language", T.code_span(F.col("kind")).alias("kind"), T.thousands(F.col("total")).alias("total"), F.format_number("percentage", 2).alias("percentage"), "rank")
    return markdown_table(shown, ["language", "rank", "kind", "total", "percentage"], [F.col("language"), F.col("rank")])


def tex_macros(row: DataFrame, names: dict[str, str]) -> DataFrame:
    """newcommand lines for the columns of a one-row table: names maps columns to macros."""
    lines = [F.concat(F.lit("\\newcommand{\\" + macro + "}{"), T.tex(F.col(c).cast("string")), F.lit("}")) for c, macro in names.items()]
    return row.select(F.concat_ws("\n", *lines).alias("report"))


def tex_table(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    body = F.concat(F.concat_ws(" & ", *(T.tex(F.coalesce(F.col(c).cast("string"), F.lit("--"))) for c in columns)), F.lit(r" \\"))
    return _joined(rows, order, body)


def tree_dump(nodes: DataFrame) -> DataFrame:
    """(unit_id, report): the kinds of a unit's nodes, indented by depth, with the text of leaves."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("kind"), F.when(F.col("text").isNotNull(), F.concat(F.lit(" "), T.shortened(F.translate("text", "\n", " "), 60))).otherwise(""))
    g = nodes.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("pre", line.alias("line")))).alias("x"))
    return g.select("unit_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("report"))


def index_page(rows: DataFrame, name: str, count: str) -> DataFrame:
    """An HTML table of names and counts, the most first."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.concat(F.lit("<tr><td>"), safe(F.col(name)), F.lit("</td><td>"), F.col(count).cast("string"), F.lit("</td></tr>"))
    body = _joined(rows, [-F.coalesce(F.col(count), F.lit(-1)), F.col(name)], line)
    return body.select(F.concat(F.lit("<table>\n"), "report", F.lit("\n</table>")).alias("report"))
