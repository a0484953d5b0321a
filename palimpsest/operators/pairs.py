"""Pairs of texts, and what can be said of a pair's lines without aligning them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def neighbours(df: DataFrame, key: str, text: str) -> DataFrame:
    """(pair_id, before, after): each even key with the odd key that follows it; a side that is missing is null. One equi-join."""
    before = df.where(F.col(key) % 2 == 0).select(F.col(key).alias("pair_id"), F.col(text).alias("before"))
    after = df.where(F.col(key) % 2 == 1).select((F.col(key) - 1).alias("pair_id"), F.col(text).alias("after"))
    return before.join(after, "pair_id", "full_outer")


def line_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, line), rows from 0, without an empty line after the last end."""
    return df.select(key, F.posexplode(T.lines(F.coalesce(F.col(text), F.lit("")))).alias("row", "line"))


def multiset_changes(pairs: DataFrame) -> DataFrame:
    """(pair_id, deleted, inserted): lines of one side that no equal line of the other is left for (each matches once).

    Lines are counted, so a line that stands a million times is one row of the join.
    """
    count = lambda side, n: line_rows(pairs, "pair_id", side).groupBy("pair_id", F.md5("line").alias("h")).agg(F.count("*").alias(n))
    met = count("before", "b").join(count("after", "a"), ["pair_id", "h"], "full_outer").na.fill(0, ["a", "b"])
    totals = met.groupBy("pair_id").agg(
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("deleted"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("inserted")
    )
    return pairs.select("pair_id").join(totals, "pair_id", "left").na.fill(0, ["deleted", "inserted"])


def content_summary(before: Column, after: Column) -> Column:
    """The class of change that contents alone tell, first that holds: NoChanges, WhitespaceOnly, NewFile, DeletedFile; else null."""
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    return (
        F.when(b == a, "NoChanges")
        .when(T.without_white_space(b) == T.without_white_space(a), "WhitespaceOnly")
        .when(b == "", "NewFile")
        .when(a == "", "DeletedFile")
    )


def duplicate_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(first, copies) of each text that occurs more than once."""
    return df.groupBy(F.md5(text).alias("h")).agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("first", "copies")


def unique_matches(pairs: DataFrame) -> DataFrame:
    """(pair_id, before_row, after_row): lines that stand once on each side match."""

    def once(side: str, row: str) -> DataFrame:
        return (
            line_rows(pairs, "pair_id", side).where("line <> ''").groupBy("pair_id", F.md5("line").alias("h"))
            .agg(F.count("*").alias("n"), F.min("row").alias(row)).where("n = 1").select("pair_id", "h", row)
        )

    return once("before", "before_row").join(once("after", "after_row"), ["pair_id", "h"]).select("pair_id", "before_row", "after_row")


def fifo_matches(pairs: DataFrame) -> DataFrame:
    """(pair_id, before_row, after_row): the k-th occurrence of a line matches the k-th of an equal line."""

    def nth(side: str, row: str) -> DataFrame:
        w = Window.partitionBy("pair_id", "h").orderBy("row")
        return line_rows(pairs, "pair_id", side).withColumn("h", F.md5("line")).withColumn("k", F.row_number().over(w)).select("pair_id", "h", "k", F.col("row").alias(row))

    return nth("before", "before_row").join(nth("after", "after_row"), ["pair_id", "h", "k"]).select("pair_id", "before_row", "after_row")


def line_similarity(pairs: DataFrame) -> DataFrame:
    """(pair_id, shared, jaccard) over sets of lines."""
    both = pairs.select("pair_id", F.array_distinct(T.lines(F.coalesce("before", F.lit("")))).alias("b"), F.array_distinct(T.lines(F.coalesce("after", F.lit("")))).alias("a"))
    return both.select("pair_id", F.size(F.array_intersect("b", "a")).cast("long").alias("shared"), T.jaccard(F.col("b"), F.col("a")).alias("jaccard"))


def context(labels: DataFrame, by: list[str], row: str, changed: Column, around: int = 3) -> DataFrame:
    """labels with keep: whether a row is changed or at most `around` rows from one that is."""
    w = Window.partitionBy(*by).orderBy(row).rangeBetween(-around, around)
    return labels.withColumn("keep", F.max(changed.cast("int")).over(w) == 1)


def round_trip(changes: DataFrame, by: list[str], row: str) -> DataFrame:
    """Changed rows with their number, the total, and the next and previous one, from the last on to the first."""
    w, all_ = Window.partitionBy(*by).orderBy(row), Window.partitionBy(*by)
    return changes.select(
        *by, row,
        F.row_number().over(w).cast("long").alias("number"),
        F.count("*").over(all_).alias("total"),
        F.coalesce(F.lead(row).over(w), F.min(row).over(all_)).alias("next"),
        F.coalesce(F.lag(row).over(w), F.max(row).over(all_)).alias("previous"),
    )


def last_at_or_before(points: DataFrame, starts: DataFrame, by: list[str], point: str, start: str, end: str) -> DataFrame:
    """points with the start and end of the last range that starts at or before each, both null if the range has ended.

    An as-of join: one union, one shuffle by key, a running last value; no pair of point and range is ever formed.
    """
    s = starts.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_is_point"), F.struct(F.col(start), F.col(end)).alias("_range"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in points.schema) + ">").alias("_row"))
    p = points.select(*by, F.col(point).alias("_at"), F.lit(1).alias("_is_point"), F.lit(None).cast(s.schema["_range"].dataType).alias("_range"), F.struct(*points.columns).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_at", "_is_point").rowsBetween(Window.unboundedPreceding, 0)
    found = s.unionByName(p).withColumn("_last", F.last("_range", ignorenulls=True).over(w)).where("_is_point = 1")
    inside = F.col(f"_last.{end}") > F.col("_at")
    return found.select("_row.*", F.when(inside, F.col(f"_last.{start}")).alias(start), F.when(inside, F.col(f"_last.{end}")).alias(end))
