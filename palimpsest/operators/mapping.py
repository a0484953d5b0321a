"""Questions about node rows and the mapping between them, as joins and ranges of nested sets.

nodes are rows of trees.flatten() with a pair_id; mapping has (pair_id, b_pre, a_pre, op, ...), null for a missing side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import trees
from palimpsest.operators.matching import EXPENSIVE, unit_cost


def together(df: DataFrame) -> DataFrame:
    """df with all rows of a pair in one partition, where windows over a pair leave them anyway: joins by the pair and more then need no further shuffle."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition("pair_id")


def mapped(mapping: DataFrame, side: str) -> DataFrame:
    """(pair_id, pre, other) of nodes of a side ("b" or "a") with a partner."""
    other = "a" if side == "b" else "b"
    return together(mapping.where(f"{side}_pre is not null and {other}_pre is not null").select("pair_id", F.col(f"{side}_pre").alias("pre"), F.col(f"{other}_pre").alias("other")))


def unmapped(nodes: DataFrame, mapping: DataFrame, side: str) -> DataFrame:
    return nodes.join(mapped(mapping, side), ["pair_id", "pre"], "left_anti")


def topmost_unmapped(nodes: DataFrame, mapping: DataFrame, side: str) -> DataFrame:
    """Nodes without a partner whose parent has one, or that are roots."""
    free = unmapped(nodes, mapping, side)
    parents = mapped(mapping, side).select("pair_id", F.col("pre").alias("parent_pre"))
    return free.join(parents, ["pair_id", "parent_pre"], "left_semi").unionByName(free.where("parent_pre is null").select(*_reordered(free)))


def _reordered(df: DataFrame) -> list[str]:
    return ["pair_id", "parent_pre", *(c for c in df.columns if c not in ("pair_id", "parent_pre"))]


def wide_unmapped(nodes: DataFrame, mapping: DataFrame, side: str, least: int = 50) -> DataFrame:
    """(pair_id, parent_pre, n): parents with many children that have no partner."""
    return unmapped(nodes, mapping, side).where("parent_pre is not null").groupBy("pair_id", "parent_pre").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def wholly_unmapped(nodes: DataFrame, mapping: DataFrame, side: str) -> DataFrame:
    """Nodes of whose subtree no node has a partner: the partners in [pre, pre + size) are counted by running sums, not by pairs."""
    w = Window.partitionBy("pair_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    flag = nodes.join(mapped(mapping, side), ["pair_id", "pre"], "left").withColumn("_upto", F.sum(F.col("other").isNotNull().cast("int")).over(w))
    ends = flag.select("pair_id", F.col("pre").alias("_last"), F.col("_upto").alias("_at_last"))
    met = flag.withColumn("_last", F.col("pre") + F.col("size") - 1).join(ends, ["pair_id", "_last"])
    inside = F.col("_at_last") - F.col("_upto") + F.col("other").isNotNull().cast("int")
    return met.where(inside == 0).select(*nodes.columns)


def shared_descendants(before: DataFrame, after: DataFrame, mapping: DataFrame) -> DataFrame:
    """(pair_id, b_pre, a_pre, shared): how many nodes below b map below a, for each mapped pair where any do.

    Each mapped pair meets the partners of its own ancestors only: equi-joins, as many rows as nodes are deep. Nodes need their `ancestors`.
    """
    m = together(mapping.where("b_pre is not null and a_pre is not null").select("pair_id", "b_pre", "a_pre"))
    b = together(before.select("pair_id", F.col("pre").alias("b_pre"), F.col("ancestors").alias("b_up")))
    a = together(after.select("pair_id", F.col("pre").alias("a_pre"), F.col("ancestors").alias("a_up")))
    inner = m.join(b, ["pair_id", "b_pre"]).join(a, ["pair_id", "a_pre"]).select("pair_id", F.explode("b_up").alias("b_pre"), "a_up")
    return inner.join(m, ["pair_id", "b_pre"]).where(F.array_contains("a_up", F.col("a_pre"))).groupBy("pair_id", "b_pre", "a_pre").agg(F.count("*").alias("shared"))


def by_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, b_pre, a_pre, b_path, a_path, op, cost): the mapping in which nodes of one path are partners, whatever they hold."""
    side = lambda nodes, s: nodes.select("pair_id", "path", F.col("pre").alias(f"{s}_pre"), F.col("full_hash").alias(f"{s}_hash"), (F.col("size") == 1).alias(f"{s}_leaf"))
    met = together(side(before, "b")).join(together(side(after, "a")), ["pair_id", "path"], "full_outer")
    op = (
        F.when(F.col("a_pre").isNull(), "Delete").when(F.col("b_pre").isNull(), "Insert").when(F.col("b_hash") == F.col("a_hash"), "Identical")
        .when(F.col("b_leaf") & F.col("a_leaf"), "Update").otherwise("MatchButNotIdentical")
    )
    there = lambda s: F.when(F.col(f"{s}_pre").isNotNull(), F.col("path")).alias(f"{s}_path")
    return met.select("pair_id", "b_pre", "a_pre", there("b"), there("a"), op.alias("op")).withColumn("cost", unit_cost(F.col("op"), F.lit(1)))


def identical_by_paths(pairs: DataFrame) -> DataFrame:
    """(pair_id, b_pre, a_pre) of the nodes that by_paths() calls Identical, from texts (pair_id, before, after, language): both trees are made where the pair lies, so no path is shuffled."""
    schema = f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, b_pre int, a_pre int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, b_pre, a_pre = [], [], []
            for key, x, y, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, j in trees.identical_places(x or "", y or "", lang):
                    keys.append(key)
                    b_pre.append(i)
                    a_pre.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(b_pre, pa.int32()), pa.array(a_pre, pa.int32())], names=["pair_id", "b_pre", "a_pre"])

    return pairs.select("pair_id", "before", "after", "language").mapInArrow(run, schema)


def router(mapping: DataFrame) -> DataFrame:
    """(pair_id, left_before, left_after, expensive): whether so much is left that edit distances give way to sequences."""
    n = mapping.groupBy("pair_id").agg(
        F.count_if(F.col("a_pre").isNull() & F.col("b_pre").isNotNull()).alias("left_before"), F.count_if(F.col("b_pre").isNull() & F.col("a_pre").isNotNull()).alias("left_after")
    )
    return n.withColumn("expensive", F.greatest("left_before", "left_after") > EXPENSIVE)


def coarse(mapping: DataFrame, nodes_before: DataFrame, nodes_after: DataFrame) -> DataFrame:
    """(pair_id, op, pre, size): removed and added subtrees by their topmost node, WithChildren where all below goes with it."""

    def one(nodes: DataFrame, side: str, op: str) -> DataFrame:
        nodes = together(nodes.select("pair_id", "pre", "parent_pre", "size"))
        whole = wholly_unmapped(nodes, mapping, side).select("pair_id", "pre", F.lit(True).alias("_whole"))
        top = topmost_unmapped(nodes, mapping, side).join(whole, ["pair_id", "pre"], "left")
        return top.select("pair_id", F.when(F.col("_whole") & (F.col("size") > 1), f"{op}WithChildren").otherwise(op).alias("op"), "pre", "size")

    return one(nodes_before, "b", "Delete").unionByName(one(nodes_after, "a", "Insert"))


def coarse_cost(rows: DataFrame) -> DataFrame:
    """(pair_id, cost) of coarse()'s rows."""
    return rows.groupBy("pair_id").agg(F.sum(unit_cost(F.col("op"), F.col("size"))).alias("cost"))


def quiet_subtrees(nodes: DataFrame, mapping: DataFrame, least: int = 20) -> DataFrame:
    """(pair_id, pre, size) of the largest before-side subtrees in which every node is Identical, of more than `least` nodes.

    What is not Identical in [pre, pre + size) is counted by running sums, not by pairs.
    """
    calm = together(mapping.where("b_pre is not null and op = 'Identical'").select("pair_id", F.col("b_pre").alias("pre"), F.lit(0).alias("_loud")))
    w = Window.partitionBy("pair_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    flag = together(nodes.select("pair_id", "pre", "size", "parent_pre")).join(calm, ["pair_id", "pre"], "left").na.fill(1, ["_loud"]).withColumn("_upto", F.sum("_loud").over(w))
    ends = flag.select("pair_id", F.col("pre").alias("_last"), F.col("_upto").alias("_at_last"))
    met = flag.withColumn("_last", F.col("pre") + F.col("size") - 1).join(ends, ["pair_id", "_last"])
    quiet = met.where(F.col("_at_last") - F.col("_upto") + F.col("_loud") == 0).select("pair_id", "pre", "size", "parent_pre")
    parents = quiet.select("pair_id", F.col("pre").alias("parent_pre"))
    return quiet.join(parents, ["pair_id", "parent_pre"], "left_anti").where(F.col("size") > least).select("pair_id", "pre", "size")


def statement_identities(nodes: DataFrame) -> DataFrame:
    """(pair_id, kind, name, pres): nodes by kind and declared name, in document order."""
    return nodes.where("decl_name is not null").groupBy("pair_id", "kind", F.col("decl_name").alias("name")).agg(F.array_sort(F.collect_list("pre")).alias("pres"))
