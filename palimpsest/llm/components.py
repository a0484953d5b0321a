"""Connected components of a graph given by its links, without a driver-side or per-component step.

Large-star and small-star steps alternate until the links no longer change. Each step groups by node and
takes a minimum, which Spark combines before the shuffle, then joins the minimum back; a node with many
links is split by the skew join. Every round is written to the shared folder, so that lineage stays one
round long and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, forget


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b), b the smaller. Links to the smallest neighbour, of the larger or the smaller ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of a link of edges (a, b); root is the least node that it reaches."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        new = cut(_star(_star(now, large=True), large=False))
        found = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        forget(now)
        now = new
        if (found.n, found.h) == state:
            break
        state = (found.n, found.h)
    # Stars: each node but a root has one link, to its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
