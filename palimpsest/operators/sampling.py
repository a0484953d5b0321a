"""Samples that do not depend on partitioning, top-k, upserts and differences of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*keys: str) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))


def stratified(df: DataFrame, strata: list[str], keys: list[str], k: int) -> DataFrame:
    """At most k rows of each stratum, uniform and the same on every run: the k least hashes of the keys.

    Spark cuts each task's part of a stratum to k rows before the shuffle.
    """
    w = Window.partitionBy(*strata).orderBy(hash_order(*keys), *keys)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def refill(df: DataFrame, existing: DataFrame, stratum: str, keys: list[str], target: int) -> DataFrame:
    """New rows, none of them among the existing, that bring each stratum up to the target."""
    have = existing.groupBy(stratum).agg(F.count("*").alias("_have"))
    fresh = df.join(existing.select(*keys), keys, "left_anti")
    w = Window.partitionBy(stratum).orderBy(hash_order(*keys), *keys)
    ranked = fresh.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= target)
    return ranked.join(have, stratum, "left").where(F.col("_r") <= target - F.coalesce("_have", F.lit(0))).select(*df.columns)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def top_and_other(df: DataFrame, key: str, k: int, other: str = "Other") -> DataFrame:
    """(key, n) of the k most frequent keys, and the rest as one."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(k).select(F.col(key).alias("_top"))
    named = counts.join(F.broadcast(top), F.col(key) == F.col("_top"), "left")
    return named.groupBy(F.coalesce("_top", F.lit(other)).alias(key)).agg(F.sum("n").alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; one aggregation with a partial step, no sort, no window."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two sets has, with the side."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    met = x.join(y, keys, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    return met.select(*keys, F.when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))
