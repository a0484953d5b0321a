"""Local names by scope and arms of branches, from node rows of Python trees.

Scopes are nested sets, so the innermost scope of a name is the last of its ancestors that is one. Arms of a branch are rows with a signature (the text of a pattern or condition, null for one that
takes everything), and branches are alike by the sets of their arms' signatures: a similarity join on rare signatures, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.languages import FLOW
from palimpsest.operators.assignment import greedy, similar_sets

#: Kinds that a name is local to.
SCOPES = ["Module", "FunctionDef", "AsyncFunctionDef", "Lambda", "ClassDef"]
#: Node columns that the functions here need.
COLUMNS = ["pre", "parent_pre", "sib_idx", "depth", "n_children", "size", "kind", "start", "end", "text", "own_text", "ancestors"]


def innermost(points: DataFrame, nodes: DataFrame, holds: Column, name: str) -> DataFrame:
    """points (unit_id, pre, ancestors, ...) with the place of the last of their ancestors for which `holds`; null if there is none."""
    some = nodes.where(holds).select("unit_id", F.col("pre").alias("_up"))
    met = points.select("unit_id", "pre", F.explode("ancestors").alias("_up")).join(some, ["unit_id", "_up"]).groupBy("unit_id", "pre").agg(F.max("_up").alias(name))
    return points.join(met, ["unit_id", "pre"], "left")


def local_names(nodes: DataFrame) -> DataFrame:
    """(unit_id, pre, scope, bucket, name): parameters and assigned names, each with its innermost scope."""
    word = F.regexp_extract(F.coalesce("text", "own_text"), r"^\w+", 0)
    up = nodes.select("unit_id", F.col("pre").alias("parent_pre"), F.col("kind").alias("_kind"), F.col("n_children").alias("_n"))
    met = nodes.where(F.col("kind").isin("arg", "Name")).join(up, ["unit_id", "parent_pre"])
    # the last child of an assignment is its value
    target = (F.col("kind") == "Name") & (F.col("_kind").isin("Assign") & (F.col("sib_idx") < F.col("_n") - 1) | F.col("_kind").isin("AugAssign", "AnnAssign", "NamedExpr") & (F.col("sib_idx") == 0))
    bucket = F.when(F.col("kind") == "arg", "parameter").when(target, "assignment")
    found = met.withColumn("bucket", bucket).where("bucket is not null").select("unit_id", "pre", "ancestors", "bucket", word.alias("name"))
    return innermost(found, nodes, F.col("kind").isin(SCOPES), "scope").select("unit_id", "pre", "scope", "bucket", "name")


def name_groups(names: DataFrame) -> DataFrame:
    """(unit_id, scope, bucket, name, pres): the places of a name in a scope, in order."""
    return names.groupBy("unit_id", "scope", "bucket", "name").agg(F.array_sort(F.collect_list("pre")).alias("pres"))


def unique_names(before: DataFrame, after: DataFrame, scopes: DataFrame) -> DataFrame:
    """(pair_id, b_pre, a_pre): names that stand once in a scope on both sides, in scopes (pair_id, b_pre, a_pre) that are partners. before and after: name_groups() with a pair_id."""
    one = lambda g, s: g.where(F.size("pres") == 1).select("pair_id", F.col("scope").alias(f"{s}_scope"), "bucket", "name", F.col("pres")[0].alias(f"{s}_pre"))
    met = scopes.select("pair_id", F.col("b_pre").alias("b_scope"), F.col("a_pre").alias("a_scope"))
    return met.join(one(before, "b"), ["pair_id", "b_scope"]).join(one(after, "a"), ["pair_id", "a_scope", "bucket", "name"]).select("pair_id", "b_pre", "a_pre")


def arms(nodes: DataFrame, units: DataFrame, contents: str) -> DataFrame:
    """(unit_id, branch, family, arm, number, signature) of the arms of match statements and of chains of if and elif.

    A chain's branch is its first if. The signature is the text of the pattern (without its guard) or condition; null for a pattern that takes everything. units (unit_id, contents) are those that
    the nodes come from.
    """
    text = units.select("unit_id", F.col(contents).alias("_contents"))
    flow = nodes.where(F.col("kind").isin(*FLOW["Python"])).select("unit_id", F.col("pre").alias("branch"), "kind")
    cut = F.substring(F.col("_contents"), F.col("start") + 1, F.col("end") - F.col("start"))
    first = nodes.where("sib_idx = 0").select("unit_id", F.col("parent_pre").alias("arm"), F.col("kind").alias("_kind"), F.col("size").alias("_size"), "start", "end")
    cases = nodes.where("kind = 'match_case'").select("unit_id", F.col("parent_pre").alias("branch"), F.col("pre").alias("arm"))
    cases = cases.join(first, ["unit_id", "arm"]).join(text, "unit_id").select("unit_id", "branch", F.lit("Match").alias("family"), "arm", F.nullif(F.trim(cut), F.lit("_")).alias("signature"))
    ifs = nodes.where("kind = 'If'").join(text, "unit_id").withColumn("_elif", F.substring(F.col("_contents"), F.col("start") + 1, F.lit(4)) == "elif").select("unit_id", "pre", "ancestors", "_elif", "kind")
    heads = innermost(ifs.where("_elif"), ifs.where("not _elif"), F.lit(True), "branch").select("unit_id", F.col("branch"), F.col("pre").alias("arm"))
    chained = ifs.where("not _elif").select("unit_id", F.col("pre").alias("branch"), F.col("pre").alias("arm")).unionByName(heads)
    tests = chained.join(first, ["unit_id", "arm"]).join(text, "unit_id").select("unit_id", "branch", F.lit("If").alias("family"), "arm", F.nullif(F.trim(cut), F.lit("")).alias("signature"))
    every = cases.join(flow.where("kind = 'Match'").drop("kind"), ["unit_id", "branch"], "left_semi").unionByName(tests)
    return every.withColumn("number", F.row_number().over(Window.partitionBy("unit_id", "branch").orderBy("arm")).cast("int") - 1)


def alike_branches(before: DataFrame, after: DataFrame, least: float = 0.75) -> DataFrame:
    """(pair_id, family, b_pre, a_pre, cost) of branches of one family that share at least `least` of their signatures, one to one, the most alike first. before and after: arms() with a pair_id."""
    side = lambda a, s: a.where("signature is not null").select("pair_id", "family", F.col("branch").alias(s), "signature")
    like = similar_sets(side(before, "b_pre"), side(after, "a_pre"), ["pair_id", "family"], "signature", least, ("b_pre", "a_pre"))
    cost = F.round(1 - F.col("jaccard"), 9)
    return greedy(like.withColumn("cost", cost).drop("jaccard"), ["pair_id", "b_pre"], ["pair_id", "a_pre"], "cost")


def matching_arms(before: DataFrame, after: DataFrame, branches: DataFrame) -> DataFrame:
    """(pair_id, b_branch, a_branch, b_pre, a_pre) of arms of partners: the k-th arm of a signature with the k-th of the same; arms without a signature have no partner here."""
    w = Window.partitionBy("pair_id", "branch", "signature").orderBy("number")
    side = lambda a, s: a.where("signature is not null").withColumn("k", F.row_number().over(w)).select("pair_id", F.col("branch").alias(f"{s}_branch"), "signature", "k", F.col("arm").alias(f"{s}_pre"))
    met = branches.select("pair_id", F.col("b_pre").alias("b_branch"), F.col("a_pre").alias("a_branch"))
    return met.join(side(before, "b"), ["pair_id", "b_branch"]).join(side(after, "a"), ["pair_id", "a_branch", "signature", "k"]).select("pair_id", "b_branch", "a_branch", "b_pre", "a_pre")
