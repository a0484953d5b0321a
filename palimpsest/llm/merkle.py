"""Merkle manifest of a table, in Pregel-style supersteps over RDDs.

Each row is a leaf, hashed in column expressions. The leaves of a group ascend by their order and form a tree whose nodes have `fan` children (the last
node of a level fewer); the roots of the groups ascend by group and form a tree of their own in the same way.

Upward, a superstep lets every node of a level send its digest to its parent; a parent that has all its children hashes them and is a node of the next
superstep. All groups climb together, so there are as many supersteps as the largest group has levels: its logarithm to the base `fan`. Downward, a parent
that knows the path above it sends each child that path with the child's siblings before it; the leaves at last hold all siblings up to the root.

No group is ever gathered: a parent has at most `fan` children, and places in a group come from a sort of all leaves by range, whose partitions are counted, so
that a group spreads over as many tasks as it needs. The driver sees the size of the largest group, the number of groups and the root. Vertices are
checkpointed in the folder that driver and executors share.

Defined results: nulls come first and hash as `-`; leaves that are equal in group, order and digest are interchangeable and each has a place of its own. A group of
one leaf has that leaf as its root, a table of one group that group's root. An empty table gives no rows. Columns `subroot`, `root` and `proof` give way to the
results; no other name has a meaning.
"""

from __future__ import annotations

import hashlib

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut, partitions, shared_dir

FAN = 16
PROOF = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def framed(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value: no two lists of values have the same concatenation."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row, in lowercase hexadecimal digits."""
    return F.sha2(F.concat(*map(framed, columns)), 256)


def folded(leaf_digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and the siblings of its path lead to."""
    return F.aggregate(proof, leaf_digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def siblings(proof: Column) -> Column:
    """The digest of all siblings of a path, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def hashed(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int, fan: int) -> int:
    """Levels above n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // fan), k + 1
    return k


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with _pos, the place of a row in its group from 0, and _n, the rows of the group.

    The rows are sorted by range, however large a group is; each partition's part of a group is counted, and the counts before it are added.
    """
    by = [*group, *order, "_row"]
    dealt = cut(
        df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions(df.sparkSession), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ).drop("_row").withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_part").alias("_p")).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    of = Window.partitionBy(F.lit(0), *(f"_g{i}" for i in range(len(group))))
    runs = runs.withColumn("_n", F.sum("_c").over(of)).withColumn("_before", F.sum("_c").over(of.orderBy("_p")) - F.col("_c"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return dealt.join(runs, same).withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, "_pos", "_n")


def climbed(nodes: RDD, steps: int, fan: int, tasks: int) -> list[RDD]:
    """The parents of each superstep, ((group, place), (nodes of the level, digests of the children)), from nodes ((group, place), (nodes of the level, digest))."""

    def send(node):
        (g, at), (n, digest) = node
        return (g, at // fan), (at % fan, n, digest)

    def complete(item):
        (g, at), messages = item
        children = sorted(messages)
        n = children[0][1]
        if len(children) != min(fan, n - at * fan):
            raise ValueError("a parent has not heard of all its children")
        return (g, at), (-(-n // fan), [d for _, _, d in children])

    levels = []
    for _ in range(steps):
        parents = nodes.filter(lambda x: x[1][0] > 1).map(send).groupByKey(tasks).map(complete)
        parents.checkpoint()
        levels.append(parents)
        nodes = parents.mapValues(lambda v: (v[0], hashed(v[1])))
    return levels


def tops(nodes: RDD, levels: list[RDD]) -> RDD:
    """(group, digest) of what remains of each group."""
    found = [nodes.filter(lambda x: x[1][0] == 1).map(lambda x: (x[0][0], x[1][1]))]
    found += [parents.filter(lambda x: x[1][0] == 1).map(lambda x: (x[0][0], hashed(x[1][1]))) for parents in levels]
    return nodes.context.union(found)


def descended(levels: list[RDD], above: RDD, tasks: int, fan: int) -> RDD:
    """((group, place), (digests of the children or None, path above them)) of the lowest parents, where `above` holds (group, (levels, path)) for each group.

    The path of a group without parents comes with None.
    """
    messages = None
    for k in range(len(levels), 0, -1):
        heard = above.filter(lambda x, k=k: x[1][0] == k).map(lambda x: ((x[0], 0), x[1][1]))
        if messages is not None:
            heard = heard.union(messages)
        met = levels[k - 1].mapValues(lambda v: v[1]).join(heard, tasks)

        def send(item):
            (g, at), (children, (path, top)) = item
            for i in range(len(children)):
                yield (g, at * fan + i), ([("".join(children[:i]), "".join(children[i + 1 :])), *path], top)

        messages = met.flatMap(send) if k > 1 else met
    lone = above.filter(lambda x: x[1][0] == 0).map(lambda x: ((x[0], 0), (None, x[1][1])))
    return lone if messages is None else messages.union(lone)


def proofs(df: DataFrame, group: str, order: list[str], digest: str, fan: int = FAN) -> DataFrame:
    """df with subroot (of the row's group), root and proof: for each level from the leaf up, the digests of the siblings before and after."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    tasks = partitions(spark)
    kept = [c for c in df.columns if c not in ("subroot", "root", "proof")]
    schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(c, T.StringType()) for c in ("subroot", "root")), T.StructField("proof", PROOF)])
    # names of steps between are given here alone, so that no column clashes with them
    plain = df.select(*(df[c].alias(f"c{i}") for i, c in enumerate(kept)), df[group].alias("g"), *(df[c].alias(f"o{i}") for i, c in enumerate(order)), df[digest].alias("d"))
    placed = cut(numbered(plain, ["g"], [f"o{i}" for i in range(len(order))] + ["d"]))
    most = placed.agg(F.max("_n")).first()[0]
    if most is None:
        return spark.createDataFrame([], schema)
    leaves = placed.select("g", "_pos", "_n", "d").rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3])))
    levels = climbed(leaves, height(most, fan), fan, tasks)

    # the tree of the groups' roots, whose leaves remember how many levels are below them
    roots = tops(leaves, levels)
    sizes = placed.groupBy("g").agg(F.max("_n").alias("n"))
    named = spark.createDataFrame(roots, T.StructType([T.StructField("h", plain.schema["g"].dataType), T.StructField("d", T.StringType())]), verifySchema=False)
    ranked = cut(numbered(named.join(sizes, F.col("h").eqNullSafe(F.col("g"))).select("g", "d", "n"), [], ["g"]))
    groups = ranked.agg(F.max("_n")).first()[0]
    upper = ranked.select("_pos", "_n", "d").rdd.map(lambda r: ((0, r[0]), (r[1], r[2])))
    higher = climbed(upper, height(groups, fan), fan, tasks)
    root = tops(upper, higher).first()[1]

    at_top = spark.sparkContext.parallelize([(0, (height(groups, fan), ([], None)))])
    lowest = descended(higher, at_top, tasks, fan)

    def apart(item):
        (g, at), (children, (path, _)) = item
        if children is None:
            yield at, path
        for i in range(len(children or [])):
            yield at * fan + i, [("".join(children[:i]), "".join(children[i + 1 :])), *path]

    above = ranked.select("_pos", "g", "d", "n").rdd.map(lambda r: (r[0], (r[1], r[2], r[3]))).join(lowest.flatMap(apart), tasks)
    above = above.map(lambda x: (x[1][0][0], (height(x[1][0][2], fan), (x[1][1], x[1][0][1]))))

    width = len(kept)
    names = [f"c{i}" for i in range(width)]
    rows = placed.select("g", "_pos", *names).rdd.map(lambda r: ((r[0], r[1] // fan), (r[1] % fan, tuple(r[2:]))))

    def proven(item):
        (i, row), (children, (path, top)) = item[1]
        own = [] if children is None else [("".join(children[:i]), "".join(children[i + 1 :]))]
        return (*row, top, root, [*own, *path])

    return spark.createDataFrame(rows.join(descended(levels, above, tasks, fan), tasks).map(proven), schema, verifySchema=False)


def checked(df: DataFrame, key: str, group: str, fields: list[str], text: str, every: int = 5) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of a table whose rows are verified after tampering.

    A row is tampered with where `every` divides the CRC-32 of its key's digits: the capitals A to Z of its text become small. A null key is not.
    """
    low = F.translate(df[text], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(df[key].cast("string").cast("binary")) % every == 0
    rows = df.select(
        df[key].alias(key),
        df[group].alias("_group"),
        leaf(*(df[c] for c in fields)).alias("leaf"),
        F.when(touched, leaf(*(low if c == text else df[c] for c in fields))).alias("_tampered"),
    )
    found = proofs(rows, "_group", [key], "leaf")
    again = folded(F.coalesce("_tampered", "leaf"), F.col("proof"))
    return found.select(key, "leaf", "subroot", "root", siblings(F.col("proof")).alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
