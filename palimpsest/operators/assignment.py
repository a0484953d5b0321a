"""One-to-one assignment of candidates, cheapest first, for groups of any size."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared checkpoint folder as compressed columns, its lineage cut; recovers from lost executors.

    A frame that is read from files has their size, so no join takes it for as small as what it was made from, and only the columns that a step asks for are read.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="palimpsest-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a frame that written() gave, when nothing will read it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def greedy(candidates: DataFrame, before: list[str], after: list[str], cost: str, most: float | None = None) -> DataFrame:
    """The candidate pairs that taking the cheapest pair of free sides again and again accepts, ties by before and then after.

    A pair that is the cheapest of both its sides is accepted whatever else there is, so each round accepts all such pairs at
    once and drops what shares a side with them: the result is that of the sequence, in few rounds, without gathering a group.
    """
    order = F.struct(cost, *before, *after)
    if common := [c for c in before if c in after]:
        return _greedy_within(candidates.where(F.col(cost) <= most) if most is not None else candidates, before, after, common, order)
    left = written(candidates.where(F.col(cost) <= most) if most is not None else candidates)
    taken: list[DataFrame] = []
    while True:
        b = left.groupBy(*before).agg(F.min(order).alias("_b"))
        a = left.groupBy(*after).agg(F.min(order).alias("_a"))
        best = left.join(b, before).join(a, after).where((order == F.col("_b")) & (order == F.col("_a"))).select(*candidates.columns)
        best = written(best.dropDuplicates([*before, *after]))
        if not best.take(1):
            break
        taken.append(best)
        rest = written(left.join(best.select(*before), before, "left_anti").join(best.select(*after), after, "left_anti"))
        forget(left)
        left = rest
    return reduce(DataFrame.unionByName, taken, best)


def _greedy_within(candidates: DataFrame, before: list[str], after: list[str], common: list[str], order: Column) -> DataFrame:
    """greedy() where both sides share a key: what is left is dealt out once a round, by that key, and windows do the rest."""
    left, old = candidates, None
    taken: list[DataFrame] = []
    b, a = Window.partitionBy(*before), Window.partitionBy(*after)
    while True:
        first = (F.row_number().over(b.orderBy(order)) == 1) & (F.min(order).over(a) == order)
        met = left.repartition(*common).withColumn("_took", first)
        met = met.withColumn("_hit", F.max("_took").over(a)).withColumn("_hit", F.max("_took").over(b) | F.col("_hit"))
        rows = written(met.where("_took or not _hit").drop("_hit"))
        best = written(rows.where("_took").select(*candidates.columns))
        if old is not None:
            forget(old)
        if not best.take(1):
            return reduce(DataFrame.unionByName, taken, best)
        taken.append(best)
        left, old = rows.where("not _took").select(*candidates.columns), rows


def similar_lines(pairs: DataFrame, least: float) -> DataFrame:
    """(pair_id, b_row, a_row, jaccard) of lines of both sides (pair_id, before, after) that have at least `least` of their words in common: similar_sets() of a pair's lines, where the pair lies.

    Words are parted by white space (ASCII). Both texts are in one row, so neither words nor how rare they are leave it.
    """
    from palimpsest.functions.text import lines

    schema = f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, b_row int, a_row int, jaccard double"
    word = re.compile(r"[^ \t\n\x0b\f\r]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b, a = ([set(word.findall(x)) for x in side] for side in (before, after))
                for i, j, alike in _alike(b, a, least):
                    for column, x in zip(out, (key, i, j, alike), strict=True):
                        column.append(x)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["pair_id", "b_row", "a_row", "jaccard"])

    of = lambda c: lines(F.coalesce(c, F.lit("")))
    return pairs.where("before is not null and after is not null").select("pair_id", of("before").alias("b"), of("after").alias("a")).mapInArrow(run, schema)


def _alike(before: list[set], after: list[set], least: float) -> Iterator[tuple[int, int, float]]:
    """Places of sets with at least `least` in common, found by the rarest items (prefix filter)."""
    often = Counter(x for sets in (before, after) for s in sets for x in s)
    prefix = lambda s: sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(least * len(s)) + 1]
    places: dict[str, list[int]] = {}
    for j, s in enumerate(after):
        for x in prefix(s):
            places.setdefault(x, []).append(j)
    for i, s in enumerate(before):
        for j in sorted({j for x in prefix(s) for j in places.get(x, ())}):
            both = len(s & after[j])
            if (alike := both / (len(s) + len(after[j]) - both)) >= least:
                yield i, j, alike


def similar_sets(before: DataFrame, after: DataFrame, key: list[str], item: str, least: float, ids: tuple[str, str] = ("b_id", "a_id")) -> DataFrame:
    """(key..., b_id, a_id, jaccard) of sets that share a key and at least `least` of their items.

    Both frames have a row for each item of each set: (key..., id, item). Pairs come from shared items alone, and only items among the
    rarest (1 - least) part and one more of a set are looked up (prefix filter), so common items make no pairs.
    """
    b_id, a_id = ids
    rows = before.select(*key, F.col(b_id).alias("id"), item).distinct().unionByName(after.select(*key, F.col(a_id).alias("id"), item).distinct())
    rarity = rows.groupBy(*key, item).agg(F.count("*").alias("_df"))

    def sets(df: DataFrame, name: str, out: str) -> DataFrame:
        g = df.select(*key, F.col(name).alias(out), item).distinct().join(rarity, [*key, item]).groupBy(*key, out)
        return g.agg(F.transform(F.array_sort(F.collect_list(F.struct("_df", item))), lambda x: x[item]).alias(f"{out}_items"))

    prefix = lambda c: F.slice(c, F.lit(1), F.size(c) - F.ceil(F.lit(least) * F.size(c)).cast("int") + 1)
    b, a = sets(before, b_id, b_id), sets(after, a_id, a_id)
    probe = lambda d, n: d.select("*", F.explode(prefix(F.col(f"{n}_items"))).alias("_item"))
    met = probe(b, b_id).join(probe(a, a_id), [*key, "_item"]).drop("_item").dropDuplicates([*key, b_id, a_id])
    both = F.size(F.array_intersect(f"{b_id}_items", f"{a_id}_items"))
    j = both / (F.size(f"{b_id}_items") + F.size(f"{a_id}_items") - both)
    return met.select(*key, b_id, a_id, j.alias("jaccard")).where(F.col("jaccard") >= least)
