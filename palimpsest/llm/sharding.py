"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points (virtual nodes) of a ring; a key's hash names its arc, whose end is its
home point. A shard has a fixed load: n // shards rows, one more for the first n % shards of them.
Keys that find their shard full continue clockwise to the next point whose shard has room, keys at
home going before those that come by. So counts are at most one apart, and adding a shard or a row
moves only the keys of the arcs whose owner or overflow changes.

The walk around the ring needs no rows: only the number of keys of each arc, and of each of the 2**CUT_BITS equal parts of the ring that an arc lies in, reaches the driver, whatever the input. It
yields, for each arc, intervals of ranks and their shard and first slot; a row finds its interval by its rank within its arc, which is its rank within the part and the keys of the arc's parts before it. So a task ranks the
keys of small parts of the ring only. Keys
are hashed with their ties, so the arcs are even however many rows share a source, a language, a text or an id; only rows that are
equal in key and ties share a place on the ring and take consecutive ranks.

Defined results: a null id hashes like any other value; a null text has size 1 and the CRC of no bytes, and an empty one the same; an
empty table gives no rows. Columns that are neither key nor ties have no part in it, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = 128
#: The ring is cut into so many parts, as a power of 2, in which rows are ranked: of 10**11 rows some 5 million each. Counts of that many parts and arcs reach the driver.
CUT_BITS = 14


def ring(shards: int, points: int = POINTS) -> tuple[list[int], list[int]]:
    """Positions (signed longs, ascending) and the shard of each virtual node."""
    nodes = sorted(
        (int.from_bytes(hashlib.sha256(f"{s}:{p}".encode()).digest()[:8], "big", signed=True), s)
        for s in range(shards)
        for p in range(points)
    )
    return [x for x, _ in nodes], [s for _, s in nodes]


def walk(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot) for each interval of keys, from keys per arc."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    out = []
    passing: list[tuple[int, int, int]] = []
    for lap in (0, 1):
        for arc, shard in enumerate(owners):
            own = [(arc, 0, counts[arc])] if not lap and counts.get(arc) else []
            queue, passing = own + passing, []
            for a, lo, hi in queue:
                fit = min(hi - lo, room[shard] - used[shard])
                if fit:
                    out.append((a, lo, lo + fit, shard, used[shard]))
                    used[shard] += fit
                if lo + fit < hi:
                    passing.append((a, lo + fit, hi))
    return out


def _arc(position, positions: list[int]):
    """The arc that ends at the first node at or after a position, the first arc after the last node.

    One comparison for each level of a binary search over the nodes, as a chain of array lookups.
    """
    n = len(positions)
    nodes = F.array(*map(F.lit, positions))
    steps = n.bit_length()
    low = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(
                F.element_at(nodes, F.shiftright(s["lo"] + s["hi"], 1) + 1) < position,
                F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi")),
            ).otherwise(F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi")))
        ),
        lambda s: s["lo"],
    )
    return F.pmod(low, F.lit(n))


def shard(df: DataFrame, key: str, ties: list[str], shards: int = 16, points: int = POINTS) -> DataFrame:
    """The key and ties columns of df with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    ties order rows that share a key; rows equal in them all are the same row for this purpose.
    """
    spark = df.sparkSession
    positions, owners = ring(shards, points)
    row = F.struct(*(df[c] for c in (key, *ties)))
    placed = df.select(row.alias("_row"), F.xxhash64(*(df[c] for c in (key, *ties))).alias("_at")).withColumn("_arc", _arc(F.col("_at"), positions)).withColumn("_cut", F.shiftright("_at", 64 - CUT_BITS).cast("int"))
    counts: dict[int, int] = {}
    before = []  # (arc, part, keys of the arc in the parts before)
    for r in sorted(placed.groupBy("_arc", "_cut").count().collect()):  # at most a row for each part and each arc
        before.append((r["_arc"], r["_cut"], counts.get(r["_arc"], 0)))
        counts[r["_arc"]] = counts.get(r["_arc"], 0) + r["count"]
    schema = T.StructType(
        [T.StructField("_arc", T.IntegerType()), T.StructField("_lo", T.LongType()), T.StructField("_hi", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("_slot", T.LongType())]
    )
    runs = spark.createDataFrame(walk(counts, owners, shards), schema).groupBy("_arc").agg(F.collect_list(F.struct("_lo", "_hi", "shard", "_slot")).alias("_runs"))
    in_part = Window.partitionBy("_arc", "_cut").orderBy("_at", "_row")
    offsets = spark.createDataFrame(before, "_arc int, _cut int, _before long")
    ranked = placed.withColumn("_nth", F.row_number().over(in_part).cast("long") - 1).join(F.broadcast(offsets), ["_arc", "_cut"]).withColumn("_rank", F.col("_nth") + F.col("_before"))
    found = ranked.join(F.broadcast(runs), "_arc").withColumn(
        "_run", F.filter("_runs", lambda r: (r["_lo"] <= F.col("_rank")) & (F.col("_rank") < r["_hi"]))[0]
    )
    return found.select(*(F.col("_row")[c].alias(c) for c in (key, *ties)), F.col("_run.shard").alias("shard"), (F.col("_run._slot") + F.col("_rank") - F.col("_run._lo")).alias("slot"))
