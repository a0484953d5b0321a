"""What comparing a pair costs, measured where it is done: time of each repeat and peak memory, for each way of comparing."""

from __future__ import annotations

import time
import tracemalloc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COSTS = "tool string, status string, nodes long, ms array<double>, peak_bytes long, total_bytes long"


def _tools() -> dict[str, Callable[[str, str, str], int | None]]:
    """Ways to compare two texts of a language; each returns how many nodes (or lines) it looked at, None where it does not apply."""
    from palimpsest.operators.alignment import line_diff, text_lines
    from palimpsest.operators.matching import Config, match
    from palimpsest.operators.trees import build

    def parse(x: str, y: str, lang: str) -> int | None:
        b, a = build(x, lang, False), build(y, lang, False)
        return None if b is None or a is None else b.n + a.n

    def lines(x: str, y: str, lang: str) -> int | None:
        line_diff(x, y)
        return len(text_lines(x)) + len(text_lines(y))

    def trees(x: str, y: str, lang: str) -> int | None:
        b, a = build(x, lang), build(y, lang)
        if b is None or a is None:
            return None
        match(b, a, Config())
        return b.n + a.n

    return {"parse": parse, "lines": lines, "trees": trees}


def costs(pairs: DataFrame, repeats: int = 3, tools: list[str] | None = None) -> DataFrame:
    """(pair_id, tool, status, nodes, ms, peak_bytes, total_bytes) of each way of comparing pairs (pair_id, before, after, language).

    parse is the lower bound of all that need trees. ms has one entry for each repeat; memory is that of one run before these, in which all allocations are traced, from the moment the run begins; it also tells whether a way applies. A pair
    to which a way does not apply has the status no_tree and no times, one that breaks off failed. Rows are measured where they lie.
    """
    schema = T.StructType([pairs.schema["pair_id"], *T.StructType.fromDDL(COSTS).fields])

    def one(f: Callable[[str, str, str], int | None], x: str, y: str, lang: str) -> tuple:
        try:
            tracemalloc.start()
            try:
                n = f(x, y, lang)
                left, peak = tracemalloc.get_traced_memory()
            finally:
                tracemalloc.stop()
            if n is None:
                return "no_tree", None, None, None, None
            ms = []
            for _ in range(repeats):
                begun = time.perf_counter()
                f(x, y, lang)
                ms.append(1000 * (time.perf_counter() - begun))
            return "ok", n, ms, peak, left
        except (RecursionError, MemoryError):
            return "failed", None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields, known = to_arrow_schema(schema), _tools()
        wanted = {k: f for k, f in known.items() if tools is None or k in tools}
        for b in batches:
            rows = [(key, name, *one(f, x or "", y or "", lang)) for key, x, y, lang in zip(*(c.to_pylist() for c in b.columns), strict=True) for name, f in wanted.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=fields)

    return pairs.select("pair_id", "before", "after", "language").mapInArrow(run, schema)


def evaluated(measured: DataFrame, wrong: DataFrame) -> DataFrame:
    """(pair_id, tool, status, mismatches, entries, agreement, ms, median_ms): what each way of comparing got wrong beside what it cost.

    wrong: (pair_id, tool, entries, mismatches) of the tools that people's entries can be held against; others have nulls. agreement is in percent, 0 where there are no entries.
    """
    median = F.sort_array("ms")[F.floor((F.size("ms") - 1) / 2).cast("int")]
    met = measured.join(wrong, ["pair_id", "tool"], "left")
    agreement = F.when(F.col("entries") > 0, 100 - 100 * F.col("mismatches") / F.col("entries")).when(F.col("entries") == 0, 0.0)
    return met.select("pair_id", "tool", "status", "mismatches", "entries", agreement.alias("agreement"), "ms", median.alias("median_ms"))


def summary(measured: DataFrame) -> DataFrame:
    """(tool, pairs, ok, timings, median_ms, p90_ms, max_ms, mean_cov, peak_bytes): costs() by tool; mean_cov is the mean variation (in percent) of a pair's repeats."""
    mean = F.aggregate("ms", F.lit(0.0), lambda s, x: s + x) / F.size("ms")
    spread = F.sqrt(F.aggregate("ms", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size("ms"))
    rows = measured.withColumn("_median", F.sort_array("ms")[F.floor((F.size("ms") - 1) / 2).cast("int")]).withColumn("_cov", F.when((F.size("ms") > 1) & (mean > 0), 100 * spread / mean))
    return rows.groupBy("tool").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("status") == "ok").alias("ok"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.size("ms"))), F.lit(0)).cast("long").alias("timings"), F.percentile("_median", 0.5).alias("median_ms"),
        F.percentile("_median", 0.9).alias("p90_ms"), F.max("_median").alias("max_ms"), F.avg("_cov").alias("mean_cov"), F.max("peak_bytes").alias("peak_bytes"),
    )
