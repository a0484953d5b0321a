"""Files as a stream: new ones are measured in micro-batches and merged into a table by path."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from palimpsest.functions import languages as L
from palimpsest.functions import text as T
from palimpsest.sources.files import with_units
from palimpsest.sources.sinks import STATISTICS, merge, size, statistics_tables
from palimpsest.sources.versions import Tables

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_statistics(units: DataFrame) -> DataFrame:
    """Statistics of units that are code or configuration, without their contents.

    Generated files and those too large to parse have no line count, as nothing is counted in them.
    """
    c = F.coalesce("contents", F.lit(""))
    generated, large = T.is_generated(c), F.col("bytes") > T.TOO_LARGE
    return units.where(F.col("category").isin("Code", "Configuration") | ~F.col("valid")).select(
        "path", "last_updated", "language", "category", "bytes", (~generated & ~large & F.col("valid")).alias("counted"),
        F.when(generated | large, 0).otherwise(T.line_feeds(c)).cast("long").alias("lines_of_code"), generated.alias("automatically_generated"),
        (~F.col("valid")).alias("failed_to_convert_to_utf8"), large.alias("too_large_to_parse"),
    )


class Full(Exception):
    """The table has reached its limit; the batch that was to be written is not marked as read."""


def _units(spark: SparkSession, root: str, files_per_batch: int, glob: str) -> DataFrame:
    stream = (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", str(files_per_batch)).load(root)
    )
    return with_units(stream.where(~L.skipped(F.col("path"))))


def _started(units: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return units.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, root: str, target: str, checkpoint: str, files_per_batch: int = 1000, most_bytes: int | None = None, glob: str = "*") -> StreamingQuery:
    """A query that merges statistics of files below root into the table at target until it has seen all there are.

    Back pressure is the number of files of a batch. Once the table reaches most_bytes the query ends (see ended()); a later one with a higher limit goes on with the batch that did not fit.
    """

    def write(batch: DataFrame, _: int) -> None:
        if most_bytes is not None and size(batch.sparkSession, target) >= most_bytes:
            raise Full(target)
        measured = file_statistics(batch).persist()  # small rows; contents are read once
        merge(measured, target, ["path"], ["last_updated"])
        measured.unpersist()

    return _started(_units(spark, root, files_per_batch, glob), write, checkpoint)


def tables(spark: SparkSession, target: str) -> Tables:
    """The tables of file statistics at target."""
    return Tables(spark, target, list(STATISTICS), "path")


def ingest_tables(spark: SparkSession, root: str, target: str, checkpoint: str, files_per_batch: int = 1000, most_bytes: int | None = None, glob: str = "*") -> StreamingQuery:
    """As ingest(), with the tables of nodes by kind and by size too: all of them change together, and a batch that is played again changes nothing.

    The stream's name in the tables is its checkpoint. Of a file that one batch holds twice, the last state counts.
    """
    at = tables(spark, target)

    def write(batch: DataFrame, number: int) -> None:
        if most_bytes is not None and at.size() >= most_bytes:
            raise Full(target)
        units = batch.persist()
        try:
            at.commit(checkpoint, number, statistics_tables(units))
        finally:
            units.unpersist()

    return _started(_units(spark, root, files_per_batch, glob), write, checkpoint)


def ended(query: StreamingQuery) -> bool:
    """Wait for a query of ingest() or ingest_tables(): whether it has seen all files; False if it ended because its table is full."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if Full.__name__ in str(e):
            return False
        raise
    return True


class Throughput(StreamingQueryListener):
    """Rows and batches of the queries that have run since it was added."""

    def __init__(self) -> None:
        self.rows = self.batches = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def running_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) of event streams (or tables) by windows of event time; what comes later than `late` is not counted."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
