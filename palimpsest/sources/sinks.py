"""Tables that are replaced by key, sorted CSV, and directories of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.sampling import latest, upsert


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def _replace(spark: SparkSession, path: str) -> None:
    """Put the whole table at path.new in the place of the one at path, which is kept as path.old until that is done."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(at(f"{path}.old"), True)
    for a, b in ((path, f"{path}.old"), (f"{path}.new", path)):
        if not fs.rename(at(a), at(b)):
            raise OSError(f"{a} could not be renamed to {b}")
    fs.delete(at(f"{path}.old"), True)


def recover(spark: SparkSession, path: str) -> None:
    """Bring back the table at path if a replacement was broken off between taking the old one away and putting the new one in its place."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    if not _exists(spark, path) and _exists(spark, f"{path}.old"):
        fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.rename(at(f"{path}.old"), at(path)):
            raise OSError(f"{path}.old could not be renamed to {path}")


def merge(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Write rows into the Parquet table at path, in place of those of equal keys; the last of several new ones wins.

    The table is written anew beside the old one and takes its place when whole. A break between the two renames leaves the old table at path.old,
    from where the next call (or recover()) brings it back.
    """
    spark = rows.sparkSession
    recover(spark, path)
    new = latest(rows, keys, order)
    if not _exists(spark, path):
        new.write.parquet(path)
        return
    old = spark.read.parquet(path)
    upsert(old, new.select(*old.columns), keys).write.mode("overwrite").parquet(f"{path}.new")
    _replace(spark, path)


def sorted_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header, globally sorted over its files; nulls are empty."""
    rows.orderBy(*order).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def wide_reasons(rows: DataFrame, key: str, reason: str, fixed: list[str]) -> DataFrame:
    """(key, a column for each fixed reason and each further one that occurs, total) with a TOTAL row; absent ones 0."""
    more = [r[reason] for r in rows.select(reason).distinct().orderBy(reason).collect() if r[reason] not in fixed]  # reasons are few by nature
    names = [*fixed, *more]
    counts = rows.rollup(key).agg(*(F.count_if(F.col(reason) == n).alias(n) for n in names), F.count("*").alias("total"), F.grouping(key).alias("_g"))
    return counts.withColumn(key, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(key).cast("string"))).drop("_g")


def distinct_names(pairs: DataFrame, name: str, before: str, after: str) -> DataFrame:
    """pairs with target: the name, or name-2, name-3... for further pairs of other contents; pairs of equal contents share one."""
    content = F.md5(F.concat_ws("\0", before, after))
    ranked = pairs.withColumn("_k", F.dense_rank().over(Window.partitionBy(name).orderBy(content)))
    return ranked.withColumn("target", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat_ws("-", name, F.col("_k").cast("string")))).drop("_k")


def write_pairs(pairs: DataFrame, folder: str) -> DataFrame:
    """(target, status) of pairs (target, extension, before, after, origin), each written as a folder below `folder`, which every executor must reach.

    A folder holds before.<extension>.test, after.<extension>.test and source.json (origin, a struct). Files are written under a name of their own and renamed, so a folder is never
    half of one pair and half of another after a lost task; what is there already with the same contents is kept. The work is done when the frame is collected or written.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for b in batches:
            done = []
            for r in b.to_pylist():
                at = f"{base}/{r['target']}"
                files = {f"before.{r['extension']}.test": r["before"] or "", f"after.{r['extension']}.test": r["after"] or "", "source.json": r["origin"]}
                store.create_dir(at, recursive=True)
                status = "kept"
                for name, text in files.items():
                    raw = text.encode()
                    if store.get_file_info(f"{at}/{name}").type == fs.FileType.File:
                        with store.open_input_stream(f"{at}/{name}") as f:
                            if f.read() == raw:
                                continue
                    status = "written"
                    hidden = f"{at}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(hidden) as f:
                        f.write(raw)
                    store.move(hidden, f"{at}/{name}")
                done.append((r["target"], status))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["target", "status"])

    rows = pairs.select("target", "extension", "before", "after", F.to_json("origin").alias("origin"))
    return rows.mapInArrow(run, "target string, status string")


#: Tables of file statistics, and the keys their rows are replaced by.
STATISTICS = {"files": ["path"], "node_kind_counts": ["path", "kind"], "node_kind_subtree_size_histogram": ["path", "kind", "size_bucket"]}


def statistics_tables(units: DataFrame) -> dict[str, DataFrame]:
    """The tables of STATISTICS for units (path, language, category, bytes, valid, contents, last_updated): files, and nodes by kind and by size."""
    from palimpsest.operators.trees import flatten
    from palimpsest.streaming.ingest import file_statistics

    files = file_statistics(units)
    counted = units.join(files.where("counted and not automatically_generated").select("path"), "path", "left_semi")
    kinds = flatten(counted, "path", "contents", "language", ["kind", "size"]).groupBy(F.col("unit_id").alias("path"), "kind", (F.length(F.bin("size")) - 1).cast("int").alias("size_bucket")).agg(F.count("*").alias("n"))
    stamped = kinds.join(units.select("path", "last_updated"), "path")
    by_kind = stamped.groupBy("path", "kind", "last_updated").agg(F.sum("n").alias("n"))
    nodes = kinds.groupBy("path").agg(F.sum("n").alias("ast_nodes"))
    return {
        "files": files.join(nodes, "path", "left").na.fill(0, ["ast_nodes"]),
        "node_kind_counts": by_kind.select("path", "kind", "n", "last_updated"),
        "node_kind_subtree_size_histogram": stamped.select("path", "kind", "size_bucket", "n", "last_updated"),
    }


def write_statistics(units: DataFrame, target: str) -> None:
    """Merge the tables into folders below target; a file that is measured again loses the kinds it no longer has."""
    spark = units.sparkSession
    for name, rows in statistics_tables(units).items():
        path = f"{target}/{name}"
        recover(spark, path)
        if name != "files" and _exists(spark, path):
            rest = spark.read.parquet(path).join(units.select("path"), "path", "left_anti")
            rest.unionByName(rows).write.mode("overwrite").parquet(f"{path}.new")
            _replace(spark, path)
        else:
            merge(rows, path, STATISTICS[name], ["last_updated"])
