"""Sessions: the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "palimpsest", cores: str = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster, submit with its own settings and pass any session to the operators."""
    builder = (
        SparkSession.builder.appName(name)
        .master(f"local[{cores}]")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where it is read, without a shuffle, in fewer partitions than there are cores: costly work on a small file's rows is shared. Looking this up runs nothing."""
    if "Adaptive" in df._jdf.queryExecution().executedPlan().toString():  # there is a shuffle, or more
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose rows reach Python in Arrow batches of at most 1,000 rows and 8 MB: rows that hold whole texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df
