"""Files, directories of pairs, and tables of earlier runs, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import languages as L

PAIR_SCHEMA = "language string, size_bucket string, repository string, commit string, path string, old_path string"
SAMPLE_SCHEMA = "language string, repository string, commit string, path string, promoted_to string"
BENCHMARK_SCHEMA = (
    "language string, size_bucket string, repository string, commit string, path string, bytes_before long, bytes_after long, ast_nodes_before long, "
    "ast_nodes_after long, status string, elapsed_ms double, peak_memory_bytes long, total_allocated_bytes long, mapping_operations long"
)
HUMAN_SCHEMA = "entries array<struct<operation string, before_path array<string>, after_path array<string>>>"


def with_units(files: DataFrame) -> DataFrame:
    """(path, language, category, subtype, bytes, valid, contents, last_updated) of binaryFile rows; contents null where they are not UTF-8."""
    valid = F.is_valid_utf8(F.col("content"))
    kind = L.file_type(F.col("path"))
    return files.select(
        "path", L.language(F.col("path")).alias("language"), kind["category"].alias("category"), kind["subtype"].alias("subtype"), F.col("length").alias("bytes"),
        valid.alias("valid"), F.when(valid, F.decode("content", "utf-8")).alias("contents"), F.col("modificationTime").alias("last_updated"),
    )


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """All files below a root (or one file) but those whose paths are not looked at. Files that vanish or cannot be read are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    return with_units(files.where(~L.skipped(F.col("path"))))


def directory_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(name, language, before, after) of directories that hold before.<ext>[.test] and after.<ext>[.test]; both sides are needed."""
    units = scan(spark, root).withColumn("_file", L.file_name(F.col("path"))).where("_file rlike '^(before|after)[.]'")
    side = F.regexp_extract("_file", "^(before|after)", 1)
    name = F.element_at(F.split("path", "/"), -2)
    g = units.groupBy(name.alias("name")).agg(
        F.max(F.when(side == "before", F.col("contents"))).alias("before"), F.max(F.when(side == "after", F.col("contents"))).alias("after"), F.max("language").alias("language")
    )
    return g.where("before is not null and after is not null").select("name", "language", "before", "after")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header by an explicit schema; columns that it lacks at the end are null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", enforceSchema=True)


def benchmark_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs from files benchmark_<language>.csv, with the language of the file's name."""
    df = csv(spark, f"{root}/benchmark_*.csv", BENCHMARK_SCHEMA)
    return df.withColumn("file_language", F.regexp_extract(F.input_file_name(), r"benchmark_([a-z]+)\.csv", 1))


def scored_tools(df: DataFrame) -> DataFrame:
    """(solution, total_lines, tool, mismatches): the columns <tool>_mismatches as rows; a blank cell is no row."""
    tools = sorted(c.removesuffix("_mismatches") for c in df.columns if c.endswith("_mismatches"))
    long = df.unpivot(["solution", "total_lines"], [f"{t}_mismatches" for t in tools], "tool", "mismatches")
    return long.where("mismatches is not null").withColumn("tool", F.regexp_replace("tool", "_mismatches$", ""))


def human_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(name, operation, before_path, after_path) of JSON files in directories of their pair's name; paths joined by slashes."""
    docs = spark.read.json(path, schema=HUMAN_SCHEMA, multiLine=True).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -2))
    e = docs.select("name", F.explode("entries").alias("e"))
    return e.select("name", "e.operation", F.array_join("e.before_path", "/").alias("before_path"), F.array_join("e.after_path", "/").alias("after_path"))


def in_range(contents: Column, low: int = 1, high: int = 1 << 20) -> Column:
    """The length of binary contents that are UTF-8 and between two sizes; null otherwise."""
    return F.when(F.is_valid_utf8(contents) & F.octet_length(contents).between(low, high), F.octet_length(contents))


# ---- other tools' results, as rows they touch (from 0)


def hunks_touched(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, side, row) from {"chunks": [[{"lhs": {"line_number"}, "rhs": {"line_number"}}]]}."""
    kind = "struct<chunks:array<array<struct<lhs:struct<line_number:int>,rhs:struct<line_number:int>>>>>"
    e = df.select(key, F.explode(F.flatten(F.from_json(document, kind)["chunks"])).alias("e"))
    return _sides(e, key, F.col("e.lhs.line_number"), F.col("e.rhs.line_number"))


def edits_touched(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, side, row) from {"hunks": [{"Old": [{"line_index"}]}, {"New": [...]}]}."""
    kind = "struct<hunks:array<struct<Old:array<struct<line_index:int>>,New:array<struct<line_index:int>>>>>"
    h = df.select(key, F.explode(F.from_json(document, kind)["hunks"]).alias("h"))
    one = lambda field, side: h.select(key, F.lit(side).alias("side"), F.explode(f"h.{field}.line_index").alias("row"))
    return one("Old", "before").unionByName(one("New", "after")).distinct()


def actions_touched(df: DataFrame, key: str, document: str, before: str, after: str) -> DataFrame:
    """(key, side, row) from {"actions": [{"action", "tree": "kind: text [start,end]"}]}: character ranges of insertions (after) and others (before)."""
    kind = "struct<actions:array<struct<action:string,tree:string>>>"
    a = df.select(key, F.col(before).alias("_b"), F.col(after).alias("_a"), F.explode(F.from_json(document, kind)["actions"]).alias("_x"))
    ends = lambda group: F.element_at(F.regexp_extract_all("_x.tree", F.lit(r"\[(\d+),(\d+)\]"), F.lit(group)), -1).cast("int")
    is_insert = F.col("_x.action").startswith("insert")
    row = lambda at: F.length(F.substring(F.col("t"), F.lit(1), at)) - F.length(F.translate(F.substring(F.col("t"), F.lit(1), at), "\n", ""))
    placed = a.select(
        key, F.when(is_insert, "after").otherwise("before").alias("side"), F.when(is_insert, F.col("_a")).otherwise(F.col("_b")).alias("t"), ends(1).alias("s"), ends(2).alias("e"),
    )
    rows = F.sequence(row(F.col("s")), F.greatest(row(F.col("s")), row(F.greatest(F.col("e") - 1, F.col("s")))))
    return placed.select(key, "side", F.explode(rows).alias("row")).distinct()


def _sides(df: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    b = df.select(key, F.lit("before").alias("side"), before.alias("row"))
    a = df.select(key, F.lit("after").alias("side"), after.alias("row"))
    return b.unionByName(a).where("row is not null").distinct()
