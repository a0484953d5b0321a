"""Changes of files in version-control histories, as a data source: spark.read.format("git_deltas").

A partition is a repository; its commits are read one after another with the git program, and a row is one
file of one commit. An unreadable repository or blob is a row with its error, and the others go on.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions import languages as L
from palimpsest.functions.stats import size_bucket

SCHEMA = "repository string, commit string, committed timestamp, status string, path string, old_path string, before string, after string, bytes_before long, bytes_after long, error string"
STATUS = {"A": "Added", "D": "Deleted", "M": "Modified", "R": "Renamed", "C": "Copied", "T": "Other"}
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def repositories(root: str) -> list[str]:
    """The root itself if it is a repository, else its direct children that are, sorted."""
    base = Path(root)
    if (base / ".git").exists():
        return [str(base)]
    return sorted(str(p) for p in base.iterdir() if (p / ".git").exists()) if base.is_dir() else []


def find_repository(roots: list[str], name: str) -> str | None:
    """The first of several roots' repository of a name."""
    return next((str(Path(r) / name) for r in roots if (Path(r) / name).exists()), None)


def git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, check=False)
    if done.returncode:
        raise OSError(done.stderr.decode(errors="replace").strip()[:500])
    return done.stdout


def blob(repo: str, ref: str, path: str | None) -> bytes | None:
    """Contents of a path at a commit; None if there are none."""
    try:
        return git(repo, "show", f"{ref}:{path}") if path else None
    except OSError:
        return None


class Repository(InputPartition):
    def __init__(self, path: str):
        self.path = path


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = options["path"].split(",")
        self.most = int(options.get("maxcommits", 1000))
        self.renames = options.get("detectrenames", "false").lower() == "true"
        self.every = options.get("everycommit", "false").lower() == "true"

    def partitions(self) -> list[Repository]:
        return [Repository(p) for r in self.roots for p in repositories(r)] or [Repository("")]

    def read(self, part: Repository) -> Iterator[tuple]:
        import datetime

        if not part.path:
            return
        name = Path(part.path).name
        try:
            log = git(part.path, "log", f"--max-count={self.most}", "--format=%H %ct %P", "HEAD").decode().splitlines()
        except OSError as e:
            yield (name, *[None] * 9, str(e))
            return
        for line in log:
            commit, stamp, *parents = line.split()
            when = datetime.datetime.fromtimestamp(int(stamp), datetime.UTC)
            # merges and first commits count towards the limit; they are compared only where every commit is asked for
            if len(parents) != 1 and not self.every:
                continue
            base = parents[0] if parents else EMPTY_TREE
            try:
                fields = git(part.path, "diff-tree", "-r", "-z", "--no-commit-id", "--name-status", *(["-M"] if self.renames else ["--no-renames"]), base, commit).decode(errors="replace").split("\0")
            except OSError as e:
                yield (name, commit, when, *[None] * 7, str(e))
                continue
            i = 0
            while i < len(fields) - 1:
                status = STATUS.get(fields[i][:1], "Other")
                two = fields[i][:1] in "RC"
                old, new = (fields[i + 1], fields[i + 2]) if two else (fields[i + 1],) * 2
                i += 3 if two else 2
                b = blob(part.path, base, old) if status != "Added" else None
                a = blob(part.path, commit, new) if status != "Deleted" else None
                error = None
                text = []
                for raw in (b, a):
                    try:
                        text.append(None if raw is None else raw.decode())
                    except UnicodeDecodeError:
                        text.append(None)
                        error = "not UTF-8"
                yield (name, commit, when, status, None if status == "Deleted" else new, None if status == "Added" else old, *text, None if b is None else len(b), None if a is None else len(a), error)


class GitDeltas(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_deltas"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitReader:
        return GitReader({k.lower(): v for k, v in self.options.items()})


def deltas(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Rows of all repositories at or below a root; options maxCommits, detectRenames, everyCommit."""
    spark.dataSource.register(GitDeltas)
    return spark.read.format("git_deltas").options(**options).load(root)


def commit_statistics(changes: DataFrame) -> DataFrame:
    """One row for each file of each commit: path (the old one first), language, bytes and lines of both sides; the last row of a key wins."""
    path = F.coalesce("old_path", "path", F.lit(""))
    lines = lambda c: F.coalesce(F.length(c) - F.length(F.translate(c, "\n", "")) + F.when((F.length(c) > 0) & ~F.col(c).endswith("\n"), 1).otherwise(0), F.lit(0)).cast("long")
    rows = changes.where("error is null").select(
        F.col("commit").alias("commit_id"), path.alias("relative_file_path"), "repository", F.col("committed").alias("last_updated"), F.col("status").alias("git_reported_status"),
        L.language(path).alias("language"), F.coalesce("bytes_before", F.lit(0)).alias("bytes_before"), F.coalesce("bytes_after", F.lit(0)).alias("bytes_after"),
        lines("before").alias("lines_before"), lines("after").alias("lines_after"),
    )
    return rows.dropDuplicates(["commit_id", "relative_file_path"])


def candidates(changes: DataFrame, low: int = 1, high: int = 1 << 20) -> DataFrame:
    """Modified and renamed files whose contents changed, of a known language and a size in range, with their stratum."""
    ok = (
        F.col("status").isin("Modified", "Renamed") & F.col("error").isNull() & (F.col("before") != F.col("after"))
        & F.col("bytes_before").between(low, high) & F.col("bytes_after").between(low, high) & ~L.skipped(F.concat(F.lit("/"), F.col("path")))
    )
    rows = changes.where(ok).withColumn("language", L.language(F.col("path"))).withColumn("size_bucket", size_bucket(F.greatest("bytes_before", "bytes_after")))
    return rows.where("language <> 'Unknown'")
