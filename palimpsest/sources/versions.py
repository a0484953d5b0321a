"""Sets of tables that change together: each batch is a version, and one manifest switches all tables to it.

Layout below a folder: a folder for each table with a part for each version that wrote it, and `_manifests`, with one small JSON file for each version. A batch first writes
its rows of all tables into parts of their own and then, by one rename, the manifest that names them. A reader takes the newest whole manifest, so it sees all tables before a batch or
all after it, and keeps what it began with while the next is written. A batch that is broken off leaves parts that no manifest names; played again it writes new ones, and a batch that
a manifest has already is left out. So a stream with such a sink changes each row exactly once.

Rows belong to an owner (a path): a later version's rows of an owner take the place of all its earlier rows, in every table. Batches are written as they come, and reading finds the newest version of
each owner; every MERGED parts they are merged into one. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table that are read together before they are merged, and manifests whose parts stay when older ones go.
MERGED, KEPT = 16, 2


class Tables:
    """The tables at a folder: the first named has one row for each owner and tells which version of the others' rows holds."""

    def __init__(self, spark: SparkSession, folder: str, names: list[str], owner: str) -> None:
        self.spark, self.folder, self.names, self.owner = spark, folder.rstrip("/"), names, owner
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # ---- manifests

    def _versions(self) -> list[int]:
        at = self._at(f"{self.folder}/_manifests")
        found = (s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else ()
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"{self.folder}/_manifests/{version:012}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest version: its number, the parts of each table with their sizes in bytes, and the last batch of each stream."""
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {"version": -1, "tables": {n: [] for n in self.names}, "streams": {}}

    def _publish(self, manifest: dict) -> None:
        name = f"{self.folder}/_manifests/{manifest['version']:012}.json"
        hidden = self._at(f"{self.folder}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(hidden, self._at(name)):
            raise OSError(f"{name} is there already: another writer is at work")

    # ---- writing

    def _write(self, name: str, rows: DataFrame, version: int) -> dict:
        part = f"{name}/{version:012}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return {"part": part, "bytes": self._fs.getContentSummary(self._at(f"{self.folder}/{part}")).getLength()}

    def commit(self, stream: str, batch: int, rows: dict[str, DataFrame]) -> bool:
        """Put a batch's rows in the place of all rows of their owners; False, and nothing done, if the stream's batch is in already."""
        now = self.manifest()
        if now["streams"].get(stream, -1) >= batch:
            return False
        version = now["version"] + 1
        parts = {n: [*now["tables"][n], self._write(n, rows[n].withColumn("_version", F.lit(version)), version)] for n in self.names}
        self._publish({"version": version, "tables": parts, "streams": {**now["streams"], stream: batch}})
        if max(map(len, parts.values())) > MERGED:
            self.merge()
        return True

    def merge(self) -> None:
        """Write the rows that hold as one part of each table, as a version of its own, and remove parts that only older versions name."""
        now = self.manifest()
        version = now["version"] + 1
        parts = {n: [self._write(n, rows, version)] if (rows := self._holding(n, now)) is not None else [] for n in self.names}
        self._publish({**now, "version": version, "tables": parts})
        self.vacuum()

    def vacuum(self) -> None:
        """Remove manifests before the last KEPT, and parts that no manifest names."""
        versions = self._versions()
        for v in versions[:-KEPT]:
            self._fs.delete(self._at(f"{self.folder}/_manifests/{v:012}.json"), False)
        named = {p["part"] for v in versions[-KEPT:] for parts in self._manifest(v)["tables"].values() for p in parts}
        for n in self.names:
            at = self._at(f"{self.folder}/{n}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else ():
                if f"{n}/{s.getPath().getName()}" not in named:
                    self._fs.delete(s.getPath(), True)

    # ---- reading

    def _parts(self, name: str, manifest: dict) -> DataFrame | None:
        found = [self.spark.read.parquet(f"{self.folder}/{p['part']}") for p in manifest["tables"][name]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None

    def _holding(self, name: str, manifest: dict) -> DataFrame | None:
        rows, owners = self._parts(name, manifest), self._parts(self.names[0], manifest)
        if rows is None:
            return None
        newest = owners.groupBy(F.col(self.owner).alias("_owner")).agg(F.max("_version").alias("_newest"))
        return rows.join(newest, (rows[self.owner] == F.col("_owner")) & (rows["_version"] == F.col("_newest")), "left_semi")

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table's rows as of the newest version, or of an earlier one that is still there; None before the first batch."""
        rows = self._holding(name, self.manifest() if version is None else self._manifest(version))
        return None if rows is None else rows.drop("_version")

    def size(self) -> int:
        """Bytes of the parts that the newest version names."""
        return sum(p["bytes"] for parts in self.manifest()["tables"].values() for p in parts)
