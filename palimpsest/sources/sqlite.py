"""Tables of SQLite files as a data source: spark.read.format("sqlite_table").

A partition is a range of row numbers, so that a table is read by as many tasks as asked for, each through its own index lookup. Comparisons with constants, lists and tests for null are evaluated by
the database (where spark.sql.python.filterPushdown.enabled is set), and only the columns of the given schema are fetched: read() works it out from the columns that are wanted. Every executor must reach the file.
"""

from __future__ import annotations

import contextlib
import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def opened(path: str) -> contextlib.closing:
    return contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind(declared: str) -> T.DataType:
    """The type of a column by the affinity of its declaration."""
    d = declared.upper()
    if "INT" in d or "BOOL" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return T.StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d or not d else T.StringType()


def columns(path: str, table: str) -> T.StructType:
    with opened(path) as db:
        rows = db.execute(f"pragma table_info({quoted(table)})").fetchall()
    if not rows:
        raise ValueError(f"{path} has no table {table}")
    return T.StructType([T.StructField(r[1], kind(r[2] or "")) for r in rows])


class Rows(InputPartition):
    """Rows whose numbers lie in [first, after)."""

    def __init__(self, first: int, after: int) -> None:
        self.first, self.after = first, after


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, table: str, parts: int) -> None:
        self.schema, self.path, self.table, self.parts = schema, path, table, parts
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if not self._pushed(f):
                yield f

    def _pushed(self, f: Filter) -> bool:
        """Take a filter on a column of the table whose meaning is the same there."""
        names = {c.name: c.dataType for c in self.schema}
        attribute = getattr(f, "attribute", ())
        if len(attribute) != 1 or attribute[0] not in names:
            return False
        c, of = quoted(attribute[0]), names[attribute[0]]
        plain = lambda v: isinstance(v, (int, str, bytes)) and not isinstance(v, bool)
        if isinstance(f, (IsNull, IsNotNull)):
            self.where.append(f"{c} is {'not ' * isinstance(f, IsNotNull)}null")
        elif type(f) in COMPARED and plain(f.value) and isinstance(of, (T.LongType, T.StringType)):
            self.where.append(f"{c} {COMPARED[type(f)]} ?")
            self.values.append(f.value)
        elif isinstance(f, In) and all(map(plain, f.value)) and f.value and isinstance(of, (T.LongType, T.StringType)):
            self.where.append(f"{c} in ({', '.join('?' * len(f.value))})")
            self.values += f.value
        elif isinstance(f, StringStartsWith):
            self.where.append(f"substr({c}, 1, ?) = ?")
            self.values += [len(f.value), f.value]
        else:
            return False
        return True

    def partitions(self) -> list[Rows]:
        with opened(self.path) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.parts))
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: Rows) -> Iterator[tuple]:
        names = ", ".join(quoted(c.name) for c in self.schema) or "null"
        clauses = ["rowid >= ?", "rowid < ?", *self.where]
        make = [(lambda v: v if v is None or isinstance(v, str) else str(v)) if isinstance(c.dataType, T.StringType) else (lambda v: None if v is None else float(v)) if isinstance(c.dataType, T.DoubleType) else (lambda v: v) for c in self.schema]
        with opened(self.path) as db:
            for row in db.execute(f"select {names} from {quoted(self.table)} where {' and '.join(clauses)}", [part.first, part.after, *self.values]):
                yield tuple(f(v) for f, v in zip(make, row))


class SqliteTable(DataSource):
    """Options: path, table, partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        return columns(self.options["path"], self.options["table"])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self.options["path"], self.options["table"], int(self.options.get("partitions", 8)))


def read(spark: SparkSession, path: str, table: str, wanted: list[str] | None = None, partitions: int = 8) -> DataFrame:
    """A table, or its wanted columns only; filters on them go to the database."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    every = columns(path, table)
    schema = every if wanted is None else T.StructType([every[c] for c in wanted])
    return spark.read.format("sqlite_table").schema(schema).option("table", table).option("partitions", partitions).option("path", path).load()


def written(rows: DataFrame, path: str, table: str, keys: list[str]) -> int:
    """Put rows in the place of those of equal keys in a table of a SQLite file, made if it is not there; the number of rows written.

    For exports that fit one machine: the rows come to the driver partition by partition, and all of them are one transaction, so that a break changes nothing.
    """
    of = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    names = rows.columns
    n = 0
    with contextlib.closing(sqlite3.connect(path)) as db, db:
        made = ", ".join(f"{quoted(c)} {of.get(t, 'TEXT')}" for c, t in rows.dtypes)
        db.execute(f"create table if not exists {quoted(table)} ({made}, primary key ({', '.join(map(quoted, keys))}))")
        for r in rows.toLocalIterator():
            db.execute(f"insert or replace into {quoted(table)} ({', '.join(map(quoted, names))}) values ({', '.join('?' * len(names))})", [v if v is None or isinstance(v, (int, float, str, bytes)) else bytes(v) if isinstance(v, bytearray) else str(v) for v in r])
            n += 1
    return n
