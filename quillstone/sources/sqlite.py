"""Tables of SQLite databases as a Spark source: a file, or a folder of files that each hold part of the table.

Files are opened read-only, and each is split into ranges of row ids, so a large one is read by many tasks. Filters that
SQLite can answer are put into its statement; Spark tests all of them again. Only the columns asked for are read. Writing
makes one file a task; a file appears under its name when it is whole, and a failed write leaves nothing.

Paths must be in a folder that the driver and all executors share, since the library opens files itself.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

#: Row ids of one task, and rows handed over at once.
ROWS, BATCH = 200_000, 8192
FORMAT = "quillstone_sqlite"

_COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def local_path(path: str) -> str:
    """A path as the operating system names it."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} isn't in a folder that a database can be opened in")
    return path


def opened(path: str) -> sqlite3.Connection:
    """A connection that can't write."""
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def files(path: str) -> list[str]:
    at = Path(local_path(path))
    if at.is_dir():
        return sorted(str(p) for p in at.iterdir() if p.suffix == ".db")
    if not at.exists():
        raise FileNotFoundError(path)
    return [str(at)]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind(declared: str) -> str:
    """The Spark type for a column's declared type. Dates and times are text in SQLite, and stay so."""
    d = declared.upper()
    if "DATE" in d or "TIME" in d or any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "INT" in d or "BOOL" in d:
        return "bigint"
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return "double"
    return "binary" if "BLOB" in d else "string"


def columns(path: str, table: str) -> list[tuple[str, str]]:
    with opened(path) as con:
        found = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not found:
        raise ValueError(f"there is no table {table} in {path}")
    return [(name, kind(declared or "")) for _, name, declared, *_ in found]


@dataclass
class Range(InputPartition):
    """Row ids from ``low`` to ``high`` of one file; without them the whole table."""

    path: str
    low: int | None
    high: int | None


def condition(f: Filter, kinds: dict[str, str]) -> tuple[str, list] | None:
    """SQL for a filter, or None. Text compares byte by byte whatever the column's collation."""
    name = ".".join(f.attribute) if hasattr(f, "attribute") else None
    if name not in kinds or kinds[name] == "binary":
        return None
    column = quoted(name) + (" COLLATE BINARY" if kinds[name] == "string" else "")
    plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool) and isinstance(v, str) == (kinds[name] == "string")
    if isinstance(f, IsNull):
        return f"{column} IS NULL", []
    if isinstance(f, IsNotNull):
        return f"{column} IS NOT NULL", []
    if type(f) in _COMPARED and plain(f.value):
        return f"{column} {_COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, In) and f.value and len(f.value) <= 500 and all(map(plain, f.value)):
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, StringStartsWith) and kinds[name] == "string":
        return f"substr({column}, 1, ?) = ?", [len(f.value), f.value]
    return None


def _value(v, to: str):
    """A stored value as the column's type; SQLite lets any value stand in any column, and one of another kind is null."""
    if v is None:
        return None
    if to == "bigint":
        return v if isinstance(v, int) else None
    if to == "double":
        return float(v) if isinstance(v, (int, float)) else None
    if to == "binary":
        return v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else None
    return v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table = options["path"], options["dbtable"]
        self.rows = int(options.get("rowsPerPartition", ROWS))
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if found := condition(f, self.kinds):
                self.where.append(found[0])
                self.values += found[1]
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in files(self.path):
            with opened(path) as con:
                try:
                    low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # a table without row ids
                    low = None
            if low is None:  # that, a view, or no rows
                out.append(Range(path, None, None))
            else:
                out += [Range(path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        tests, values = list(self.where), list(self.values)
        if partition.low is not None:
            tests.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        names = ", ".join(map(quoted, self.kinds)) or "1"
        sql = f"SELECT {names} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(tests)}" if tests else "")
        con = opened(partition.path)
        con.text_factory = lambda raw: raw.decode("utf-8", "replace")
        try:
            found = con.execute(sql, values)
            while rows := found.fetchmany(BATCH):
                made = [pa.array([_value(r[k], to) for r in rows], _ARROW[to]) for k, to in enumerate(self.kinds.values())]
                yield pa.RecordBatch.from_arrays(made, names=list(self.kinds))
        finally:
            con.close()


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class Writer(DataSourceArrowWriter):
    """One file a task, under a name of its own until all have ended well."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.folder, self.table, self.overwrite = local_path(options["path"]), options["dbtable"], overwrite
        declared = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}
        kinds = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if odd := [n for n, k in kinds if k not in declared]:
            raise ValueError(f"cast columns {odd} to numbers, text or bytes first")
        self.columns = [(n, declared[k]) for n, k in kinds]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        path, n = f"{self.folder}/{uuid4().hex}.part", 0
        con = sqlite3.connect(path)
        con.execute("PRAGMA journal_mode = OFF")
        con.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(c)} {d}' for c, d in self.columns)})")
        for batch in iterator:
            con.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.columns))})", zip(*(c.to_pylist() for c in batch.columns)))
            n += batch.num_rows
        con.commit()
        con.close()
        return Written(path, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        old = files(self.folder) if os.path.isdir(self.folder) else []
        if old and not self.overwrite:
            raise FileExistsError(self.folder)
        for path in old:
            os.remove(path)
        for m in messages:
            if m is not None:
                os.replace(m.path, m.path.removesuffix(".part") + ".db")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class SqliteSource(DataSource):
    """Options: path, dbtable, rowsPerPartition, and columns, the names to read with commas between."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        found = columns(files(self.options["path"])[0], self.options["dbtable"])
        if wanted := self.options.get("columns"):
            kinds = dict(found)
            found = [(c, kinds[c]) for c in wanted.split(",")]
        return ", ".join(f"`{n}` {k}" for n, k in found)

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, table: str, *names: str) -> DataFrame:
    """A table of a database file, or of a folder of them; all columns or the ones named."""
    register(spark)
    found = spark.read.format(FORMAT).option("path", path).option("dbtable", table)
    return (found.option("columns", ",".join(names)) if names else found).load()


def write(rows: DataFrame, path: str, table: str) -> None:
    """Rows as database files in a folder, one a task. Times are written as text."""
    register(rows.sparkSession)
    texts = [F.col(f"`{n}`").cast("string").alias(n) if k.startswith(("timestamp", "date")) else F.col(f"`{n}`") for n, k in rows.dtypes]
    rows.select(*texts).write.format(FORMAT).option("path", path).option("dbtable", table).mode("append").save()


class Catalog:
    """The tables of a catalog file, read-only, by name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def tables(self) -> list[str]:
        with opened(files(self.path)[0]) as con:
            return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]

    def table(self, name: str, *names: str) -> DataFrame:
        return read(self.spark, self.path, name, *names)

    def register(self) -> None:
        """Gives each table a view of its name, for SQL."""
        for name in self.tables():
            self.table(name).createOrReplaceTempView("`" + name.replace("`", "``") + "`")
