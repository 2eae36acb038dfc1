"""Tables of an SQLite file as a Spark data source, read by ranges of row ids.

    sqlite_table.read(spark, "/shared/inventory.sqlite3", "files")

The file must lie where all executors see it; each task opens it for reading only. SQLite's types hold for no cell in particular: what does not
fit its column's type is null. Options: path, table, slices (ranges of row ids, 16).
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

NAME = "sqlite_table"


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True)


def _kind(declared: str):
    """SQLite's own rules for what a declared type means."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if re.search("CHAR|CLOB|TEXT", d):
        return StringType()
    if "BLOB" in d:
        return BinaryType()
    return DoubleType() if re.search("REAL|FLOA|DOUB", d) else StringType()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(D.InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Reader(D.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.slices, self.schema = options["path"], options["table"], int(options.get("slices", 16)), schema

    def partitions(self) -> list[Range]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.slices))
        return [Range(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        casts = {"bigint": int, "string": str, "double": float, "binary": bytes}
        kinds = [casts[f.dataType.simpleString()] for f in self.schema]

        def cell(value, kind):
            if value is None or isinstance(value, kind):
                return value
            if kind is float and isinstance(value, int):
                return float(value)
            return str(value) if kind is str and not isinstance(value, bytes) else None

        db = _open(self.path)
        db.text_factory = lambda b: b.decode("utf-8", "replace")
        try:
            names = ", ".join(_quoted(f.name) for f in self.schema)
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(cell(v, k) for v, k in zip(row, kinds))
        finally:
            db.close()


class SqliteSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']}")
        return StructType([StructField(c[1], _kind(c[2] or "")) for c in columns])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)


def read(spark: SparkSession, path: str, table: str, slices: int = 16) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format(NAME).options(table=table, slices=slices).load(path)


def tables(spark: SparkSession, places: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """DataFrames by the names of library.TABLES from {name: (file, table)}, for Library(spark, ...)."""
    return {name: read(spark, path, table) for name, (path, table) in places.items()}
