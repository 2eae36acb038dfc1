"""Large tables that change a little at a time: bucketed by key, partitioned, and written anew only where a change falls.

A table is a folder of versions. A version holds the partitions that its change touched, each whole, as files bucketed and sorted by
key; a partition is read from the last version that has it. Joins of the table with a change by key therefore shuffle the change
alone, and partitions that no change touches are neither read nor written. A version counts once its record is there, which is
written last: a writer that dies leaves a folder that nothing reads and the next one replaces. One writer at a time.

    table = KeyedTable(spark, "/shared/files", "full_path", schema.FILES, by=S.dirname)
    table.upsert(scan, maintenance.RENEWED_FILES)
    table.read().filter(...)
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenark.functions import scalar as S
from lumenark.operators import maintenance

RECORD = "_changed.json"
PART = "_part"


@dataclass(frozen=True)
class Version:
    number: int
    parts: frozenset[int]
    made: float
    note: str


class KeyedTable:
    """key: a column without nulls, unique in the table. by: what of the key decides the partition, such as its folder, so that a change of
    one place touches few; the key itself if not given. parts and buckets are fixed when a table is made."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType, by: Callable[[str], Column] | None = None, parts: int = 64, buckets: int = 32):
        self.spark, self.folder, self.key, self.schema, self.by, self.parts, self.buckets = spark, folder.rstrip("/"), key, schema, by, parts, buckets
        self._entries: list[str] = []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions -------------------------------------------------------------------------------------

    def versions(self) -> list[Version]:
        """Those that count, in order."""
        top = self._path(self.folder)
        if not self._fs.exists(top):
            return []
        found = []
        for status in self._fs.listStatus(top):
            name, record = status.getPath().getName(), self._path(status.getPath(), RECORD)
            if name.startswith("v") and self._fs.exists(record):
                stream = self._fs.open(record)
                told = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
                found.append(Version(int(name[1:]), frozenset(told["parts"]), told["made"], told["note"]))
        return sorted(found, key=lambda v: v.number)

    def _place(self, number: int) -> str:
        return f"{self.folder}/v{number:08d}"

    def _locations(self, upto: int | None = None) -> dict[int, str]:
        """Of each partition that has rows, its folder."""
        last = {part: v.number for v in self.versions() if upto is None or v.number <= upto for part in v.parts}
        places = {part: f"{self._place(number)}/{PART}={part}" for part, number in last.items()}
        return {part: place for part, place in places.items() if self._fs.exists(self._path(place))}  # a partition may have lost all rows

    # --- reading --------------------------------------------------------------------------------------

    def part_of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(self.by(key) if self.by else F.col(key)), F.lit(self.parts)).cast("int")

    def read(self, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The table as of a version, or of its partitions named; Spark knows its buckets."""
        name = f"keyed_{uuid.uuid4().hex}"
        fields = T.StructType([*(T.StructField(f.name, f.dataType) for f in self.schema), T.StructField(PART, T.IntegerType())])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({PART}) CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/_none'")
        places = {p: place for p, place in self._locations(version).items() if parts is None or p in parts}
        if places:
            self.spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION ({PART} = {p}) LOCATION '{place}'" for p, place in sorted(places.items())))
        rows = self.spark.table(name)
        self._entries.append(name)
        return rows.select(*self.schema.names)

    def release(self) -> None:
        """Drop the session catalogue's entries that read() made; what it returned cannot be used any more. Files stay."""
        while self._entries:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._entries.pop()}")

    # --- changing -------------------------------------------------------------------------------------

    def _change(self, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], note: str) -> int:
        """A version with what merge makes of the partitions that delta's keys fall into."""
        named = delta.filter(F.col(self.key).isNotNull())
        touched = sorted(r[0] for r in named.select(self.part_of(self.key).alias("p")).distinct().collect())  # at most `parts` numbers
        known = self.versions()
        number = known[-1].number + 1 if known else 0
        place = self._place(number)
        merged = merge(self.read(parts=touched), named) if touched else self.read(parts=[])
        name = f"keyed_{uuid.uuid4().hex}"
        rows = merged.select(*(F.col(f.name).cast(f.dataType) for f in self.schema), self.part_of(self.key).alias(PART))
        self._fs.delete(self._path(place), True)  # what a writer that died may have left
        rows.write.format("parquet").partitionBy(PART).bucketBy(self.buckets, self.key).sortBy(self.key).option("path", place).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the entry in the catalogue; the files stay
        self._record(place, touched, note)
        return number

    def _record(self, place: str, touched: list[int], note: str) -> None:
        """From here on the version counts."""
        stream = self._fs.create(self._path(place, f"{RECORD}.tmp"), True)
        stream.write(bytearray(json.dumps({"parts": touched, "made": time.time(), "note": note}).encode()))
        stream.close()
        if not self._fs.rename(self._path(place, f"{RECORD}.tmp"), self._path(place, RECORD)):
            raise OSError(f"could not record {place}")

    def upsert(self, new: DataFrame, renewed: tuple[str, ...] | None = None, note: str = "") -> int:
        """Rows of new take the place of those with their key; with `renewed`, in these columns only. Of a key that new holds twice
        the largest row counts."""
        once = maintenance.newest(new, self.key)
        if renewed is None:
            return self._change(once, lambda old, delta: maintenance.upsert(old, delta, self.key), note)
        return self._change(once, lambda old, delta: maintenance.partial_upsert(old, delta, self.key, renewed), note)

    def delete(self, keys: DataFrame, note: str = "") -> int:
        """Without the rows of these keys."""
        return self._change(keys.select(self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"), note)

    def mark(self, keys: DataFrame, column: str, value: Column, note: str = "") -> int:
        """`column` set to a value (an expression over the row) in the rows of these keys: soft deletion, restoring."""
        flag = keys.select(self.key).distinct().withColumn("_hit", F.lit(True))
        return self._change(flag, lambda old, hit: old.join(hit, self.key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit"), note)

    def vacuum(self, keep_seconds: float = 7 * 86_400) -> int:
        """Remove partitions that newer versions had replaced that long ago, and what dead writers left; the number of folders removed."""
        known, removed, before = self.versions(), 0, time.time() - keep_seconds
        for k, v in enumerate(known):
            replaced = frozenset().union(*(w.parts for w in known[k + 1 :] if w.made <= before))
            for part in v.parts & replaced:
                removed += self._fs.delete(self._path(f"{self._place(v.number)}/{PART}={part}"), True)
        numbers = {v.number for v in known}
        for status in self._fs.listStatus(self._path(self.folder)) if self._fs.exists(self._path(self.folder)) else []:
            name = status.getPath().getName()
            if name.startswith("v") and int(name[1:]) not in numbers and status.getModificationTime() / 1000 <= before:
                removed += self._fs.delete(status.getPath(), True)
        return removed


def files_table(spark: SparkSession, folder: str, **options: int) -> KeyedTable:
    """The inventory's files, partitioned by the folder that a file lies in."""
    from lumenark.sources import schema

    return KeyedTable(spark, folder, "full_path", schema.FILES, by=S.dirname, **options)
