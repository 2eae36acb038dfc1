"""Ingest as a stream: files that land in a folder are merged into the inventory batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenark.functions import scalar as S
from lumenark.operators import maintenance, sinks
from lumenark.operators.keyed import KeyedTable
from lumenark.sources import folder as media_folder
from lumenark.sources import schema


def scans(spark: SparkSession, landing: str) -> DataFrame:
    """Scan rows (of the files schema) landing as Parquet."""
    return spark.readStream.schema(schema.FILES).parquet(landing)


def folder_scans(spark: SparkSession, folder: str, device: str, **options: str | bool | int | float) -> DataFrame:
    """New and changed media below a folder as scan rows, with a scan for each second in which a batch is read (options: see sources/folder.py)."""
    media_folder.register(spark)
    found = spark.readStream.format(media_folder.NAME).options(**options).load(folder)
    now, scan = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.unix_seconds(F.current_timestamp())
    told = {"id": S.path_id("full_path"), "mime_type": S.mime("extension"), "root_path": F.lit(folder.rstrip("/")), "device_name": F.lit(device), "first_seen_scan_id": scan, "last_seen_scan_id": scan, "indexed_at": now}
    return schema.ensure_columns(found.withColumns(told), schema.FILES).select(*schema.FILES.names)


def merge_scans(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each batch upserts by path and writes the table's next version; of a path that a batch holds twice the row of the last scan,
    modified last, counts. A batch run again after a failure finds its version written, or replaces what there is of it."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, folder)
        if number in versions:
            return
        old = spark.read.parquet(f"{folder}/v{max(versions):08d}") if versions else spark.createDataFrame([], schema.FILES)
        once = maintenance.newest(batch.filter("full_path IS NOT NULL"), "full_path", "last_seen_scan_id", "modified_time")
        sinks.write_version(maintenance.partial_upsert(old, once, "full_path", maintenance.RENEWED_FILES), folder, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into(stream: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """As merge_scans(), into a table by path of which a batch rewrites only the partitions that it touches; for large inventories.
    A batch run again after a failure finds its own number in the table's versions."""

    def merge(batch: DataFrame, number: int) -> None:
        if any(v.note == f"batch {number}" for v in table.versions()):
            return
        once = maintenance.newest(batch.filter("full_path IS NOT NULL"), "full_path", "last_seen_scan_id", "modified_time")
        table.upsert(once, maintenance.RENEWED_FILES, note=f"batch {number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of complete versions."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(name[1:]) for name in names if name.startswith("v") and sinks.complete(spark, f"{folder}/{name}"))
