"""Exports. Quoted fields keep to one convention: inner double quotes become single ones."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenark.functions import rules
from lumenark.functions import scalar as S
from lumenark.operators import staging
from lumenark.sources.durable import checkpointed


def quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.replace(S.text(F.col(c).cast("string")), F.lit('"'), F.lit("'")), F.lit('"'))


def plain(c: str) -> Column:
    return S.text(F.col(c).cast("string"))


def plan_lines(planned: DataFrame) -> DataFrame:
    """The dedupe plan as CSV lines, without a header."""
    fields = (plain("decision"), plain("sha256"), quoted("file_name"), plain("device_name"), plain("file_size"), quoted("full_path"), quoted("keep_path"))
    return planned.select(F.concat_ws(",", *fields).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_plan(planned: DataFrame, path: str) -> None:
    """The dedupe plan as text files of CSV lines."""
    plan_lines(planned).write.mode("overwrite").text(path)


def newest_moves(ledger: DataFrame, limit: int = 100_000) -> DataFrame:
    return ledger.orderBy(F.desc("id")).limit(limit)


def write_moves(ledger: DataFrame, path: str, limit: int = 100_000) -> None:
    """The newest ledger rows."""
    write_csv(newest_moves(ledger, limit), path)


def cluster_rows(ranked: DataFrame) -> DataFrame:
    """Near-duplicate members with their cluster's number from 1 (the largest first) and what to do: KEEP or REVIEW.

    Clusters are dealt into ranges of their order and numbered range by range, each after those before it; no task sees all of them.
    """
    order = (F.desc("members"), F.col("component"))
    ranges = checkpointed(ranked.select("component", "members").distinct().repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = ranges.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranges.withColumn("_k", inside).join(F.broadcast(before), "_range").withColumn("cluster", (F.col("_before") + F.col("_k")).cast("int"))
    return ranked.join(numbered.select("component", "cluster"), "component").withColumn("action", F.when(F.col("place") == 1, "KEEP").otherwise("REVIEW"))


def manifest_lines(rows: DataFrame) -> DataFrame:
    """Manifest rows as CSV lines with every field quoted, without the header."""
    return rows.select(F.concat_ws(",", *map(quoted, rules.MANIFEST_COLUMNS)).alias("line"))


def manifest_document(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """(part, line): the lines, in the order of part and line, of one JSON document {"summary": {...}, "files": [...]}."""
    head = summary.select(F.lit(0).alias("part"), F.concat(F.lit('{"summary": '), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.lit(', "files": [')).alias("line"))
    first = rows.agg(F.min(F.struct("destination_path", "sha256_inventory")).alias("first"))
    marked = rows.join(F.broadcast(first))  # one row
    own = F.to_json(F.struct(*rules.MANIFEST_COLUMNS), {"ignoreNullFields": "false"})
    is_first = F.struct("destination_path", "sha256_inventory") == F.col("first")
    body = marked.select(F.when(is_first, 1).otherwise(2).alias("part"), F.when(is_first, own).otherwise(F.concat(F.lit(","), own)).alias("line"))
    return head.unionByName(body).unionByName(summary.select(F.lit(3).alias("part"), F.lit("]}").alias("line")))


def _with_header(rows: DataFrame) -> DataFrame:
    header = rows.sparkSession.range(1).select(F.lit(",".join(rules.MANIFEST_COLUMNS)).alias("line"))
    return header.unionByName(manifest_lines(rows))


def write_manifest(items: DataFrame, job: dict, target: str) -> str:
    """A job's manifest (CSV, and JSON with its summary), errors and summary below target, which is returned.

    job: trip, dest_root, and what else staging.job_summary takes. Each is one file by contract, so one task writes it, row by row.
    """
    items = checkpointed(items)  # what follows reads them seven times, most of it in one task
    rows = staging.manifest(items, job["dest_root"], job.get("trip")).select(*rules.MANIFEST_COLUMNS)
    summary = staging.job_summary(items, job)
    _with_header(rows).coalesce(1).write.mode("overwrite").text(f"{target}/manifest.csv")
    manifest_document(rows, summary).repartition(1).sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(f"{target}/manifest.json")
    _with_header(rows.filter("copy_status = 'error'")).coalesce(1).write.mode("overwrite").text(f"{target}/errors.csv")
    summary.coalesce(1).write.mode("overwrite").json(f"{target}/summary.json")
    return target


def archive_manifest(items: DataFrame, job: dict, folder: str, now: datetime.datetime) -> str:
    """write_manifest into a folder of the job's own below folder, named after the trip and the time it began."""
    slug = "".join(c if c.isascii() and c.isalnum() else "-" for c in job.get("trip") or "job").strip("-") or "Untitled"
    return write_manifest(items, job, f"{folder}/{slug}_{now.strftime('%Y%m%d-%H%M%S')}")


def kept(spark: SparkSession, folder: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A relation materialised under the version of its input: read if it is there and complete, built and written if not."""
    path = f"{folder}/{version}"
    if not complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """A table's next version in a folder of its own; readers go on with the last until this one is complete. What a
    writer that died has left there is replaced; a complete version is an error."""
    path = f"{folder}/v{version:08d}"
    df.write.mode("errorifexists" if complete(df.sparkSession, path) else "overwrite").parquet(path)
    return path


def put_files(rows: DataFrame, folder: str) -> int:
    """A file below folder for each row (path, content) and the number of files; tasks write them, each under another name until it is whole."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs as arrow_fs

        fs, top = arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                place, _, name = f"{top}/{path.lstrip('/')}".rpartition("/")
                fs.create_dir(place, recursive=True)
                part = f"{place}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content)
                fs.move(part, f"{place}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
