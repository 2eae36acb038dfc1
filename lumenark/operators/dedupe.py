"""Redundant copies: what to keep, what it would save, and inventory totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S


def best_rows(files: DataFrame, keys: list[F.Column], order: list[F.Column]) -> DataFrame:
    """For each value of keys the row that comes first by order, with files' columns.

    An aggregation rather than a window: each task hands on one row a key, so a key that holds a
    third of all rows costs no task more than others.
    """
    rows = files.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*files.columns), F.struct(*order)).alias("_r"))
    return rows.select("_r.*")


def plan(files: DataFrame, preference: Mapping[str, int] = R.DRIVE_PREFERENCE) -> DataFrame:
    """One row for each file of a hash with several: KEEP for the preferred drive's, then shortest path, then smallest id.

    What to keep is aggregated per hash and joined back; Spark deals a hot hash's rows to several tasks.
    """
    rows = files.filter("sha256 <> ''").select("id", "sha256", "file_name", "full_path", "device_name", "file_size")
    order = F.struct(S.drive_rank("device_name", preference), F.length("full_path"), "id")
    kept = rows.groupBy("sha256").agg(F.count("*").alias("_copies"), F.min_by(F.struct("id", "full_path"), order).alias("_keep")).filter("_copies > 1")
    joined = rows.join(kept, "sha256")
    return joined.select(F.when(F.col("id") == F.col("_keep.id"), "KEEP").otherwise("DELETE").alias("decision"), "id", "sha256", "file_name", "full_path", "device_name", "file_size", F.col("_keep.full_path").alias("keep_path"))


def plan_summary(planned: DataFrame) -> DataFrame:
    """Per drive: files to delete and bytes they hold."""
    return planned.filter("decision = 'DELETE'").groupBy("device_name").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """How many hashes have several files, how many files that are, and what all but one copy of each hold."""
    groups = files.filter("sha256 <> ''").groupBy("sha256").agg(F.count("*").alias("n"), F.sum("file_size").alias("total"), F.min("file_size").alias("one")).filter("n > 1")
    return groups.agg(F.count("*").alias("dup_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("dup_files"), F.coalesce(F.sum(F.col("total") - F.col("one")), F.lit(0)).alias("reclaim_bytes"))


def unique_bytes(files: DataFrame) -> DataFrame:
    one = files.filter("sha256 <> ''").groupBy("sha256").agg(F.min("file_size").alias("one"))
    return one.agg(F.count("*").alias("unique_files"), F.coalesce(F.sum("one"), F.lit(0)).alias("unique_bytes"))


def drive_usage(files: DataFrame) -> DataFrame:
    """Per drive, the fullest first."""
    return files.groupBy("device_name").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes")).orderBy(F.desc("bytes"), "device_name")


def missing_hash_key(files: DataFrame) -> F.Column:
    """A file's hash, or a key of its own."""
    return F.coalesce(F.nullif(F.col("sha256"), F.lit("")), F.concat(F.lit("__nh"), F.col("id").cast("string")))


def canonical_sources(files: DataFrame, preference: Mapping[str, int] = R.DRIVE_PREFERENCE) -> DataFrame:
    """One file per hash (files without one are on their own): preferred drive, shortest path, smallest id."""
    return best_rows(files, [missing_hash_key(files)], [S.drive_rank("device_name", preference), F.length("full_path"), F.col("id")])
