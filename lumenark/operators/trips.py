"""Grouping files into trips, by camera and by drive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.functions import scalar as S
from lumenark.operators.dedupe import best_rows, missing_hash_key


def labelled(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """files (enriched) and each one's trip and category.

    A user's override of a drive's folder goes first, each part by itself; else card dumps and unsorted
    folders go by the nearest place and the year, all others by their folder's rule.
    """
    ruled = files.withColumns({"_label": S.trip_label("top_folder"), "category": S.trip_category("top_folder")})
    loose = F.col("category").isin("camera-dumps", "unsorted")
    placed = ruled.withColumn("_place", F.when(loose, S.nearest_place("gps_latitude", "gps_longitude")))
    named = placed.withColumn("trip", S.refined_trip(F.col("_label"), F.col("category"), F.col("_place"), F.col("month"))).drop("_label", "_place")
    if overrides is None:
        return named
    # One row per key; a user's overrides are few, and Spark broadcasts them if their size says so.
    own = overrides.select(F.col("key").alias("_key"), F.nullif("trip", F.lit("")).alias("_trip"), F.nullif("category", F.lit("")).alias("_category"))
    joined = named.join(own, F.concat_ws("::", "device_name", F.coalesce("top_folder", F.lit(""))) == F.col("_key"), "left")
    return joined.withColumns({"trip": F.coalesce("_trip", "trip"), "category": F.coalesce("_category", "category")}).drop("_key", "_trip", "_category")


def dominant(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value): each group's most frequent value, of equals the one whose first row comes first."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(group).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_first"))).alias(value))


def trips(files: DataFrame) -> DataFrame:
    """Per trip of labelled files: category of its first file, files, bytes, distinct hashes and their bytes, drives, month, place, folder.

    Bytes of files without a hash count in `bytes` only. A hash counts with its first file.
    """
    # Two levels, so that neither a hot hash nor the files without one meet in a single task.
    hashed = F.col("sha256") != ""
    copies = files.groupBy("trip", missing_hash_key(files).alias("_key")).agg(
        F.min("id").alias("_id"), F.min_by("category", "id").alias("category"), F.count("*").alias("n"), F.sum("file_size").alias("b"), F.min_by("file_size", "id").alias("one"), F.bool_or(hashed).alias("_hashed"), F.collect_set("device_name").alias("on"),
    )
    rolled = copies.groupBy("trip").agg(
        F.min_by("category", "_id").alias("category"), F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.count_if("_hashed").alias("unique_files"),
        F.coalesce(F.sum(F.when(F.col("_hashed"), F.col("one"))), F.lit(0)).alias("unique_bytes"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sort_array("on"))))), ",").alias("devices"),
    )
    months = dominant(files.filter("month <> ''"), "trip", "month", "id")
    dated = rolled.join(months, "trip", "left").withColumn("year_month", F.coalesce("month", S.month_hint(F.col("trip"))))
    dated = dated.withColumns({"year": F.when(F.col("year_month") != "", F.substring("year_month", 1, 4)).otherwise("Undated"), "place": S.slug("trip")})
    return dated.select("trip", "category", "year", "year_month", "place", F.concat_ws("/", "place", "year", F.nullif("year_month", F.lit(""))).alias("nas_folder"), "files", "bytes", "unique_files", "unique_bytes", "devices")


def sources(files: DataFrame) -> DataFrame:
    """Per camera: files, bytes, originals and edited ones, each hash once (its first file)."""
    return best_rows(files, [missing_hash_key(files)], [F.col("id")]).groupBy("device").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.count_if(F.col("stage") == "original").alias("originals"), F.count_if(F.col("stage") == "edited").alias("edited"))


def drive_inventory(files: DataFrame) -> DataFrame:
    """Per drive: root of its first file, its top folders, files, bytes."""
    folders = F.sort_array(F.collect_set(F.when(F.col("top_folder") != "", F.col("top_folder"))))
    return files.groupBy("device_name").agg(F.min_by(F.coalesce("root_path", F.lit("")), "id").alias("root_path"), folders.alias("top"), F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
