"""Scans: tables, folders, extracted metadata, result streams; and the enriched relation all views start from."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenark.functions import rules as R
from lumenark.functions import scalar as S
from lumenark.operators.dedupe import best_rows
from lumenark.sources import folder as media_folder
from lumenark.sources import schema

def locate(spark: SparkSession, candidates: list[str], variable: str = "LUMENARK_FILES") -> str:
    """The inventory's path: what the environment names, else the first candidate that exists on any file system Spark reads."""
    named = os.environ.get(variable)
    jvm = spark.sparkContext._jvm
    for place in [named] if named else candidates:
        path = jvm.org.apache.hadoop.fs.Path(place)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return place
    raise FileNotFoundError(f"no inventory at {named or ', '.join(candidates)}")


def live(files: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted; files may lack the column."""
    return schema.ensure_columns(files, schema.FILES).filter(F.col("deleted_at").isNull())


def enriched(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Live files with their metadata, camera, stage, orientation and top folder."""
    f = live(files).select("id", "full_path", "file_name", "extension", "file_size", "sha256", "device_name", "root_path", "created_time").withColumn("top_folder", S.top_folder())
    m = schema.ensure_columns(metadata, schema.METADATA).select("file_id", "capture_date", "creation_date", F.col("camera_make").alias("make"), F.col("camera_model").alias("model"), F.col("image_width").alias("width"), F.col("image_height").alias("height"), "gps_latitude", "gps_longitude", "raw_metadata_json")
    both = f.join(m, f["id"] == m["file_id"], "left").drop("file_id")
    flagged = both.withColumns({"has_altitude": S.metadata_flag("raw_metadata_json", (R.ALTITUDE_MARK,)), "edited_sw": S.metadata_flag("raw_metadata_json", R.EDITING_SOFTWARE), "rotated": S.metadata_flag("raw_metadata_json", R.ROTATED_MARKS)}).drop("raw_metadata_json")
    return flagged.withColumns(
        {
            "device": S.device("make", "model", "extension", "file_name", F.col("has_altitude")),
            "stage": S.stage("extension", "file_name", F.col("edited_sw"), "top_folder"),
            "orientation": S.orientation("width", "height", F.col("rotated")),
            "bucket": S.bucket("extension"),
            "month": S.year_month("capture_date", "creation_date"),
        }
    )


def walk(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Media files below a folder: full_path, file_name, extension, file_size, modified_time, and sha256 if content is read.

    Every name counts, those that start with a dot or an underscore, too (Spark's own file sources hide them). See sources/folder.py.
    """
    found = media_folder.read(spark, folder, content=content)
    return found if content else found.drop("sha256")


def shots(files: DataFrame) -> DataFrame:
    """One viewable file per shot (folder and stem): the best kind, then the smallest id."""
    ext = S.low("extension")
    ranked = files.filter(ext.isin(*R.SHOT_PRIORITY) & ~S.text("file_name").startswith("._")).withColumn("_p", S.first_match(((ext == e, p) for e, p in R.SHOT_PRIORITY.items()), 9))
    return best_rows(ranked, [S.dirname("full_path"), F.lower(S.stem("file_name"))], [F.col("_p"), F.col("id")]).drop("_p")


def folder_shots(spark: SparkSession, folder: str) -> DataFrame:
    """Shots of a folder that is not in the inventory; ids come from the paths."""
    return shots(walk(spark, folder).withColumn("id", S.path_id("full_path")))


def folder_photos(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """Photos of a folder but AppleDouble files, the first `limit` by path."""
    return walk(spark, folder).filter(F.col("extension").isin(*R.BUCKETS["photos"]) & ~F.col("file_name").startswith("._")).orderBy("full_path").limit(limit)


def extracted(lines: DataFrame, row: str, key: str = "path") -> DataFrame:
    """Rows of newline-delimited JSON (column value); what is malformed or lacks the key is dropped."""
    return lines.select(F.from_json("value", row, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").filter(F.col(key).isNotNull())


def extract_with(files: DataFrame, extractor, columns: str, batch: int = 80) -> DataFrame:
    """Metadata by a function from a list of paths to {path: {column: value}}, called on `batch` paths at a time."""
    names = T.StructType.fromDDL(columns).names

    def run(frames):
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), batch):
                paths = frame["full_path"].tolist()[at : at + batch]
                found = extractor(paths)
                yield pd.DataFrame([[p, *(found.get(p, {}).get(n) for n in names)] for p in paths], columns=["full_path", *names])

    return files.select("full_path").mapInPandas(run, f"full_path string, {columns}")


def latest_roots(scan_roots: DataFrame) -> DataFrame:
    """The last recorded identity of each volume."""
    return best_rows(scan_roots, [F.col("volume_name")], [-F.col("id")])


def archived_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Archived stage jobs, newest folder first: job, trip, verified_files, error_files, verified_gb, status, dest_root.

    Each folder with a file in it is a job; one without a readable summary has nulls.
    """
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    root = folder.rstrip("/").rsplit("/", 1)[-1].replace("\\", "").replace("'", "")
    job = F.regexp_extract("path", f"/\\Q{root}\\E/([^/]+)/", 1)
    jobs = held.select(job.alias("job")).filter("job <> ''").distinct()
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.input_file_name().alias("path")).filter(F.col("path").contains("summary"))
    fields = "trip string, verified_files long, error_files long, verified_gb double, status string, dest_root string"
    read = texts.select(job.alias("job"), F.from_json("value", fields).alias("s")).groupBy("job").agg(F.max("s").alias("s"))
    return jobs.join(read, "job", "left").select("job", "s.*").orderBy(F.desc("job"))


def load_state(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A JSON state file (any file system) as one row of the fields; missing, empty or corrupt means all are null."""
    none = spark.range(1).select(F.from_json(F.lit("{}"), fields).alias("s"))
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return none.select("s.*")
    read = spark.read.text(path, wholetext=True).agg(F.first(F.from_json("value", fields, {"mode": "PERMISSIVE"})).alias("s"))
    return read.select("s.*")


def candidates(files: DataFrame, metadata: DataFrame, only_unsorted: bool = False, under: str | None = None, limit: int | None = None) -> DataFrame:
    """Photos without a camera, one per hash (null hashes are one group), the smallest id of each; deleted rows count."""
    joined = files.join(metadata.select("file_id", "camera_make"), files["id"] == F.col("file_id"), "left")
    kept = joined.filter(S.low("extension").isin(*R.BUCKETS["photos"]) & (S.text("camera_make") == ""))
    if only_unsorted:
        kept = kept.filter(F.col("full_path").ilike("%unorganized%") | F.col("full_path").ilike("%nsorted%") | F.col("full_path").ilike("%ntitled%"))
    if under:
        kept = kept.filter(F.col("full_path").ilike(under.rstrip("/") + "/%"))
    rows = best_rows(kept.select("id", "full_path", "file_name", "sha256"), [F.col("sha256")], [F.col("id")])
    return rows.orderBy("id").limit(limit) if limit else rows


def under(df: DataFrame, scope: str, how: str = "folder", path: str = "full_path") -> DataFrame:
    """Rows of a scope: inside a folder, with a part of the path, or like a prefix in any case."""
    p, s = F.col(path), scope.rstrip("/")
    return df.filter({"folder": p.startswith(s + "/"), "part": p.contains(scope), "like": p.ilike(s + "/%")}[how])
