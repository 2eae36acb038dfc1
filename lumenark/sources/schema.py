"""Explicit schemas of the inventory's relations, and the step that adds optional columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "strings": T.ArrayType(T.StringType()),
    "doubles": T.ArrayType(T.DoubleType()),
    "floats": T.ArrayType(T.FloatType()),
    "labels": T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("conf", T.DoubleType())])),
    "candidates": T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("device", "path", "root")])),
}


def _schema(columns: str) -> T.StructType:
    """From "name type, ...", with types by their names above; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


FILES = _schema(
    "id long, full_path string, file_name string, extension string, file_size long, created_time string, modified_time string, sha256 string, mime_type string, "
    "root_path string, device_name string, first_seen_scan_id long, last_seen_scan_id long, indexed_at string, deleted_at string"
)
METADATA = _schema(
    "file_id long, media_type string, capture_date string, creation_date string, camera_make string, camera_model string, image_width long, image_height long, "
    "gps_latitude double, gps_longitude double, raw_metadata_json string, extracted_at string"
)
VISION_TAGS = _schema("file_id long, full_path string, top_label string, top_conf double, labels labels, has_text boolean, text_sample string, content_bucket string, tagged_at string")
CAPTIONS = _schema("file_id long, full_path string, caption string, source string, created_at string")
EMBEDDINGS = _schema("file_id long, full_path string, vec floats")
FACES = _schema("id long, full_path string, bbox doubles, vec floats, person_id int")
OVERRIDES = _schema("key string, trip string, category string")
VOLUMES = _schema("name string, mount string, uuid string, top strings")
SCAN_RUNS = _schema("id long, root_path string, started_at string, finished_at string, files_seen long, files_added long, errors long, status string")
SCAN_ROOTS = _schema("id long, volume_name string, volume_uuid string, root_fingerprint string")
LEARNED_DRIVES = _schema("device_name string, mount string, uuid string")
PRESENT_PATHS = _schema("path string, size long, sha256 string, parent_exists boolean")
STAGE_ITEMS = _schema(
    "sha256 string, dest_rel string, dest_name string, size long, device string, stage string, bucket string, orientation string, candidates candidates, orig_path string, trip string, "
    "sidecar_of string, state string, used_path string, error string, copied_at string, verified_sha string, verify_status string"
)
MOVES = _schema("id long, sha256 string, source_path string, source_device string, dest_path string, size long, verified_hash boolean, action string, moved_at string")


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns that it lacks, as typed nulls; its own columns stay as they are."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})
