"""Jobs from candidates to the table they renew. Each takes the old table and what a model or extractor observed, and gives
the new table; the caller writes it. present (path): files that exist now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S
from lumenark.operators import clusters, maintenance, search
from lumenark.sources import inventory, schema


def there(rows: DataFrame, present: DataFrame) -> DataFrame:
    """Rows whose full_path exists."""
    return rows.join(present.select(F.col("path").alias("full_path")), "full_path", "left_semi")


def targets(files: DataFrame, present: DataFrame, part: str | None = None) -> DataFrame:
    """Shots that exist, with the part in their path if one is given."""
    shots = inventory.shots(inventory.live(files))
    return there(inventory.under(shots, part, "part") if part else shots, present)


def tag_job(files: DataFrame, metadata: DataFrame, tags: DataFrame, observations: DataFrame, present: DataFrame, now: str, **options) -> DataFrame:
    """tags with those of present candidates renewed (observations: see search.tag; options: see inventory.candidates)."""
    chosen = there(inventory.candidates(files, metadata, **options), present)
    return maintenance.upsert(schema.ensure_columns(tags, schema.VISION_TAGS), search.tag(chosen, observations).withColumn("tagged_at", F.lit(now)), "file_id")


def caption_job(files: DataFrame, captions: DataFrame, tags: DataFrame, present: DataFrame, now: str, part: str | None = None) -> DataFrame:
    """captions with those of present shots renewed."""
    made = search.caption(targets(files, present, part).select("id", "full_path"), tags).withColumn("created_at", F.lit(now))
    return maintenance.upsert(schema.ensure_columns(captions, schema.CAPTIONS), made, "file_id")


def embed_job(files: DataFrame, embeddings: DataFrame, present: DataFrame, backend=None, part: str | None = None) -> DataFrame:
    """embeddings with those of present shots renewed (backend: see search.embed)."""
    made = search.embed(targets(files, present, part), backend).withColumnRenamed("id", "file_id")
    return maintenance.upsert(embeddings, made, "file_id")


def face_job(files: DataFrame, observations: DataFrame, present: DataFrame, part: str | None = None, threshold: float = R.SAME_FACE) -> DataFrame:
    """The whole face table anew: faces observed (path, faces of bbox and vec) in present shots, grouped into people in the
    order of file and face; faces without a vector are left out."""
    shots = targets(files, present, part).select(F.col("id").alias("file_id"), "full_path")
    seen = shots.join(observations.select(F.col("path").alias("full_path"), F.posexplode("faces").alias("pos", "face")), "full_path")
    faces = seen.select("file_id", "pos", "full_path", "face.bbox", "face.vec").filter("vec IS NOT NULL").withColumn("id", F.xxhash64("file_id", "pos"))
    return faces.join(clusters.greedy_groups(faces, threshold, ("file_id", "pos", "id")), "id").select(*schema.FACES.names)


def crops(faces: DataFrame, sizes: DataFrame) -> DataFrame:
    """faces (id, full_path, bbox) with the crop of each in its image (sizes: full_path, width, height)."""
    return faces.join(sizes, "full_path").withColumn("crop", S.face_crop("bbox", "width", "height")).filter("crop IS NOT NULL").select("id", "crop.*")
