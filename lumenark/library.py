"""One entry point: a library of tables and a method for each question asked of it."""

from __future__ import annotations

import datetime
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.functions import scalar as S
from lumenark.operators import clusters, dedupe, drives, jobs, maintenance, search, sinks, staging, trips
from lumenark.sources import inventory, schema
from lumenark.sources.durable import checkpointed

TABLES = {
    "files": schema.FILES, "media_metadata": schema.METADATA, "vision_tags": schema.VISION_TAGS, "captions": schema.CAPTIONS, "embeddings": schema.EMBEDDINGS, "faces": schema.FACES,
    "overrides": schema.OVERRIDES, "volumes": schema.VOLUMES, "scan_roots": schema.SCAN_ROOTS, "learned_drives": schema.LEARNED_DRIVES, "present_paths": schema.PRESENT_PATHS, "stage_items": schema.STAGE_ITEMS, "moves": schema.MOVES,
}


class Library:
    """tables: any of TABLES by name; those not given are empty. store: a folder that all executors share, in which the labelled
    files are kept under `version`, the caller's name for the state of the tables; without one they are kept in memory."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], store: str | None = None, version: str = "0"):
        self.spark, self.store, self.version = spark, store, version
        self.tables = {name: tables[name] if name in tables else spark.createDataFrame([], s) for name, s in TABLES.items()}

    def changed(self, **tables: DataFrame) -> Library:
        """The library with other tables in the place of its own. Methods that change something return one; the caller writes what it wants kept."""
        return Library(self.spark, {**self.tables, **tables}, self.store, f"{self.version}+{uuid.uuid4().hex}" if self.store else self.version)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @cached_property
    def files(self) -> DataFrame:
        """Live files, enriched and labelled, materialised once for a version of the tables."""
        rows = trips.labelled(inventory.enriched(self["files"], self["media_metadata"]), self["overrides"])
        return sinks.kept(self.spark, self.store, self.version, lambda: rows) if self.store else rows.persist()

    @cached_property
    def mounts(self) -> DataFrame:
        return self.identity().select("device_name", "mount")

    def summary(self) -> DataFrame:
        """One row of totals; soft-deleted rows count, as files still on disk do."""
        parts = [dedupe.totals(self["files"]), dedupe.duplicate_groups(self["files"]), dedupe.unique_bytes(self["files"])]
        return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # one row each

    def drive_usage(self) -> DataFrame:
        return dedupe.drive_usage(self["files"])

    def trips(self) -> DataFrame:
        return trips.trips(self.files).orderBy(F.desc("unique_bytes"), "trip")

    def sources(self) -> DataFrame:
        return trips.sources(self.files).orderBy(F.desc("bytes"), "device")

    def dedupe_plan(self) -> DataFrame:
        return dedupe.plan(self.files)

    def dedupe_summary(self) -> DataFrame:
        return dedupe.plan_summary(self.dedupe_plan())

    def stage_preview(self, trip: str) -> DataFrame:
        return staging.preview(self.files, trip)

    def stage_plan(self, trip: str) -> DataFrame:
        return staging.plan(self.files, trip)

    def stage_status(self) -> DataFrame:
        return staging.status(self["stage_items"], self.mounts.filter("mount IS NOT NULL"))

    def archived_jobs(self, folder: str) -> DataFrame:
        return inventory.archived_summaries(self.spark, folder)

    def stage_errors(self) -> DataFrame:
        return staging.errors(self["stage_items"])

    def stage_manifest(self, dest_root: str) -> DataFrame:
        return staging.manifest(self["stage_items"], dest_root)

    def drive_remaining(self) -> DataFrame:
        return staging.drive_remaining(self["stage_items"])

    def identity(self) -> DataFrame:
        return drives.resolve(trips.drive_inventory(self.files), self["volumes"], self["scan_roots"], self["learned_drives"])

    def identity_report(self) -> DataFrame:
        return drives.identity_report(trips.drive_inventory(self.files), self.identity(), self["scan_roots"])

    def vague_photos(self, **options) -> DataFrame:
        return inventory.candidates(self["files"], self["media_metadata"], **options)

    def vision_buckets(self) -> DataFrame:
        return search.bucket_histogram(self["vision_tags"])

    def vision_results(self, bucket: str | None = None, limit: int = 300) -> DataFrame:
        return search.tagged(self["vision_tags"], bucket, limit)

    def vision_search(self, query: str, limit: int = 80) -> DataFrame:
        return search.keywords(self["vision_tags"], query, limit)

    def screenshots_to_move(self, limit: int = 500) -> DataFrame:
        return search.screenshots_to_move(self["vision_tags"], limit)

    def search(self, query: str, k: int = 60, dates: bool = False) -> DataFrame:
        vectors = self["embeddings"].select(F.col("file_id").alias("id"), "vec")
        return search.text_search(vectors, self.files, query, k, dates)

    def caption_search(self, query: str, limit: int = 60) -> DataFrame:
        return search.captions(self["captions"], query, limit)

    def near_duplicates(self, threshold: float = clusters.R.NEAR_DUPLICATE) -> DataFrame:
        """Members of clusters inside a trip, the shot to keep at place 1."""
        vectors = self["embeddings"].select(F.col("file_id").alias("id"), "vec").join(self.files.select("id", F.col("trip").alias("block")), "id", "left")
        vectors = checkpointed(vectors)  # read several times on the way; the files' plan is long
        found = clusters.components(vectors, clusters.similar_stars(vectors, threshold))
        about = self.files.select("id", "file_name", F.col("full_path").alias("known_path"), F.lower("extension").alias("known_extension"), F.col("file_size").alias("size"), (F.col("width") * F.col("height")).alias("pixels"))
        named = found.join(self["embeddings"].select(F.col("file_id").alias("id"), "full_path"), "id").join(about, "id", "left")
        # Vectors from outside the inventory have their path only.
        named = named.withColumn("full_path", F.coalesce("known_path", "full_path"))
        named = named.withColumns({"file_name": F.coalesce("file_name", S.basename("full_path")), "extension": F.coalesce("known_extension", F.lower(S.suffix(S.basename("full_path"))))})
        return clusters.ranked_members(named.drop("known_path", "known_extension"))

    def people(self) -> DataFrame:
        return clusters.people(self["faces"].select("id", "person_id"))

    def counts(self) -> DataFrame:
        """Rows of the embedding, caption, tag and face tables."""
        names = ("embeddings", "captions", "vision_tags", "faces")
        out = None
        for name in names:
            part = self[name].agg(F.lit(name).alias("relation"), F.count("*").alias("rows"))
            out = part if out is None else out.unionByName(part)
        return out

    def reconcile(self) -> DataFrame:
        return maintenance.reconcile(self["files"], self.mounts, self["present_paths"])

    def trash(self, limit: int = 500) -> DataFrame:
        return maintenance.trash(self["files"], limit)

    def moves(self, limit: int = 200) -> DataFrame:
        return maintenance.recent_moves(self["moves"], limit)

    def moves_summary(self) -> DataFrame:
        return maintenance.moves_summary(self["moves"])

    # --- what changes the library ---------------------------------------------------------------------------

    @property
    def present(self) -> DataFrame:
        """Paths that exist."""
        return self["present_paths"].filter("size IS NOT NULL").select("path")

    def ingest(self, folder: str, device: str, scan_id: int, now: str, extractor=None, columns: str = "camera_make string, camera_model string, capture_date string") -> tuple[Library, DataFrame]:
        """What a folder holds now in files, and with an extractor (see inventory.extract_with) in metadata; and the record of the run."""
        scan = inventory.walk(self.spark, folder, content=True)
        files, run = maintenance.ingest(self["files"], scan, scan_id, device, folder.rstrip("/"), now)
        out = {"files": files}
        if extractor:
            found = inventory.extract_with(scan, extractor, columns)
            out["media_metadata"] = maintenance.ingest_metadata(files, self["media_metadata"], found, now)
        return self.changed(**out), run

    def tag(self, observations: DataFrame, now: str, **options) -> Library:
        return self.changed(vision_tags=jobs.tag_job(self["files"], self["media_metadata"], self["vision_tags"], observations, self.present, now, **options))

    def caption(self, now: str, part: str | None = None) -> Library:
        return self.changed(captions=jobs.caption_job(self["files"], self["captions"], self["vision_tags"], self.present, now, part))

    def embed(self, backend=None, part: str | None = None) -> Library:
        return self.changed(embeddings=jobs.embed_job(self["files"], self["embeddings"], self.present, backend, part))

    def find_faces(self, observations: DataFrame, part: str | None = None) -> Library:
        return self.changed(faces=jobs.face_job(self["files"], observations, self.present, part))

    def stage(self, trip: str, base: str, mode: str = "copy", confirm: str = "", dry_run: bool = False, verify_hash: bool = True) -> tuple[Library, DataFrame]:
        """A new stage job of a trip, and its row of facts (trip, dest_root, mode, verify_hash, dry_run). A move that is no dry run wants confirm MOVE."""
        if mode not in ("copy", "move"):
            raise ValueError("mode is copy or move")
        if mode == "move" and not dry_run and confirm.strip().upper() != "MOVE":
            raise ValueError("a move wants confirm='MOVE'")
        facts = staging.dest_root(trips.trips(self.files), trip, base).select(F.lit(trip).alias("trip"), "dest_root", F.lit(mode).alias("mode"), F.lit(staging.verify_hashes(verify_hash, mode)).alias("verify_hash"), F.lit(dry_run).alias("dry_run"))
        return self.changed(stage_items=self.stage_plan(trip)), facts

    def stage_continue(self, sources: DataFrame, copies: DataFrame, at_destination: DataFrame, verify: bool = True, dry_run: bool = False) -> Library:
        """One pass over what is pending (see staging.run_pass)."""
        return self.changed(stage_items=staging.run_pass(self["stage_items"], sources, copies, at_destination, verify, dry_run))

    def stage_skip_absent(self) -> Library:
        return self.changed(stage_items=staging.skip_absent(self["stage_items"], self.present))

    def stage_retry(self) -> Library:
        return self.changed(stage_items=staging.retry(self["stage_items"]))

    def stage_tree(self, trip: str) -> DataFrame:
        """The preview with totals of every folder and of all."""
        return staging.preview_tree(self.files, trip)

    def reconcile_report(self) -> DataFrame:
        return maintenance.reconcile_report(self["files"], self.reconcile())

    def prune(self, now: str) -> Library:
        """What is missing is soft-deleted, unless nothing is present."""
        return self.changed(files=maintenance.prune(self["files"], self.reconcile(), now))

    def restore(self, ids: DataFrame) -> Library:
        return self.changed(files=maintenance.restore(self["files"], ids))

    def purge(self, ids: DataFrame | None = None, now: datetime.datetime | None = None, retention_days: int | None = None) -> Library:
        """Soft-deleted rows named by ids, or those whose retention has run out at `now`, leave all tables."""
        if (ids is None) == (now is None):
            raise ValueError("purge() takes ids or now")
        side = {name: self[name] for name in ("vision_tags", "captions", "embeddings", "faces")}
        files, metadata, side = maintenance.purge(self["files"], self["media_metadata"], side, ids, None if now is None else maintenance.cutoff(now, retention_days))
        return self.changed(files=files, media_metadata=metadata, **side)

    def override(self, key: str, trip: str | None, category: str | None) -> Library:
        """A user's word on a folder; key is "drive::folder"."""
        return self.changed(overrides=maintenance.put_override(self["overrides"], key, trip, category))

    def map_drive(self, device_name: str, mount: str) -> Library:
        """A user's word on where a drive is."""
        return self.changed(learned_drives=drives.mapped_by_hand(self["learned_drives"], device_name, mount, self["volumes"]))

    def near_duplicate_report(self, threshold: float = clusters.R.NEAR_DUPLICATE, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        """Totals over all clusters, and the members of the largest ones."""
        return clusters.report(self.near_duplicates(threshold), limit)
