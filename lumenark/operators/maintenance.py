"""Versioned rewrites of tables: upserts, soft deletion, purge, reconciliation, ledgers. Each takes the old
table and gives the new one; the caller writes it."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S
from lumenark.sources import schema

#: Columns of files and metadata that a second ingest of a path renews.
RENEWED_FILES = ("file_size", "sha256", "modified_time", "last_seen_scan_id", "indexed_at")
RENEWED_METADATA = ("camera_make", "camera_model", "raw_metadata_json")
SETTINGS = {"trash_retention_days": R.RETENTION_DAYS, "verify_hash": True}


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new lacks. Of a key that new holds twice the largest row counts; null keys are no one's."""
    once = newest(new.filter(F.col(key).isNotNull()), key).unionByName(new.filter(F.col(key).isNull()))
    return old.join(once.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)


def partial_upsert(old: DataFrame, new: DataFrame, key: str, renewed: tuple[str, ...]) -> DataFrame:
    """Old rows with the renewed columns of new rows of the same key (nulls too), and new rows without an old one."""
    fresh = new.select(*(F.col(c).alias(f"_{c}") for c in new.columns), F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(fresh, F.col(key) == F.col(f"_{key}"), "full")

    def column(name: str):
        if name not in new.columns:
            return F.col(name)
        if name in renewed:
            return F.when(F.col("_new"), F.col(f"_{name}")).otherwise(F.col(name)).alias(name)
        return F.when(F.col("_old"), F.col(name)).otherwise(F.col(f"_{name}")).alias(name)

    return joined.select(*(column(c) for c in old.columns))


def newest(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """One row of each key, the one with the largest values of by (of equals, the largest row); the key is not null."""
    names = [c for c in rows.columns if c not in (key, *by)]
    if not names and not by:
        return rows.distinct()
    best = rows.groupBy(key).agg(F.max(F.struct(*(F.col(c) for c in (*by, *names)))).alias("_row"))
    return best.select(key, "_row.*").select(*rows.columns)


def ingest(files: DataFrame, scan: DataFrame, scan_id: int, device: str, root: str, now: str) -> tuple[DataFrame, DataFrame]:
    """files after a scan (full_path, file_name, extension, file_size, modified_time, sha256), and the record of its run.

    A path that was scanned twice counts once, as it was modified last. New paths get ids made of their paths, so that
    there is no counter over all rows; a path that was soft-deleted stays so.
    """
    files = schema.ensure_columns(files, schema.FILES)
    seen = newest(scan, "full_path", "modified_time")
    seen = seen.withColumns({"mime_type": S.mime("extension"), "root_path": F.lit(root), "device_name": F.lit(device), "first_seen_scan_id": F.lit(scan_id).cast("long"), "last_seen_scan_id": F.lit(scan_id).cast("long"), "indexed_at": F.lit(now)})
    known = seen.join(files.select("full_path"), "full_path", "left_semi")
    merged = partial_upsert(files, seen, "full_path", RENEWED_FILES).withColumn("id", F.coalesce("id", S.path_id("full_path")))
    counters = seen.agg(F.count("*").alias("files_seen")).join(known.agg(F.count("*").alias("_known")), how="cross")  # one row each
    record = {"id": F.lit(scan_id).cast("long"), "root_path": F.lit(root), "started_at": F.lit(now), "finished_at": F.lit(now), "files_added": F.col("files_seen") - F.col("_known"), "errors": F.lit(0).cast("long"), "status": F.lit("completed")}
    return merged, counters.withColumns(record).select(*schema.SCAN_RUNS.names)


def ingest_metadata(files: DataFrame, metadata: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """metadata after an ingest; files is the table after it, found what an extractor said: full_path and any metadata columns.

    A file that has metadata gets its make, model and raw JSON renewed, and keeps the rest. One row of found counts for a path.
    """
    metadata = schema.ensure_columns(metadata, schema.METADATA)
    kind = F.when(S.bucket("extension") == "videos", "video").otherwise("photo")
    rows = files.select(F.col("id").alias("file_id"), "full_path", kind.alias("media_type")).join(newest(found, "full_path"), "full_path").drop("full_path")
    return partial_upsert(metadata, rows.withColumn("extracted_at", F.lit(now)), "file_id", RENEWED_METADATA)


def soft_delete(files: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Rows of ids that are not deleted yet get the time."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    joined = schema.ensure_columns(files, schema.FILES).join(gone, F.col("id") == F.col("_id"), "left")
    return joined.withColumn("deleted_at", F.when(F.col("_id").isNotNull() & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("_id")


def restore(files: DataFrame, ids: DataFrame) -> DataFrame:
    back = ids.select(F.col("id").alias("_id")).distinct()
    return files.join(back, F.col("id") == F.col("_id"), "left").withColumn("deleted_at", F.when(F.col("_id").isNull(), F.col("deleted_at"))).drop("_id")


def cutoff(now: datetime.datetime, retention_days: int | None = None) -> str:
    """Rows deleted before this have expired; a retention of 0 is the default one."""
    return (now - datetime.timedelta(days=retention_days or R.RETENTION_DAYS)).strftime("%Y-%m-%d %H:%M:%S")


def purgeable(files: DataFrame, ids: DataFrame | None = None, before: str | None = None) -> DataFrame:
    """Soft-deleted rows named by ids, or deleted before a time."""
    gone = files.filter("deleted_at IS NOT NULL")
    return gone.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else gone.filter(F.col("deleted_at") < before)


def purge(files: DataFrame, metadata: DataFrame, side_tables: dict[str, DataFrame], ids: DataFrame | None = None, before: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """files, metadata and side tables (by full_path) without what is purgeable."""
    gone = purgeable(files, ids, before).select("id", "full_path")
    return (
        files.join(gone.select("id"), "id", "left_anti"),
        metadata.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti"),
        {name: t.join(gone.select("full_path"), "full_path", "left_anti") for name, t in side_tables.items()},
    )


def trash(files: DataFrame, limit: int = 500) -> DataFrame:
    return files.filter("deleted_at IS NOT NULL").select("id", "full_path", "file_size", "device_name", "deleted_at").orderBy(F.desc("deleted_at"), "id").limit(limit)


def reconcile(files: DataFrame, mounts: DataFrame, present: DataFrame) -> DataFrame:
    """(id, status) of live files: present as written or on the drive's mount; missing if only the folder is there;
    skipped if the drive is not mounted or the folder is gone, too.

    mounts (device_name, mount); present (path, parent_exists): paths that exist, and paths that do not whose folder does
    (parent_exists true and `size` null).
    """
    on_disk = present.filter("size IS NOT NULL").select(F.col("path").alias("_p")).distinct()
    folders = present.filter("parent_exists").select(F.col("path").alias("_f")).distinct()
    live = schema.ensure_columns(files, schema.FILES).filter("deleted_at IS NULL").select("id", "full_path", "root_path", "device_name")
    placed = live.join(mounts.select("device_name", "mount"), "device_name", "left").withColumn("moved", S.rewritten("full_path", "root_path", "mount"))
    seen = placed.join(on_disk, F.col("full_path") == F.col("_p"), "left").withColumn("_as_is", F.col("_p").isNotNull()).drop("_p")
    seen = seen.join(on_disk, F.col("moved") == F.col("_p"), "left").join(folders, F.col("moved") == F.col("_f"), "left")
    status = F.when(F.col("_as_is"), "present").when(F.col("mount").isNull(), "skipped").when(F.col("_p").isNotNull(), "present").when(F.col("_f").isNotNull(), "missing").otherwise("skipped")
    return seen.select("id", status.alias("status"))


def reconcile_counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("present", "missing", "skipped")))


def reconcile_report(files: DataFrame, statuses: DataFrame, show: int = 20) -> DataFrame:
    """The counts, how many were checked, and the paths of the first `show` missing files by id."""
    first = statuses.filter("status = 'missing'").select("id").orderBy("id").limit(show)
    sample = files.join(F.broadcast(first), "id").filter("full_path <> ''")  # at most `show` rows
    paths = sample.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "full_path"))), lambda r: r["full_path"]).alias("missing_sample"))
    return reconcile_counts(statuses).withColumn("checked", F.col("present") + F.col("missing") + F.col("skipped")).join(F.broadcast(paths))  # one row each


def prune(files: DataFrame, statuses: DataFrame, now: str) -> DataFrame:
    """Soft-delete what is missing, unless nothing at all is present: then the drives, not the files, are gone."""
    seen = statuses.agg(F.count_if(F.col("status") == "present").alias("_seen"))
    gone = statuses.filter("status = 'missing'").join(F.broadcast(seen), F.col("_seen") > 0).select("id")  # seen is one row
    return soft_delete(files, gone, now)


def record_moves(ledger: DataFrame, removals: DataFrame, action: str, now: str) -> DataFrame:
    """The ledger with new rows; ids are unique and rise, not necessarily one by one."""
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = removals.join(F.broadcast(last)).withColumn("id", F.col("_last") + 1 + F.monotonically_increasing_id()).drop("_last")  # last is one row
    return ledger.unionByName(new.withColumns({"action": F.lit(action), "moved_at": F.lit(now)}), allowMissingColumns=True)


def moves_summary(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("moves"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def recent_moves(ledger: DataFrame, limit: int = 200) -> DataFrame:
    return ledger.orderBy(F.desc("id")).limit(limit)


def put_override(overrides: DataFrame, key: str, trip: str | None, category: str | None) -> DataFrame:
    """overrides with one key's row set; key is "drive::folder"."""
    row = overrides.sparkSession.createDataFrame([(key, trip, category)], schema.OVERRIDES)
    return upsert(overrides, row, "key")


def startup(files: DataFrame, metadata: DataFrame, side_tables: dict[str, DataFrame], settings: dict, now: datetime.datetime) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """What a new session begins with: the tables without rows whose retention has run out."""
    return purge(files, metadata, side_tables, before=cutoff(now, saved_settings({}, settings)["trash_retention_days"]))


def saved_settings(current: dict, changes: dict) -> dict:
    """Defaults, then what is stored, then changes; unknown names are passed over."""
    return SETTINGS | {k: v for k, v in (current | changes).items() if k in SETTINGS}
