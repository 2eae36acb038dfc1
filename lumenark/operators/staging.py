"""Laying a trip out over folders, and the state of the job that copies it. Nothing here touches a file:
what a copy would see or has seen comes in as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S
from lumenark.operators.dedupe import best_rows, canonical_sources, missing_hash_key


def _junk() -> Column:
    return S.text("file_name").startswith("._") | (S.text("file_name") == ".DS_Store")


def _media_leaf() -> Column:
    """Folder of a file that is neither junk, proxy nor sidecar."""
    kind = F.when(F.col("stage") == "edited", "edited").otherwise("raw")
    media = F.when(F.col("bucket") == "videos", "videos").otherwise("images")
    camera = F.coalesce(F.nullif("device", F.lit("")), F.lit("Unknown"))
    sides = F.coalesce(F.nullif("orientation", F.lit("")), F.lit("Unknown"))
    return F.when(F.col("bucket") == "other", F.concat_ws("/", kind, F.lit("other"), camera)).otherwise(F.concat_ws("/", kind, media, camera, sides))


def _shot_stem(name: str = "file_name", ext: str = "extension") -> Column:
    """A sidecar's name without its own extension and one more before it."""
    base = F.expr(f"CASE WHEN coalesce({ext}, '') <> '' AND endswith(lower({name}), lower({ext})) THEN substr({name}, 1, length({name}) - length({ext})) ELSE {name} END")
    return F.lower(S.stem(base))


def layout(files: DataFrame, library: DataFrame) -> DataFrame:
    """files and `dest_rel`: the folder each goes to, null for junk and proxies.

    A paired sidecar goes where the media of the same folder and stem in the library goes (raw before photos before
    videos, then the smallest id), other sidecars to _Sidecars.
    """
    media = library.filter(F.col("bucket").isin("raw", "photos", "videos") & ~_junk())
    rank = S.first_match(((F.col("bucket") == b, i) for i, b in enumerate(("raw", "photos", "videos"))), 9)
    leaf = F.when(S.low("extension").isin(*R.PROXY_EXTENSIONS), F.lit(None)).otherwise(_media_leaf())
    parents = media.groupBy(S.dirname("full_path").alias("_dir"), F.lower(S.stem("file_name")).alias("_stem")).agg(F.min_by(F.struct(leaf.alias("leaf")), F.struct(rank, F.col("id"))).alias("_parent"))
    paired = F.when(S.low("extension").isin(*R.PAIRED_SIDECARS), _shot_stem())
    joined = files.withColumns({"_d": S.dirname("full_path"), "_s": paired}).join(parents, (F.col("_d") == F.col("_dir")) & (F.col("_s") == F.col("_stem")), "left")
    place = F.when(_junk() | S.low("extension").isin(*R.PROXY_EXTENSIONS), F.lit(None)).when(F.col("bucket") == "sidecar", F.coalesce(F.col("_parent.leaf"), F.lit("_Sidecars"))).otherwise(_media_leaf())
    return joined.withColumn("dest_rel", place).drop("_d", "_s", "_dir", "_stem", "_parent")


def plan(files: DataFrame, trip: str, library: DataFrame | None = None) -> DataFrame:
    """Items of a stage job: one per hash of the trip's labelled files, with every copy as a candidate source.

    The first file (by id) of a hash names the item; the second and later items of a folder and name (in any
    case, by id) get the hash's first eight characters before their extension. An item holds all copies of its hash, as
    any of their drives may be the one at hand; that list is as long as the hash is common in the trip.
    """
    chosen = files.filter(F.col("trip") == trip)
    keyed = chosen.withColumn("_key", missing_hash_key(chosen))
    copies = keyed.groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.col("device_name").alias("device"), F.col("full_path").alias("path"), F.coalesce("root_path", F.lit("")).alias("root")))), lambda c: c.dropFields("id")).alias("candidates"))
    heads = best_rows(keyed, [F.col("_key")], [F.col("id")])
    placed = layout(heads, library if library is not None else files).filter("dest_rel IS NOT NULL").join(copies, "_key")
    # The first by id keeps its name: an aggregation, so that a name many files share is no group in one task.
    spot = placed.groupBy(F.col("dest_rel").alias("_rel"), F.lower("file_name").alias("_name")).agg(F.min("id").alias("_first"))
    placed = placed.join(spot, (F.col("dest_rel") == F.col("_rel")) & (F.lower("file_name") == F.col("_name")))
    name = F.when(F.col("id") != F.col("_first"), F.concat(S.stem("file_name"), F.lit("__"), F.substring("_key", 1, 8), S.suffix("file_name"))).otherwise(F.col("file_name"))
    none = F.lit(None).cast("string")
    return placed.select(
        F.col("_key").alias("sha256"), "dest_rel", name.alias("dest_name"), F.col("file_size").alias("size"), "device", "stage", "bucket", "orientation", "candidates", F.col("full_path").alias("orig_path"), F.lit(trip).alias("trip"),
        F.when(F.col("bucket") == "sidecar", S.stem("file_name")).alias("sidecar_of"), F.lit("pending").alias("state"), none.alias("used_path"), none.alias("error"), none.alias("copied_at"), none.alias("verified_sha"), none.alias("verify_status"),
    )


def preview(files: DataFrame, trip: str, library: DataFrame | None = None) -> DataFrame:
    """Files and bytes per destination folder, by path; one canonical source per hash."""
    targets = canonical_sources(files.filter(F.col("trip") == trip))
    return layout(targets, library if library is not None else files).filter("dest_rel IS NOT NULL").groupBy("dest_rel").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes")).orderBy("dest_rel")


def preview_tree(files: DataFrame, trip: str, library: DataFrame | None = None) -> DataFrame:
    """(dest_rel, depth, files, bytes): the preview with a row for each folder at every level, and one, of depth 0 and an empty path, for all."""
    leaves = preview(files, trip, library)  # few rows: one a folder
    parts = F.split("dest_rel", "/")
    levels = leaves.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dest_rel"), n.alias("depth")))).alias("l"), "files", "bytes")
    tree = levels.groupBy("l.dest_rel", "l.depth").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    none = files.sparkSession.range(1).select(F.lit("").alias("dest_rel"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"))
    return tree.unionByName(none).groupBy("dest_rel", "depth").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).orderBy("dest_rel")


def dest_root(trips: DataFrame, trip: str, base: str) -> DataFrame:
    """One row, dest_root: where a trip's files go below base: place, year and month, as trips (trips.trips()) name them; an unknown trip goes by its name, undated."""
    known = trips.filter(F.col("trip") == trip).select(F.first("nas_folder").alias("folder"))
    return known.select(F.concat(F.lit(base.rstrip("/") + "/"), F.coalesce("folder", F.concat(S.slug(F.lit(trip)), F.lit("/Undated")))).alias("dest_root"))


def verify_hashes(verify: bool, mode: str) -> bool:
    """A move always verifies hashes."""
    return verify or mode == "move"


def run_pass(items: DataFrame, sources: DataFrame, copies: DataFrame, at_destination: DataFrame, verify: bool, dry_run: bool = False) -> DataFrame:
    """Items after one pass over those pending or interrupted.

    sources (path, used_path): candidate paths that can be read now, and where; copies (used_path, size, sha256): what
    copying them gave; at_destination (dest_rel, dest_name, size, sha256): files already there. Without a source an
    item stays pending. A copy or a file already there counts if its size, and its hash where asked for and
    known, agree.
    """
    first = items.select("sha256", F.posexplode("candidates").alias("_i", "_c")).join(sources, F.col("_c.path") == F.col("path")).groupBy("sha256").agg(F.min_by("used_path", "_i").alias("_src"))
    seen = copies.select(F.col("used_path").alias("_src"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    there = at_destination.select("dest_rel", "dest_name", F.col("size").alias("_old_size"), F.col("sha256").alias("_old_sha"))
    joined = items.join(first, "sha256", "left").join(seen, "_src", "left").join(there, ["dest_rel", "dest_name"], "left")
    return judged(joined, verify, dry_run).select(*items.columns)


def judged(joined: DataFrame, verify: bool, dry_run: bool = False) -> DataFrame:
    """Items beside what a pass knows of each (_src, the source used; _size and _sha of its copy; _old_size and _old_sha of what is at the destination), with their state after it."""
    todo = F.col("state").isin("pending", "copying")
    hashed = F.lit(verify) & ~F.col("sha256").startswith("__nh")
    resumed = F.coalesce((F.col("_old_size") == F.col("size")) & (~hashed | (F.col("_old_sha") == F.col("sha256"))), F.lit(False))
    outcome = (
        F.when(~todo, "as is").when(F.col("_src").isNull(), "wait").when(F.lit(dry_run), "dry").when(resumed, "resumed").when(F.col("_size").isNull(), "unread")
        .when(F.col("_size") != F.col("size"), "size").when(hashed & ~F.col("_sha").eqNullSafe(F.col("sha256")), "hash").otherwise("copied")
    )
    joined = joined.withColumns({"_o": outcome, "_hashed": hashed})
    o = F.col("_o")
    wrong_size = F.concat(F.lit("size mismatch after copy (expected "), F.col("size").cast("string"), F.lit(", got "), F.col("_size").cast("string"), F.lit(")"))
    state = F.when(o.isin("dry", "resumed", "copied"), "verified").when(o.isin("unread", "size", "hash"), "error").when(o == "wait", "pending").otherwise(F.col("state"))
    status = F.when(o == "resumed", F.coalesce("verify_status", F.when(F.col("_hashed"), "sha256-verified (resumed)").otherwise("size-verified (resumed)"))).when(o == "copied", F.when(F.col("_hashed"), "sha256-verified").otherwise("size-verified")).when(o == "size", "size-mismatch").when(o == "hash", "sha256-mismatch").otherwise(F.col("verify_status"))
    error = F.when(o == "size", wrong_size).when(o == "hash", "sha256 mismatch after copy").when(o == "unread", "source could not be read").otherwise(F.col("error"))
    return joined.withColumns(
        {"state": state, "verify_status": status, "error": error, "used_path": F.when(o.isin("dry", "resumed", "copied"), F.col("_src")).otherwise(F.col("used_path")), "verified_sha": F.when((o == "copied") & F.col("_hashed"), F.col("_sha")).otherwise(F.col("verified_sha"))}
    )


def retry(items: DataFrame) -> DataFrame:
    """Items in error are pending again."""
    failed = F.col("state") == "error"
    return items.withColumns({"error": F.when(failed, F.lit(None)).otherwise(F.col("error")), "state": F.when(failed, "pending").otherwise(F.col("state"))})


def skip_absent(items: DataFrame, present: DataFrame) -> DataFrame:
    """Pending items none of whose candidate paths, as written, is present are skipped."""
    there = items.select("sha256", F.explode("candidates.path").alias("path")).join(present.select("path"), "path", "left_semi").select("sha256").distinct().withColumn("_there", F.lit(True))
    return items.join(there, "sha256", "left").withColumn("state", F.when((F.col("state") == "pending") & F.col("_there").isNull(), "skipped").otherwise(F.col("state"))).select(*items.columns)


def planned_removals(items: DataFrame, sources: DataFrame, dest_root: str) -> DataFrame:
    """Ledger rows a move would write: the readable sources, but the destination itself, of items verified by hash."""
    done = items.filter((F.col("state") == "verified") & F.col("verify_status").startswith("sha256")).select("sha256", "size", F.concat_ws("/", F.lit(dest_root.rstrip("/")), "dest_rel", "dest_name").alias("dest_path"), F.explode("candidates").alias("c"))
    found = done.join(sources, F.col("c.path") == F.col("path")).filter(F.col("used_path") != F.col("dest_path"))
    return found.select("sha256", F.col("used_path").alias("source_path"), F.col("c.device").alias("source_device"), "dest_path", "size", F.lit(True).alias("verified_hash"))


def summary(items: DataFrame) -> DataFrame:
    """One row: items and bytes in all and verified, and items by state."""
    states = ("verified", "error", "skipped", "pending")
    return items.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("state") == "verified", F.col("size"))), F.lit(0)).alias("verified_bytes"), *(F.count_if(F.col("state") == s).alias(s) for s in states))


def job_summary(items: DataFrame, job: dict) -> DataFrame:
    """The row of a job's summary file: what the job was told, and its counts. job: trip, dest_root, dry_run, verify_hash, status, started_at, updated_at."""
    told = {name: F.lit(job.get(name)).cast("string").alias(name) for name in ("trip", "dest_root", "status", "started_at", "updated_at")}
    flags = {name: F.lit(bool(job.get(name))).alias(name) for name in ("dry_run", "verify_hash")}
    counts = [F.col(s).alias(f"{s}_files") for s in ("verified", "pending", "skipped", "error")]
    return summary(items).select(*told.values(), *flags.values(), "total_files", *counts, "total_bytes", "verified_bytes", S.gib("verified_bytes", 2).alias("verified_gb"), F.lit(2).alias("manifest_version"))


def status(items: DataFrame, mounted: DataFrame, show: int = 8) -> DataFrame:
    """The summary with the share of bytes done in percent, the absent drive (mounted: device_name) that could provide most
    bytes, and the first errors by hash, as "name: error"."""
    drive = next_absent_drive(drive_remaining(items), mounted).agg(F.first("device").alias("next_drive"))
    failed = items.filter("state = 'error'").orderBy("sha256").limit(show).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sha256", "dest_name", "error"))), lambda x: F.concat(x["dest_name"], F.lit(": "), F.coalesce(x["error"], F.lit("")))), "; ").alias("errors_sample"))
    done = F.when(F.col("total_bytes") > 0, F.round(100.0 * F.col("verified_bytes") / F.col("total_bytes"), 1)).otherwise(0.0)
    return summary(items).withColumn("pct", done).join(F.broadcast(drive)).join(F.broadcast(failed))  # one row each


def drive_remaining(items: DataFrame) -> DataFrame:
    """Per drive: pending items and bytes it could provide, each item once."""
    waiting = items.filter("state = 'pending'").select("size", F.explode(F.array_distinct(F.expr("transform(candidates, c -> c.device)"))).alias("device"))
    return waiting.groupBy("device").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "device")


def next_absent_drive(remaining: DataFrame, mounted: DataFrame) -> DataFrame:
    """Of the drives not mounted, the one with most bytes to provide."""
    return remaining.join(mounted.select(F.col("device_name").alias("device")), "device", "left_anti").orderBy(F.desc("bytes"), "device").limit(1)


def next_drive(items: DataFrame) -> DataFrame:
    """The drive that most candidates of pending items lie on (every candidate counts)."""
    return items.filter("state = 'pending'").select(F.explode("candidates").alias("c")).groupBy(F.col("c.device").alias("device")).agg(F.count("*").alias("candidates")).orderBy(F.desc("candidates"), "device").limit(1)


def errors(items: DataFrame) -> DataFrame:
    """Failed items with the path used, or their first candidate's."""
    source = F.coalesce("used_path", F.get("candidates", F.lit(0))["path"], F.lit(""))
    return items.filter("state = 'error'").select("dest_name", "dest_rel", "device", "size", "sha256", source.alias("source"), "error")


def manifest(items: DataFrame, dest_root: str, trip: str | None = None) -> DataFrame:
    """The 18 columns of a manifest; an item without a trip gets the job's."""
    if trip is not None:
        items = items.withColumn("trip", F.coalesce(F.nullif("trip", F.lit("")), F.lit(trip)))
    columns = {
        "dest_subfolder": "dest_rel", "size_bytes": "size", "sha256_inventory": "sha256", "copy_status": "state", "original_path": "orig_path", "resolved_source_path": "used_path", "sha256_verified": "verified_sha",
    }
    optional = {"sidecar_of", "sha256_verified", "verify_status", "original_path", "resolved_source_path", "copied_at", "error"}
    out = []
    for name in R.MANIFEST_COLUMNS:
        c = F.concat_ws("/", F.lit(dest_root), "dest_rel", "dest_name") if name == "destination_path" else F.col(columns.get(name, name))
        out.append((F.coalesce(c, F.lit("")) if name in optional else c).alias(name))
    return items.select(*out)
