"""Queries over the test tables for jobs, exports, drives and ordered listings; registered like those of `queries`."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S
from lumenark.operators import clusters, drives, jobs, maintenance, search, sinks, staging, trips
from lumenark.plans import oracle as O
from lumenark.plans import queries as Q
from lumenark.plans.demo import duckdb_with, spark_table
from lumenark.plans.queries import query
from lumenark.sources import inventory, schema
from lumenark.sources.durable import scratch

NOW = Q.NOW


# --- listings in an order --------------------------------------------------------------------------------


@query(O.labelled_with("SELECT trip, round(unique_bytes / 1073741824.0, 2) AS gib, unique_bytes FROM (SELECT trip, coalesce(sum(file_size) FILTER (f), 0) AS unique_bytes FROM (SELECT *, sha256 <> '' AND row_number() OVER (PARTITION BY trip, sha256 ORDER BY id) = 1 AS f FROM labelled) x GROUP BY trip) y ORDER BY unique_bytes DESC, trip LIMIT 5"))
def srt2_largest_trips(spark, d):
    rows = trips.trips(Q._labelled(spark, d)).select("trip", S.gib("unique_bytes", 2).alias("gib"), "unique_bytes")
    return rows.orderBy(F.desc("unique_bytes"), "trip").limit(5)


@query(f"{duckdb_with('files', 'tags')} SELECT file_id, full_path, top_conf, content_bucket FROM tags ORDER BY top_conf DESC, file_id LIMIT 300")
def srt3_surest_tags(spark, d):
    return search.tagged(spark_table(spark, d, "tags")).select("file_id", "full_path", "top_conf", "content_bucket")


@query(f"{duckdb_with('files', 'tags')} SELECT file_id, full_path, top_conf FROM tags WHERE content_bucket = 'Documents' ORDER BY top_conf DESC, file_id LIMIT 300")
def flt10_tags_of_a_bucket(spark, d):
    return search.tagged(spark_table(spark, d, "tags"), "Documents").select("file_id", "full_path", "top_conf")


@query(f"{Q.MEMBERS} SELECT id, component, place, members FROM m WHERE component IN (SELECT component FROM m WHERE members > 1 GROUP BY component ORDER BY max(members) DESC, component LIMIT 3)")
def srt6_largest_clusters(spark, d):
    return clusters.report(Q._members(spark, d), 3)[1].select("id", "component", "place", "members")


@query("SELECT l_returnflag || l_linestatus AS device_name, round(sum(cast(l_quantity AS bigint)) * 4096 / 1073741824.0, 2) AS gib2, round(sum(cast(l_quantity AS bigint)) * 4096 / 1073741824.0, 1) AS gib1 FROM lineitem GROUP BY 1")
def scl25_gib(spark, d):
    rows = spark_table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("device_name")).agg((F.sum(F.col("l_quantity").cast("long")) * 4096).alias("bytes"))
    return rows.select("device_name", S.gib("bytes", 2).alias("gib2"), S.gib("bytes", 1).alias("gib1"))


PHOTOS = f"lower(extension) IN {O._in(R.BUCKETS['photos'])} AND coalesce(camera_make, '') = ''"
UNSORTED = "(full_path ILIKE '%unorganized%' OR full_path ILIKE '%nsorted%' OR full_path ILIKE '%ntitled%')"


@query(f"{duckdb_with('files', 'metadata')} SELECT id, full_path, file_name, sha256 FROM (SELECT f.*, row_number() OVER (PARTITION BY sha256 ORDER BY id) AS k FROM files f LEFT JOIN metadata m ON f.id = m.file_id WHERE {PHOTOS} AND {UNSORTED} AND full_path ILIKE '/volumes/t7 ssd1/%') x WHERE k = 1 ORDER BY id LIMIT 40")
def flt4_unsorted_under(spark, d):
    """Only unsorted photos below a folder, in any case, the first forty."""
    return inventory.candidates(spark_table(spark, d, "files"), spark_table(spark, d, "metadata"), True, "/volumes/t7 ssd1/", 40).select("id", "full_path", "file_name", "sha256")


@query(f"{duckdb_with('files')} SELECT 'folder' AS how, count(*) AS files FROM files WHERE starts_with(full_path, '/Volumes/Archive/') UNION ALL SELECT 'part', count(*) FROM files WHERE contains(full_path, 'Paris') UNION ALL SELECT 'like', count(*) FROM files WHERE full_path ILIKE '/volumes/archive/%'")
def flt5_scopes(spark, d):
    files = spark_table(spark, d, "files")
    parts = [inventory.under(files, scope, how).agg(F.lit(how).alias("how"), F.count("*").alias("files")) for how, scope in (("folder", "/Volumes/Archive/"), ("part", "Paris"), ("like", "/volumes/archive"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- drives ------------------------------------------------------------------------------------------------


@query(Q.ORACLES["jn8_drive_resolution"].replace("SELECT device_name, CASE WHEN via IS NULL", "SELECT device_name, files, bytes, device_name = 'T7 SSD2' AS has_uuid, CASE WHEN via IS NULL") + " JOIN (SELECT device_name, count(*) AS files, sum(file_size) AS bytes FROM enriched GROUP BY device_name) t USING (device_name)")
def agg14_identity_report(spark, d):
    inventory_of_drives = Q._drives(spark, d)
    roots = spark.createDataFrame(list(Q.ROOTS), "id long, volume_name string, volume_uuid string, root_fingerprint string")
    learned = spark.createDataFrame(list(Q.LEARNED), "device_name string, mount string, uuid string")
    return drives.identity_report(inventory_of_drives, drives.resolve(inventory_of_drives, Q._volumes(spark), roots, learned), roots)


@query("SELECT source AS volume, array_to_string((list(DISTINCT lang ORDER BY lang))[1:3], '|') AS root_fingerprint FROM documents WHERE NOT starts_with(lang, '.') GROUP BY source")
def scl29_root_fingerprint(spark, d):
    return drives.root_fingerprint(spark_table(spark, d, "documents").withColumnRenamed("source", "volume"), "volume", "lang", 3)


@query(f"""{duckdb_with('files')}, p AS (SELECT *, '/mnt/' || device_name || substr(full_path, length(root_path) + 1) AS moved FROM files)
SELECT DISTINCT full_path AS path, CASE WHEN file_size % 3 = 0 THEN full_path ELSE moved END AS used_path FROM p WHERE file_size % 3 = 0 OR (file_size % 3 = 1 AND device_name <> 'Archive')""")
def jn9_readable_paths(spark, d):
    """A third of all files is there as written, a third on its drive's mount (the archive has none), the rest nowhere."""
    files = spark_table(spark, d, "files")
    mounts = files.select("device_name").distinct().withColumn("mount", F.when(F.col("device_name") != "Archive", F.concat(F.lit("/mnt/"), "device_name")))
    moved = F.concat(F.lit("/mnt/"), "device_name", F.expr("substr(full_path, length(root_path) + 1)"))
    present = files.filter("file_size % 3 = 0").select(F.col("full_path").alias("path")).unionByName(files.filter("file_size % 3 = 1").select(moved.alias("path")))
    return drives.readable_paths(files.select(F.col("device_name").alias("device"), F.col("full_path").alias("path"), F.col("root_path").alias("root")), mounts, present)


@query("SELECT source AS device_name, '/Volumes/' || source AS mount, CASE WHEN min(n_chars) % 2 = 0 THEN 'new' || min(n_chars) ELSE 'old' END AS uuid FROM documents GROUP BY source UNION ALL SELECT 'gone', '/old', 'old'")
def dml11_remembered_drives(spark, d):
    """Mounts are renewed; a UUID is kept where the new one is empty."""
    seen = spark_table(spark, d, "documents").groupBy(F.col("source").alias("device_name")).agg(F.min("n_chars").alias("n"))
    learned = seen.select("device_name", F.lit("/old").alias("mount"), F.lit("old").alias("uuid")).unionByName(spark.createDataFrame([("gone", "/old", "old")], schema.LEARNED_DRIVES))
    matches = seen.select("device_name", F.concat(F.lit("/Volumes/"), "device_name").alias("mount"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("new"), "n")).otherwise("").alias("uuid"))
    return drives.remembered(learned, matches)


# --- stage jobs ----------------------------------------------------------------------------------------------


@query(f"""{Q.STATES}, t AS (SELECT sum(size) AS total, coalesce(sum(size) FILTER (state = 'verified'), 0) AS done FROM s),
r AS (SELECT device, sum(size) AS bytes FROM (SELECT DISTINCT event_id, size, device FROM c WHERE state = 'pending') x WHERE device NOT IN ('d1', 'd3') GROUP BY device)
SELECT count(*) AS total_files, sum(size) AS total_bytes, any_value(done) AS verified_bytes, count(*) FILTER (state = 'verified') AS verified, count(*) FILTER (state = 'error') AS error, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'pending') AS pending,
       round(100.0 * any_value(done) / any_value(total), 1) AS pct, (SELECT device FROM r ORDER BY bytes DESC, device LIMIT 1) AS next_drive,
       (SELECT string_agg(event_type || ': failed', '; ' ORDER BY h) FROM (SELECT cast(event_id AS varchar) AS h, event_type FROM s WHERE state = 'error' ORDER BY h LIMIT 8) e) AS errors_sample FROM s, t""")
def agg10_stage_status(spark, d):
    return staging.status(Q._states(spark, d), spark.createDataFrame([("d1",), ("d3",)], "device_name string"))


def _pass(spark, d) -> DataFrame:
    """A pass over items of the trip in which, by the size of the file, a source is missing, cannot be read, gives other bytes or another hash, or the file is there already."""
    items = Q._items(spark, d)
    case = F.col("size") % 6
    first = F.get("candidates", F.lit(0))["path"]
    sources = items.filter(case != 0).select(first.alias("path"), first.alias("used_path")).distinct()
    copies = items.filter(~case.isin(0, 1)).select(first.alias("used_path"), F.when(case == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(case == 3, "other").otherwise(F.col("sha256")).alias("sha256"))
    there = items.filter(case == 4).select("dest_rel", "dest_name", "size", "sha256")
    return staging.run_pass(items, sources, copies, there, True)


OUTCOMES = """CASE size % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN CASE WHEN starts_with(sha256, '__nh') THEN 'verified' ELSE 'error' END ELSE 'verified' END"""
STATUSES = """CASE size % 6 WHEN 2 THEN 'size-mismatch' WHEN 3 THEN CASE WHEN starts_with(sha256, '__nh') THEN 'size-verified' ELSE 'sha256-mismatch' END
    WHEN 4 THEN CASE WHEN starts_with(sha256, '__nh') THEN 'size-verified (resumed)' ELSE 'sha256-verified (resumed)' END WHEN 5 THEN CASE WHEN starts_with(sha256, '__nh') THEN 'size-verified' ELSE 'sha256-verified' END END"""


@query(O.labelled_with(f"{Q.ITEMS} SELECT sha256, {OUTCOMES} AS state, {STATUSES} AS verify_status FROM items"))
def job2_pass_outcomes(spark, d):
    return _pass(spark, d).select("sha256", "state", "verify_status")


@query(O.labelled_with(f"{Q.ITEMS} SELECT sha256, CASE WHEN size % 6 = 0 AND starts_with(split_part(candidates, '=', 2), '/Volumes/T7') THEN 'pending' WHEN {OUTCOMES} = 'pending' THEN 'skipped' WHEN {OUTCOMES} = 'error' THEN 'pending' ELSE {OUTCOMES} END AS state FROM items"))
def job3_retry_and_skip(spark, d):
    """What waits is skipped unless its first source is on a drive at hand; then errors are tried again."""
    items = _pass(spark, d).withColumn("candidates", F.slice("candidates", 1, 1))
    at_hand = items.select(F.explode("candidates.path").alias("path")).filter(F.col("path").startswith("/Volumes/T7"))
    return staging.retry(staging.skip_absent(items, at_hand)).select("sha256", "state")


MANIFEST = f"""SELECT '{Q.TRIP}' AS trip, dest_name, dest_rel AS dest_subfolder, device, stage, bucket, orientation, CASE WHEN bucket = 'sidecar' THEN {O.STEM.replace("file_name", "regexp_extract(orig_path, '([^/]*)$', 1)")} ELSE '' END AS sidecar_of, size AS size_bytes, sha256 AS sha256_inventory,
    CASE WHEN size % 6 = 5 AND NOT starts_with(sha256, '__nh') THEN sha256 ELSE '' END AS sha256_verified, {OUTCOMES} AS copy_status, coalesce({STATUSES}, '') AS verify_status, orig_path AS original_path, '/nas/' || dest_rel || '/' || dest_name AS destination_path FROM items"""


@query(O.labelled_with(f"{Q.ITEMS} {MANIFEST}"))
def prj4_manifest_rows(spark, d):
    return staging.manifest(_pass(spark, d), "/nas").drop("resolved_source_path", "copied_at", "error")


@query(O.labelled_with(f"{Q.ITEMS}, f AS ({MANIFEST}) SELECT '\"' || trip || '\",\"' || replace(dest_name, '\"', '''') || '\",\"' || dest_subfolder || '\"' AS line FROM f WHERE copy_status = 'error'"))
def snk3_error_lines(spark, d):
    """The first three fields of the failed items' CSV lines."""
    rows = staging.manifest(_pass(spark, d), "/nas").filter("copy_status = 'error'")
    return sinks.manifest_lines(rows).select(F.substring_index("line", ",", 3).alias("line"))


@query("SELECT event_id AS id, user_id AS size FROM events ORDER BY event_id DESC LIMIT 100000")
def snk4_moves_export(spark, d):
    """The exported ledger read back."""
    folder = scratch(spark, "moves")
    sinks.write_moves(spark_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("size")), folder)
    return spark.read.option("header", True).schema("id long, size long").csv(folder)


@query(O.labelled_with(f"{Q.ITEMS}, f AS (SELECT size, {OUTCOMES} AS state FROM items) SELECT '{Q.TRIP}_20250102-030405' AS job, '{Q.TRIP}' AS trip, count(*) FILTER (state = 'verified') AS verified_files, count(*) FILTER (state = 'error') AS error_files, round(coalesce(sum(size) FILTER (state = 'verified'), 0) / 1073741824.0, 2) AS verified_gb, 'done' AS status, '/nas' AS dest_root, (SELECT count(*) FROM items) AS listed FROM f"))
def snk6_archive_round_trip(spark, d):
    """A job's manifest set is archived, listed, and its JSON document read back."""
    folder = scratch(spark, "archive")
    where = sinks.archive_manifest(_pass(spark, d), {"trip": Q.TRIP, "dest_root": "/nas", "status": "done"}, folder, datetime.datetime(2025, 1, 2, 3, 4, 5))
    files = spark.read.text(f"{where}/manifest.json", wholetext=True).select(F.size(F.from_json("value", "files array<struct<dest_name: string>>")["files"]).cast("long").alias("listed"))
    return inventory.archived_summaries(spark, folder).join(F.broadcast(files))  # one row


# --- tables over time, and the jobs that renew them -----------------------------------------------------------


SCAN = """scan AS (SELECT '/r/' || source || '/' || doc_id || '.jpg' AS full_path, doc_id || '.jpg' AS file_name, n_chars AS file_size, sha256(text) AS sha256, lang FROM documents)"""


def _scan(spark, d) -> DataFrame:
    t = spark_table(spark, d, "documents")
    name = F.concat("doc_id", F.lit(".jpg"))
    return t.select(F.concat(F.lit("/r/"), "source", F.lit("/"), name).alias("full_path"), name.alias("file_name"), F.lit(".jpg").alias("extension"), F.col("n_chars").cast("long").alias("file_size"), F.lit("t1").alias("modified_time"), F.sha2("text", 256).alias("sha256"), "lang")


@query(f"WITH {SCAN} SELECT full_path, CASE WHEN lang = 'en' THEN file_size + 1 ELSE file_size END AS file_size, 'image/jpg' AS mime_type, CASE WHEN lang IN ('en', 'fr') THEN 'D1' ELSE 'D2' END AS device_name, CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 2 END AS first_seen_scan_id, CASE WHEN lang = 'fr' THEN 1 ELSE 2 END AS last_seen_scan_id, sha256 FROM scan")
def job5_ingest(spark, d):
    """A scan of English and French, then one, with each path twice, of all but French in which English has grown."""
    scan = _scan(spark, d)
    files, _ = maintenance.ingest(spark.createDataFrame([], schema.FILES), scan.filter("lang IN ('en', 'fr')").drop("lang"), 1, "D1", "/r", NOW)
    second = scan.filter("lang <> 'fr'").withColumn("file_size", F.expr("IF(lang = 'en', file_size + 1, file_size)")).drop("lang")
    stale = second.withColumns({"file_size": F.lit(0).cast("long"), "modified_time": F.lit("t0")})
    files, _ = maintenance.ingest(files, second.unionByName(stale), 2, "D2", "/r", NOW)
    return files.select("full_path", "file_size", "mime_type", "device_name", "first_seen_scan_id", "last_seen_scan_id", "sha256")


@query(f"WITH {SCAN} SELECT 1 AS id, 'completed' AS status, count(*) FILTER (lang <> 'fr') AS files_seen, count(*) FILTER (lang NOT IN ('en', 'fr')) AS files_added FROM scan")
def job5_run_record(spark, d):
    scan = _scan(spark, d)
    old, _ = maintenance.ingest(spark.createDataFrame([], schema.FILES), scan.filter("lang IN ('en', 'fr')").drop("lang"), 0, "D1", "/r", NOW)
    return maintenance.ingest(old, scan.filter("lang <> 'fr'").drop("lang"), 1, "D2", "/r", NOW)[1].select("id", "status", "files_seen", "files_added")


@query(f"""{duckdb_with('files', 'metadata')}, e AS (SELECT id, full_path, lower(extension) AS x, 'new' || file_size AS make FROM files WHERE file_size % 2 = 0)
SELECT coalesce(m.file_id, e.id) AS file_id, CASE WHEN e.id IS NOT NULL THEN e.make ELSE m.camera_make END AS camera_make, CASE WHEN e.id IS NOT NULL THEN NULL ELSE m.camera_model END AS camera_model,
       CASE WHEN m.file_id IS NULL THEN 'said' ELSE m.capture_date END AS capture_date, CASE WHEN m.file_id IS NULL THEN CASE WHEN x IN {O._in(R.BUCKETS['videos'])} THEN 'video' ELSE 'photo' END END AS media_type FROM metadata m FULL JOIN e ON m.file_id = e.id""")
def dml3_renewed_metadata(spark, d):
    """An extractor speaks of the files of an even size; known files get make, model and raw JSON only."""
    files = spark_table(spark, d, "files")
    said = files.filter("file_size % 2 = 0").select("full_path", F.concat(F.lit("new"), "file_size").alias("camera_make"), F.lit(None).cast("string").alias("camera_model"), F.lit("said").alias("capture_date"), F.lit("{}").alias("raw_metadata_json"))
    return maintenance.ingest_metadata(files, spark_table(spark, d, "metadata"), said, NOW).select("file_id", "camera_make", "camera_model", "capture_date", "media_type")


@query("SELECT count(*) AS moves, sum(size) AS bytes, count(DISTINCT id) AS ids, count(*) FILTER (action = 'trash') AS trashed FROM (SELECT event_id AS id, user_id AS size, 'old' AS action FROM events UNION ALL SELECT 100000000 + doc_id, n_chars, 'trash' FROM documents) x")
def dml7_ledger_append(spark, d):
    ledger = spark_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("size"), F.lit("old").alias("action"), F.lit("t").alias("moved_at"))
    after = maintenance.record_moves(ledger, spark_table(spark, d, "documents").select(F.col("n_chars").cast("long").alias("size")), "trash", NOW)
    return after.agg(F.count("*").alias("moves"), F.sum("size").alias("bytes"), F.count_distinct("id").alias("ids"), F.count_if(F.col("action") == "trash").alias("trashed"))


@query(f"{duckdb_with('files', 'metadata')}, overrides AS (SELECT * FROM (VALUES ('T7 SSD2::Costa Rica 2024', 'Again', 'trips'), ('Past T9::Sony Camera 15', '', 'events'), ('Archive::drone', 'Flights', 'personal')) v(key, trip, category)), {O.ENRICHED}, {O.LABELLED} SELECT trip, category, count(*) AS files FROM labelled GROUP BY ALL")
def dml8_override_put(spark, d):
    """A user's new word on a folder takes the place of the old one, and trips follow."""
    put = maintenance.put_override(spark_table(spark, d, "overrides"), "T7 SSD2::Costa Rica 2024", "Again", "trips")
    return trips.labelled(Q._enriched(spark, d), put).groupBy("trip", "category").agg(F.count("*").alias("files"))


@query("SELECT count(*) AS n, count(deleted_at) AS deleted, count(file_name) AS named, sum(file_size) AS bytes FROM (SELECT n_chars AS file_size, NULL AS deleted_at, NULL AS file_name FROM documents) x")
def dml9_added_columns(spark, d):
    rows = schema.ensure_columns(spark_table(spark, d, "documents").select(F.col("n_chars").cast("long").alias("file_size")), schema.FILES)
    return rows.agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"), F.count("file_name").alias("named"), F.sum("file_size").alias("bytes"))


def _statuses(spark, d, lang: str) -> DataFrame:
    docs = spark_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == lang, "present").when(F.col("n_chars") % 2 == 0, "missing").otherwise("skipped").alias("status"))
    return docs


@query(f"{duckdb_with('files')} SELECT 'some' AS mounted, f.id, CASE WHEN doc.lang <> 'en' AND n_chars % 2 = 0 THEN coalesce(deleted_at, '{NOW}') ELSE deleted_at END AS deleted_at FROM files f JOIN documents doc ON f.id = doc.doc_id UNION ALL SELECT 'none', id, deleted_at FROM files")
def job6_prune(spark, d):
    """What is missing is soft-deleted; nothing is if no file at all is present."""
    files = spark_table(spark, d, "files")
    some, none = (maintenance.prune(files, _statuses(spark, d, lang), NOW) for lang in ("en", "no such language"))
    return some.select(F.lit("some").alias("mounted"), "id", "deleted_at").unionByName(none.select(F.lit("none").alias("mounted"), "id", "deleted_at"))


@query(f"{duckdb_with('files', 'metadata')}, gone AS (SELECT id FROM files WHERE deleted_at < '2025-01-14 12:00:00') SELECT count(*) AS files, (SELECT count(*) FROM metadata WHERE file_id NOT IN (SELECT id FROM gone)) AS metadata FROM files WHERE id NOT IN (SELECT id FROM gone)")
def job7_startup(spark, d):
    """A session that begins ten days after what is purged then was deleted."""
    files, metadata, _ = maintenance.startup(spark_table(spark, d, "files"), spark_table(spark, d, "metadata"), {}, {"trash_retention_days": 10}, datetime.datetime(2025, 1, 24, 12))
    return files.agg(F.count("*").alias("files")).join(F.broadcast(metadata.agg(F.count("*").alias("metadata"))))  # one row each


def _present(spark, d) -> DataFrame:
    return spark_table(spark, d, "files").filter("file_size % 2 = 0").select(F.col("full_path").alias("path"))


def _observations(spark, d) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("ocean", "receipt", "thing"))), F.expr("cast(file_size % 3 + 1 AS int)"))
    labels = F.array(F.struct(label.alias("id"), F.lit(0.5).alias("conf")), F.struct(F.lit("paper").alias("id"), F.lit(0.1).alias("conf")))
    return spark_table(spark, d, "files").select(F.col("full_path").alias("path"), labels.alias("labels"), F.array(F.lit("a"), F.lit("read")).alias("texts"))


CANDIDATES = f"cand AS (SELECT id, full_path, file_size FROM (SELECT f.*, row_number() OVER (PARTITION BY sha256 ORDER BY id) AS k FROM files f LEFT JOIN metadata m ON f.id = m.file_id WHERE {PHOTOS}) x WHERE k = 1 AND file_size % 2 = 0)"
BUCKET_OF = f"CASE file_size % 3 WHEN 1 THEN 'Documents' ELSE {O._case(((' OR '.join(f'contains(label, {O._q(w)})' for w in words), O._q(b)) for b, words in R.BUCKET_KEYWORDS.items()), chr(39) + 'Unsorted' + chr(39))} END"


@query(f"{duckdb_with('files', 'metadata')}, {CANDIDATES}, l AS (SELECT *, CASE file_size % 3 WHEN 0 THEN 'ocean' WHEN 1 THEN 'receipt' ELSE 'thing' END AS label FROM cand) SELECT id AS file_id, full_path, label AS top_label, 0.5::double AS top_conf, 'read' AS text_sample, {BUCKET_OF} AS content_bucket, true AS has_text FROM l")
def clu4_tags_of_observations(spark, d):
    """Labels of 0.15 or more, texts of two letters or more."""
    chosen = jobs.there(inventory.candidates(spark_table(spark, d, "files"), spark_table(spark, d, "metadata")), _present(spark, d))
    return search.tag(chosen, _observations(spark, d)).select("file_id", "full_path", "top_label", "top_conf", "text_sample", "content_bucket", "has_text")


@query(f"{duckdb_with('files', 'metadata', 'tags')}, {CANDIDATES}, l AS (SELECT *, CASE file_size % 3 WHEN 0 THEN 'ocean' WHEN 1 THEN 'receipt' ELSE 'thing' END AS label FROM cand), after AS (SELECT {BUCKET_OF} AS b FROM l UNION ALL SELECT coalesce(nullif(content_bucket, ''), 'Unsorted') FROM tags WHERE file_id NOT IN (SELECT id FROM cand)) SELECT b AS content_bucket, count(*) AS files FROM after GROUP BY b")
def job8_tag_job(spark, d):
    files, old = spark_table(spark, d, "files"), spark_table(spark, d, "tags")
    return search.bucket_histogram(jobs.tag_job(files, spark_table(spark, d, "metadata"), old, _observations(spark, d), _present(spark, d), NOW))


SHOTS = f"shot AS (SELECT id, full_path, file_size FROM (SELECT *, row_number() OVER (PARTITION BY {O.DIR}, lower({O.STEM}) ORDER BY {Q.PRIORITY}, id) AS k FROM enriched WHERE {Q.PRIORITY} IS NOT NULL AND NOT starts_with(file_name, '._')) x WHERE k = 1 AND file_size % 2 = 0)"


@query(O.enriched_with(f", {SHOTS} SELECT source, count(*) AS captions FROM (SELECT 'lexical' AS source FROM shot UNION ALL SELECT 'old' FROM files WHERE id NOT IN (SELECT id FROM shot)) x GROUP BY source"))
def job9_caption_job(spark, d):
    files = spark_table(spark, d, "files")
    old = files.select(F.col("id").alias("file_id"), "full_path", F.lit("x").alias("caption"), F.lit("old").alias("source"))
    return jobs.caption_job(files, old, spark_table(spark, d, "tags"), _present(spark, d), NOW).groupBy("source").agg(F.count("*").alias("captions"))


@query(O.enriched_with(f", {SHOTS} SELECT id AS file_id, full_path, round(length(full_path) / sqrt(length(full_path) * length(full_path) + 1.0), 5) AS x FROM shot"))
def clu3_embed_job(spark, d):
    """Vectors of a backend, here a path's length and 1, brought to unit length."""
    made = jobs.embed_job(spark_table(spark, d, "files"), spark.createDataFrame([], schema.EMBEDDINGS), _present(spark, d), lambda paths: [[float(len(p)), 1.0] for p in paths])
    return made.select("file_id", "full_path", F.round(F.col("vec")[0].cast("double"), 5).alias("x"))


@query(O.enriched_with(f", {SHOTS}, one AS (SELECT *, file_size % 3 AS kind FROM shot), first AS (SELECT kind, min(id) AS f FROM one GROUP BY kind), p AS (SELECT kind, row_number() OVER (ORDER BY f) - 1 AS person_id FROM first) SELECT full_path, person_id FROM one JOIN p USING (kind)"))
def job10_face_job(spark, d):
    """One face a shot, of three people at right angles; they are numbered as they come by file."""
    vec = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(F.col("file_size") % 3 == k, 1.0).otherwise(0.0).cast("float"))
    seen = spark_table(spark, d, "files").select(F.col("full_path").alias("path"), F.array(F.struct(F.array(*map(F.lit, (0.1, 0.1, 0.2, 0.2))).alias("bbox"), vec.alias("vec")), F.struct(F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("array<float>").alias("vec"))).alias("faces"))
    return jobs.face_job(spark_table(spark, d, "files"), seen, _present(spark, d)).select("full_path", "person_id")


@query(f"""WITH b AS (SELECT vec_id AS id, 100.0 + vec_id % 7 * 50 AS wd, 80.0 + vec_id % 5 * 40 AS ht, abs(embedding[1]::double) % 0.7 AS x, abs(embedding[2]::double) % 0.7 AS y, abs(embedding[3]::double) % 0.3 AS w, abs(embedding[4]::double) % 0.3 AS h FROM embeddings),
c AS (SELECT *, greatest(0.0, (x - w * 0.15) * wd) AS cx, greatest(0.0, (1.0 - y - h * 1.15) * ht) AS cy FROM b), e AS (SELECT *, least(w * 1.3 * wd, wd - cx) AS cw, least(h * 1.3 * ht, ht - cy) AS ch FROM c)
SELECT id, round(cx, 4) AS x, round(cy, 4) AS y, round(cw, 4) AS w, round(ch, 4) AS h FROM e WHERE cw >= 8 AND ch >= 8""")
def clu5_face_crops(spark, d):
    side = lambda k, m: F.abs(F.col("embedding")[k].cast("double")) % m
    rows = spark_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("full_path"), F.array(side(0, 0.7), side(1, 0.7), side(2, 0.3), side(3, 0.3)).alias("bbox"))
    sizes = rows.select("full_path", (F.lit(100.0) + F.col("id") % 7 * 50).alias("width"), (F.lit(80.0) + F.col("id") % 5 * 40).alias("height"))
    return jobs.crops(rows, sizes).select("id", *(F.round(c, 4).alias(c) for c in "xywh"))


@query("SELECT relation, rows FROM (VALUES ('embeddings', (SELECT count(*) FROM embeddings)), ('captions', (SELECT count(*) FROM documents)), ('vision_tags', 0), ('faces', 0)) v(relation, rows)")
def agg20_table_counts(spark, d):
    from lumenark.library import Library

    captions = spark_table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("caption"))
    return Library(spark, {"embeddings": spark_table(spark, d, "embeddings"), "captions": captions}).counts()


# --- sources ----------------------------------------------------------------------------------------------------


@query("SELECT url AS path, length(html) AS n FROM pages WHERE page_id % 3 <> 0")
def src7_result_stream(spark, d):
    """Lines of JSON, of which every third is cut off or lacks its path."""
    whole = F.to_json(F.struct(F.col("url").alias("path"), F.length("html").alias("n")))
    broken = F.when(F.col("page_id") % 2 == 0, F.expr("substr(value, 1, 9)")).otherwise(F.lit('{"n": 1}'))
    lines = spark_table(spark, d, "pages").withColumn("value", whole).withColumn("value", F.when(F.col("page_id") % 3 == 0, broken).otherwise(F.col("value")))
    return inventory.extracted(lines, "path string, n long")


@query(f"{duckdb_with('files')} SELECT full_path, CASE WHEN contains(full_path, 'Paris') THEN length(full_path) END AS n FROM files")
def src11_extracted_metadata(spark, d):
    """An extractor that knows the paths of one folder."""
    return inventory.extract_with(spark_table(spark, d, "files"), lambda paths: {p: {"n": len(p)} for p in paths if "Paris" in p}, "n long")


@query(O.labelled_with("SELECT vec_id AS id, label AS block, CASE WHEN f.id IS NULL THEN 'x' || vec_id || '.jpg' ELSE f.file_name END AS file_name, lower(CASE WHEN f.id IS NULL THEN '.jpg' ELSE f.extension END) AS extension FROM embeddings LEFT JOIN labelled f ON f.id = vec_id"))
def prj2_cluster_members(spark, d):
    """What a cluster's row says of a vector: the inventory's name and kind, or those of its own path."""
    about = Q._enriched(spark, d).select("id", F.col("file_name").alias("known_name"), F.lower("extension").alias("known_extension"))
    named = spark_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.concat(F.lit("/v/x"), "vec_id", F.lit(".jpg")).alias("full_path")).join(about, "id", "left")
    return named.select("id", "block", F.coalesce("known_name", S.basename("full_path")).alias("file_name"), F.coalesce("known_extension", F.lower(S.suffix(S.basename("full_path")))).alias("extension"))
