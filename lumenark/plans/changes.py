"""Queries over folders, tables by key, indexes and summaries that are kept; registered like those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenark.functions import rules as R
from lumenark.functions import scalar as S
from lumenark.library import Library
from lumenark.operators import drives, grams, keyed, maintenance, places, sinks, staging, topk, views
from lumenark.operators import jobs as run_jobs
from lumenark.plans import jobs
from lumenark.plans import oracle as O
from lumenark.plans import queries as Q
from lumenark.plans.demo import DUCKDB, TABLES, duckdb_with, spark_table
from lumenark.plans.queries import query
from lumenark.sources import folder as media_folder
from lumenark.sources import inventory, schema
from lumenark.sources.durable import scratch

NOW = Q.NOW
MEDIA = O._in(media_folder.INGEST_EXTENSIONS)


def _tree(spark, d) -> str:
    """A folder with the documents as files under the inventory's paths."""
    folder = scratch(spark, "tree")
    rows = spark_table(spark, d, "files").join(spark_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    sinks.put_files(rows.select(F.col("full_path").alias("path"), F.col("text").alias("content")), folder)
    return folder


def _below(folder: str) -> F.Column:
    """A file's path below the folder, which may be named with or without its file system."""
    plain = folder.removeprefix("file://").removeprefix("file:")
    return F.expr(f"substring(full_path, instr(full_path, '{plain}') + {len(plain)})")


# --- folders -------------------------------------------------------------------------------------------------


@query(f"{duckdb_with('files')} SELECT full_path, file_name, lower(extension) AS extension, octet_length(encode(text)) AS file_size, sha256(text) AS sha256 FROM files JOIN documents ON id = doc_id WHERE lower(extension) IN {MEDIA}")
def src4_folder_tree(spark, d):
    folder = _tree(spark, d)
    return inventory.walk(spark, folder, content=True).select(_below(folder).alias("full_path"), "file_name", "extension", "file_size", "sha256")


@query(f"{duckdb_with('files')}, x AS (SELECT *, lower(extension) AS e FROM files) SELECT full_path FROM (SELECT *, row_number() OVER (PARTITION BY {O.DIR}, lower({O.STEM}) ORDER BY {Q.PRIORITY}) AS k FROM x WHERE {Q.PRIORITY} IS NOT NULL AND NOT starts_with(file_name, '._')) y WHERE k = 1")
def src5_folder_shots(spark, d):
    folder = _tree(spark, d)
    return inventory.folder_shots(spark, folder).select(_below(folder).alias("full_path"))


@query(f"{duckdb_with('files')} SELECT full_path FROM files WHERE lower(extension) IN {O._in(R.BUCKETS['photos'])} AND NOT starts_with(file_name, '._') ORDER BY full_path LIMIT 100")
def src6_folder_photos(spark, d):
    folder = _tree(spark, d)
    return inventory.folder_photos(spark, folder, 100).select(_below(folder).alias("full_path"))


@query(f"{duckdb_with('files')} SELECT full_path, octet_length(encode(text)) AS file_size, sha256(text) AS sha256, CASE WHEN lower(extension) IN {O._in(R.BUCKETS['videos'])} THEN 'video' ELSE 'photo' END AS media_type, 'made' AS make FROM files JOIN documents ON id = doc_id WHERE lower(extension) IN {MEDIA}")
def job5_folder_ingest(spark, d):
    """A folder taken into an empty library, with an extractor."""
    folder = _tree(spark, d)
    lib, _ = Library(spark, {}).ingest(folder, "T7", 1, NOW, lambda paths: {p: {"camera_make": "made"} for p in paths}, "camera_make string")
    both = lib["files"].join(lib["media_metadata"].select("file_id", "media_type", F.col("camera_make").alias("make")), F.col("id") == F.col("file_id"))
    return both.select(_below(folder).alias("full_path"), "file_size", "sha256", "media_type", "make")


@query(f"{duckdb_with('files')} SELECT full_path, ('0x' || substr(sha1(full_path), 1, 15))::BIGINT AS path_id FROM files")
def scl23_path_ids(spark, d):
    return spark_table(spark, d, "files").select("full_path", S.path_id("full_path").alias("path_id"))


# --- state, kept relations, tables found ------------------------------------------------------------------------


@query("SELECT count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS bytes, min(source) AS trip, NULL::VARCHAR AS missing, true AS corrupt FROM documents")
def src12_state_file(spark, d):
    """A state file written and loaded; beside it one that is cut off, whose fields are null."""
    folder, fields = scratch(spark, "state"), "files long, bytes long, trip string, missing string"
    told = spark_table(spark, d, "documents").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"), F.min("source").alias("trip"))
    told.coalesce(1).write.json(f"{folder}/whole")
    told.select(F.expr("substr(to_json(struct(*)), 1, 9)").alias("value")).coalesce(1).write.text(f"{folder}/cut")
    cut = inventory.load_state(spark, f"{folder}/cut", fields).select(F.col("files").isNull().alias("corrupt"))
    return inventory.load_state(spark, f"{folder}/whole", fields).join(F.broadcast(cut))  # one row each


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY lang")
def snk9_kept_relation(spark, d):
    """A relation built once for a version and read from then on."""
    folder = scratch(spark, "kept")
    build = lambda: spark_table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))
    sinks.kept(spark, folder, "1", build)
    return sinks.kept(spark, folder, "1", lambda: build().limit(0))


@query("SELECT count(*) AS files, max(doc_id) AS last FROM documents")
def src1_located_table(spark, d):
    """The first candidate that exists; the variable's name is one that nothing sets."""
    place = inventory.locate(spark, [f"{d}/none.parquet", f"{d}/documents.parquet", f"{d}/pages.parquet"], "LUMENARK_NOWHERE")
    return spark.read.parquet(place).agg(F.count("*").alias("files"), F.max("doc_id").alias("last"))


@query(f"SELECT lang, {R.RETENTION_DAYS + 5} AS days, count(*) AS n FROM documents GROUP BY lang")
def dml12_settings(spark, d):
    """Settings as saved: defaults, what is stored, changes; a name that is unknown is passed over."""
    saved = maintenance.saved_settings({"trash_retention_days": 1, "x": 2}, {"trash_retention_days": R.RETENTION_DAYS + 5, "unknown": 1})
    assert saved == {"trash_retention_days": R.RETENTION_DAYS + 5, "verify_hash": True}
    return spark_table(spark, d, "documents").groupBy("lang").agg(F.lit(saved["trash_retention_days"]).alias("days"), F.count("*").alias("n"))


# --- tables by key ------------------------------------------------------------------------------------------------

KEYED = T.StructType([T.StructField("full_path", T.StringType()), T.StructField("id", T.LongType()), T.StructField("file_size", T.LongType()), T.StructField("seen", T.IntegerType()), T.StructField("deleted_at", T.StringType())])


@query(f"""WITH old AS (SELECT '/' || source || '/' || doc_id AS full_path, doc_id AS id, n_chars AS file_size, lang FROM documents), gone AS (SELECT doc_id AS id FROM labels WHERE toxic = 1)
SELECT full_path, id, CASE WHEN lang = 'fr' THEN file_size + 1 ELSE file_size END AS file_size, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS seen, CASE WHEN id IN (SELECT id FROM gone) THEN '{NOW}' END AS deleted_at FROM old WHERE lang <> 'de'
UNION ALL SELECT '/new/' || vec_id, vec_id, 5, 2, NULL FROM embeddings""")
def dml2_keyed_table(spark, d):
    """A table by path: filled, French documents seen again and vectors new, German ones deleted, toxic ones marked."""
    table = keyed.KeyedTable(spark, scratch(spark, "keyed"), "full_path", KEYED, by=S.dirname, parts=8, buckets=4)
    none = F.lit(None).cast("string").alias("deleted_at")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "doc_id").alias("full_path")
    docs = spark_table(spark, d, "documents")
    one = lambda rows, size, seen: rows.select(path, F.col("doc_id").alias("id"), size.cast("long").alias("file_size"), F.lit(seen).alias("seen"), none)
    table.upsert(one(docs, F.col("n_chars"), 1))
    new = spark_table(spark, d, "embeddings").select(F.concat(F.lit("/new/"), "vec_id").alias("full_path"), F.col("vec_id").alias("id"), F.lit(5).cast("long").alias("file_size"), F.lit(2).alias("seen"), none)
    table.upsert(one(docs.filter("lang = 'fr'"), F.col("n_chars") + 1, 2).unionByName(new), ("file_size", "seen"))
    table.delete(docs.filter("lang = 'de'").select(path))
    table.mark(docs.join(spark_table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id").select(path), "deleted_at", F.lit(NOW))
    return table.read()


# --- summaries kept up to date ----------------------------------------------------------------------------------------


def _two_states(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as files before and after labelled ones went or changed, and the keys of those."""
    before = Q._documents(spark, d).select("id", "full_path", "device_name", "sha256", "file_size")
    labels = spark_table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic", "quality")
    after = before.join(labels, "id", "left").filter("coalesce(toxic, 0) = 0").withColumn("file_size", F.when(F.col("quality") == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))).drop("toxic", "quality")
    return before, after, before.join(labels, "id", "left_semi")


AFTER = "SELECT doc_id, source AS device_name, text, n_chars + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS file_size FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0"


@query(f"""WITH f AS ({AFTER}), g AS (SELECT text, count(*) AS n, sum(file_size) AS t, min(file_size) AS o FROM f GROUP BY text)
SELECT (SELECT count(*) FROM f) AS total_files, (SELECT sum(file_size) FROM f)::BIGINT AS total_bytes, count(*) FILTER (n > 1) AS dup_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS dup_files, coalesce(sum(t - o) FILTER (n > 1), 0)::BIGINT AS reclaim_bytes, count(*) AS unique_files, sum(o)::BIGINT AS unique_bytes FROM g""")
def agg2_kept_summaries(spark, d):
    """Totals, duplicates and unique bytes of the second state, from those of the first and what changed."""
    before, after, touched = _two_states(spark, d)
    now = views.update(views.build(before), before, after, touched)
    return now.totals.join(F.broadcast(now.duplicates)).join(F.broadcast(now.unique))  # one row each


@query(f"SELECT device_name, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM ({AFTER}) f GROUP BY device_name")
def agg4_kept_drive_usage(spark, d):
    before, after, touched = _two_states(spark, d)
    return views.update(views.build(before), before, after, touched).drive_usage()


# --- indexes ----------------------------------------------------------------------------------------------------------------

ASKED = "SELECT item_id AS query_id, array_to_string(string_split_regex(trim(text), '\\s+')[1:2], ' ') || CASE item_id % 3 WHEN 0 THEN ' th' WHEN 1 THEN ' e' ELSE '' END AS query FROM benchmark"


def _asked(spark, d) -> DataFrame:
    """Of each benchmark item the first two words, and two letters or one."""
    two = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), " ")
    tail = F.when(F.col("item_id") % 3 == 0, " th").when(F.col("item_id") % 3 == 1, " e").otherwise("")
    return spark_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(two, tail).alias("query"))


@query(f"WITH q AS ({ASKED}), w AS (SELECT query_id, string_split_regex(lower(query), '\\s+') AS words FROM q), hit AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS k FROM w, documents WHERE len(list_filter(words, lambda x: NOT contains(lower(text), x))) = 0) SELECT query_id, doc_id FROM hit WHERE k <= 60")
def txt1_index_search(spark, d):
    """Captions that hold all words of a query, for a table of queries."""
    rows = spark_table(spark, d, "documents").select("doc_id", F.col("text").alias("caption"))
    return grams.captions(grams.index(rows, "doc_id", "caption"), rows, _asked(spark, d), key="doc_id").select("query_id", "doc_id")


@query(f"{duckdb_with('files', 'tags')}, q AS ({ASKED}), w AS (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[a-z0-9%$.]+'), lambda t: length(t) >= 2 AND t NOT IN {O._in(R.SEARCH_STOP)}) AS words FROM q), h AS (SELECT full_path, lower(coalesce(text_sample, '') || ' ' || coalesce(top_label, '') || ' ' || coalesce(content_bucket, '')) AS hay FROM tags), s AS (SELECT query_id, full_path, len(list_filter(words, lambda x: contains(hay, x))) AS score FROM w, h), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, full_path) AS k FROM s WHERE score > 0) SELECT query_id, full_path, score::INT AS score FROM k WHERE k <= 80")
def txt2_index_search(spark, d):
    tags = spark_table(spark, d, "tags")
    return grams.keywords(grams.index(tags, "full_path", grams.hay()), tags, _asked(spark, d)).select("query_id", "full_path", "score")


@query("WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id DESC) AS k FROM s) SELECT query_id, id, round(score, 4) AS score FROM k WHERE k <= 10")
def srt1_many_queries(spark, d):
    """The ten most alike of all vectors for each one whose id is divisible by 20."""
    vectors = Q._vectors(spark, d).select("id", "vec")
    asked = vectors.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    return topk.search(topk.build(vectors), asked, 10).select("query_id", F.col("key").alias("id"), F.round("score", 4).alias("score"))


@query(O.labelled_with("SELECT id, place FROM near"))
def jn2_gazetteer_join(spark, d):
    """The nearest place by cells, with the rules' gazetteer as a table."""
    gazetteer = spark.createDataFrame([(i, *p) for i, p in enumerate(R.PLACES)], "i int, place string, lat double, lon double")
    at = spark_table(spark, d, "metadata").select(F.col("file_id").alias("id"), "gps_latitude", "gps_longitude")
    files = spark_table(spark, d, "files").filter("deleted_at IS NULL").select("id").join(at, "id")
    return places.nearest(files, gazetteer).filter("place IS NOT NULL").select("id", "place")


# --- reports with their totals --------------------------------------------------------------------------------------------------


@query(O.labelled_with(f", {O.LAYOUT}, t AS (SELECT *, row_number() OVER (PARTITION BY {O.KEY} ORDER BY {O.RANK}, length(full_path), id) AS k FROM laid WHERE trip = '{Q.TRIP}'), leaf AS (SELECT dest_rel, count(*) AS files, sum(file_size) AS bytes, string_split(dest_rel, '/') AS p FROM t WHERE k = 1 AND dest_rel IS NOT NULL GROUP BY dest_rel), level AS (SELECT unnest(range(0, len(p) + 1)) AS depth, p, files, bytes FROM leaf) SELECT array_to_string(p[1:depth], '/') AS dest_rel, depth::INT AS depth, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM level GROUP BY ALL"))
def agg12_preview_totals(spark, d):
    return staging.preview_tree(Q._labelled(spark, d), Q.TRIP)


@query("WITH s AS (SELECT doc_id AS id, '/d/' || doc_id AS full_path, CASE WHEN lang = 'en' THEN 'present' WHEN n_chars % 2 = 0 THEN 'missing' ELSE 'skipped' END AS status FROM documents) SELECT count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS checked, array_to_string((list(full_path ORDER BY id) FILTER (status = 'missing'))[1:20], '|') AS missing_sample FROM s")
def agg21_reconcile_report(spark, d):
    docs = spark_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/d/"), "doc_id").alias("full_path"), F.when(F.col("lang") == "en", "present").when(F.col("n_chars") % 2 == 0, "missing").otherwise("skipped").alias("status"))
    return maintenance.reconcile_report(docs.drop("status"), docs.select("id", "status")).withColumn("missing_sample", F.array_join("missing_sample", "|"))


@query("SELECT lang AS trip, '/nas/' || lang || '/Undated' AS dest_root FROM (SELECT DISTINCT lang FROM documents) x WHERE lang = 'en'")
def job1_dest_root(spark, d):
    """Documents of a language as a trip without a date."""
    named = spark_table(spark, d, "documents").select(F.col("lang").alias("trip"), F.concat(S.slug("lang"), F.lit("/Undated")).alias("nas_folder")).distinct()
    return staging.dest_root(named, "en", "/nas/").select(F.lit("en").alias("trip"), "dest_root")


@query(f"{Q.COMPONENTS}, f AS (SELECT doc_id, n_chars, source FROM documents), m AS (SELECT c.id, c.component, coalesce(n_chars, 0) AS size, count(*) OVER (PARTITION BY component) AS members, row_number() OVER (PARTITION BY component ORDER BY coalesce(id % 7, 0) DESC, coalesce(n_chars, 0) DESC, c.id) AS place FROM comp c LEFT JOIN f ON f.doc_id = c.id) SELECT id, component, size, members, place FROM m WHERE members > 1")
def prj2_near_duplicates(spark, d):
    """Library.near_duplicates() over files that are labelled with the vectors' blocks as trips, with their pixels."""
    rows = spark_table(spark, d, "embeddings").join(spark_table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"), "left")
    path = F.concat(F.lit("/Volumes/A/"), "label", F.lit("/"), "vec_id", F.lit(".jpg"))
    files = rows.filter("doc_id IS NOT NULL").select(F.col("vec_id").alias("id"), path.alias("full_path"), F.concat("vec_id", F.lit(".jpg")).alias("file_name"), F.lit(".jpg").alias("extension"), F.col("n_chars").cast("long").alias("file_size"), F.lit("A").alias("device_name"), F.lit("/Volumes/A").alias("root_path"))
    metadata = rows.filter("doc_id IS NOT NULL").select(F.col("vec_id").alias("file_id"), (F.col("vec_id") % 7).alias("image_width"), F.lit(1).cast("long").alias("image_height"))
    overrides = spark_table(spark, d, "embeddings").select(F.concat(F.lit("A::"), "label").alias("key"), F.concat(F.lit("block "), "label").alias("trip"), F.lit("trips").alias("category")).distinct()
    vectors = rows.select(F.col("vec_id").alias("file_id"), path.alias("full_path"), F.col("embedding").alias("vec"))
    lib = Library(spark, {"files": schema.ensure_columns(files, schema.FILES), "media_metadata": schema.ensure_columns(metadata, schema.METADATA), "overrides": overrides, "embeddings": vectors})
    return lib.near_duplicates(Q.ALIKE).select("id", "component", F.coalesce("size", F.lit(0)).alias("size"), "members", "place")


# --- whole rows of jobs and exports -------------------------------------------------------------------------------------------------


@query(f"{duckdb_with('files', 'metadata', 'tags')}, {jobs.CANDIDATES}, l AS (SELECT *, CASE file_size % 3 WHEN 0 THEN 'ocean' WHEN 1 THEN 'receipt' ELSE 'thing' END AS label FROM cand) SELECT id AS file_id, full_path, label AS top_label, {jobs.BUCKET_OF} AS content_bucket, 'read' AS text_sample, '{NOW}' AS tagged_at FROM l UNION ALL SELECT file_id, full_path, top_label, content_bucket, text_sample, NULL FROM tags WHERE file_id NOT IN (SELECT id FROM cand)")
def job8_tag_rows(spark, d):
    files, old = spark_table(spark, d, "files"), spark_table(spark, d, "tags")
    return run_jobs.tag_job(files, spark_table(spark, d, "metadata"), old, jobs._observations(spark, d), jobs._present(spark, d), NOW).select("file_id", "full_path", "top_label", "content_bucket", "text_sample", "tagged_at")


@query(O.enriched_with(f", {jobs.SHOTS}, tags AS ({TABLES['tags'].format(**DUCKDB)}), p AS (SELECT *, regexp_extract(full_path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(regexp_replace(full_path, '/+[^/]*$', ''), '([^/]*)$', 1), '[_-]', ' ', 'g') AS parent FROM tags), w AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(name, '^(.+)\\.[^.]+$', '\\1')), '[\\s_\\-.]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN {O._in(R.CAPTION_STOP)}) AS words FROM p), c AS (SELECT file_id, array_to_string(list_filter(list_concat([coalesce(content_bucket, ''), replace(coalesce(top_label, ''), '_', ' '), parent], words[1:6], [substr(coalesce(text_sample, ''), 1, 80)]), lambda x: x <> ''), ', ') AS caption FROM w) SELECT id AS file_id, full_path, caption, 'lexical' AS source, '{NOW}' AS created_at FROM shot JOIN c ON id = file_id UNION ALL SELECT id, full_path, 'x', 'old', NULL FROM files WHERE id NOT IN (SELECT id FROM shot)"))
def job9_caption_rows(spark, d):
    files = spark_table(spark, d, "files")
    old = files.select(F.col("id").alias("file_id"), "full_path", F.lit("x").alias("caption"), F.lit("old").alias("source"))
    return run_jobs.caption_job(files, old, spark_table(spark, d, "tags"), jobs._present(spark, d), NOW).select("file_id", "full_path", "caption", "source", "created_at")


WRONG = "CASE size_bytes % 6 WHEN 1 THEN 'source could not be read' WHEN 2 THEN 'size mismatch after copy (expected ' || size_bytes || ', got ' || (size_bytes + 1) || ')' ELSE 'sha256 mismatch after copy' END"
FIELDS = " || ',' || ".join("'\"' || replace(coalesce(cast({} AS varchar), ''), '\"', '''') || '\"'".format({"error": WRONG, "resolved_source_path": "NULL", "copied_at": "NULL"}.get(c, c)) for c in R.MANIFEST_COLUMNS)


@query(O.labelled_with(f"{Q.ITEMS}, f AS ({jobs.MANIFEST}) SELECT {FIELDS} AS line FROM f WHERE copy_status = 'error'"))
def snk3_error_fields(spark, d):
    """All 18 fields of the failed items' CSV lines."""
    return sinks.manifest_lines(staging.manifest(jobs._pass(spark, d), "/nas").filter("copy_status = 'error'"))


@query("WITH w AS (SELECT source AS device_name, list(DISTINCT lang || n_chars % 7) AS top FROM documents GROUP BY source), v AS (SELECT '/v' || doc_id % 50 AS mount, 'u' || doc_id % 50 % 3 AS uuid, list(DISTINCT lang || n_chars % 7) AS top FROM documents GROUP BY doc_id % 50) SELECT device_name, mount, uuid, len(list_intersect(w.top, v.top)) / len(w.top) AS score FROM w, v WHERE len(list_intersect(w.top, v.top)) / len(w.top) >= 0.5")
def jn7_all_matches(spark, d):
    """Sources as drives, fifty shares of the documents as volumes, language and length as folder names."""
    docs = spark_table(spark, d, "documents").withColumn("folder", F.concat("lang", F.col("n_chars") % 7))
    share = F.col("doc_id") % 50
    volumes = docs.groupBy(F.concat(F.lit("/v"), share).alias("mount"), F.concat(F.lit("u"), share % 3).alias("uuid")).agg(F.collect_set("folder").alias("top"))
    return drives.matches(docs.groupBy(F.col("source").alias("device_name")).agg(F.collect_set("folder").alias("top")), volumes)
