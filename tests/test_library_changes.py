"""The library's methods that change something, and a library read from SQLite files."""

import datetime
import hashlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from lumenark.library import Library
from lumenark.operators import maintenance, staging
from lumenark.sources import schema, sqlite_table

NOW = "2025-03-01 00:00:00"


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)


def test_from_a_folder_to_a_staged_trip(spark, tmp_path):
    root = tmp_path / "T7"
    for name, content in (("Iceland/DCIM/DSC1.ARW", "raw"), ("Iceland/DCIM/DSC1.xmp", "side"), ("Iceland/copy/DSC1.ARW", "raw"), ("Iceland/b.mp4", "film"), ("other/c.jpg", "c")):
        put(root, name, content)
    lib, run = Library(spark, {}).ingest(str(root), "T7", 1, NOW, lambda paths: {p: {"camera_make": "SONY", "capture_date": "2024:09:05"} for p in paths if "Iceland" in p})
    assert run.first()["files_added"] == 5 and lib["files"].count() == 5 and lib["media_metadata"].filter("camera_make = 'SONY'").count() == 4
    shas = {r.full_path.removeprefix(f"{root}/"): r.sha256 for r in lib["files"].collect()}
    assert shas["Iceland/b.mp4"] == hashlib.sha256(b"film").hexdigest()

    staged, facts = lib.stage("Iceland", "/nas/", mode="move", confirm=" move ")
    assert facts.first().asDict() == {"trip": "Iceland", "dest_root": "/nas/Iceland/2024/2024-09", "mode": "move", "verify_hash": True, "dry_run": False}
    assert lib.stage("No such trip!", "/nas")[1].first()["dest_root"] == "/nas/No-such-trip/Undated"
    for bad in ({"mode": "move"}, {"mode": "move", "confirm": "yes"}, {"mode": "steal"}):
        with pytest.raises(ValueError, match="move"):
            lib.stage("Iceland", "/nas", **bad)
    assert lib.stage("Iceland", "/nas", mode="move", dry_run=True)[1].count() == 1
    assert staged["stage_items"].count() == 3 and lib["stage_items"].count() == 0

    tree = {r.dest_rel: (r.depth, r.files, r.bytes) for r in lib.stage_tree("Iceland").collect()}
    leaves = {r.dest_rel: (r.files, r.bytes) for r in lib.stage_preview("Iceland").collect()}
    assert tree[""] == (0, 3, 3 + 4 + 4) and tree["raw"][1] == 3 and all(tree[k][1:] == v for k, v in leaves.items())
    assert tree["raw/images"][0] == 2 and {k for k in tree if k.count("/") == 3} == set(leaves)
    none = {r.dest_rel: r.files for r in lib.stage_tree("No such trip").collect()}
    assert none == {"": 0}

    paths = staged["stage_items"].select(F.explode("candidates.path").alias("path")).distinct().withColumn("used_path", F.col("path"))
    copies = staged["stage_items"].select(F.explode("candidates.path").alias("used_path"), "size", F.when(F.col("dest_name") == "b.mp4", "wrong").otherwise(F.col("sha256")).alias("sha256"))
    nothing = spark.createDataFrame([], "dest_rel string, dest_name string, size long, sha256 string")
    after = staged.stage_continue(paths, copies, nothing)
    states = lambda lib: {r.dest_name: r.state for r in lib["stage_items"].collect()}
    assert states(after) == {"DSC1.ARW": "verified", "DSC1.xmp": "verified", "b.mp4": "error"}
    assert states(after.stage_retry())["b.mp4"] == "pending"
    assert states(after.stage_retry().stage_skip_absent())["b.mp4"] == "skipped"


def row(i, path, deleted=None):
    return (i, path, path.rsplit("/", 1)[-1], ".jpg", 5, "t", "t", f"h{i}", "image/jpg", "/Volumes/A", "A", 1, 1, "t", deleted)


@pytest.fixture
def lib(spark):
    files = spark.createDataFrame([row(i, f"/Volumes/A/x/{i}.jpg") for i in range(30)] + [row(40, "/Volumes/A/x/40.jpg", "2025-01-01 00:00:00"), row(41, "/Volumes/A/x/41.jpg", "2025-02-27 00:00:00")], schema.FILES)
    present = spark.createDataFrame([(f"/Volumes/A/x/{i}.jpg", 5 if i % 10 == 0 else None, None, True) for i in range(29)], schema.PRESENT_PATHS)
    volumes = spark.createDataFrame([("A", "/Volumes/A", "u1", ["x"]), ("B", "/Volumes/B", "u2", [])], schema.VOLUMES)
    side = {n: spark.createDataFrame([(i, f"/Volumes/A/x/{i}.jpg") for i in (0, 40, 41)], "file_id long, full_path string") for n in ("vision_tags", "captions", "embeddings")}
    return Library(spark, {"files": files, "present_paths": present, "volumes": volumes, **{n: schema.ensure_columns(t, s) for (n, t), s in zip(side.items(), (schema.VISION_TAGS, schema.CAPTIONS, schema.EMBEDDINGS))}})


def test_reconcile_prune_restore_purge(spark, lib):
    report = lib.reconcile_report().first()
    assert (report.present, report.missing, report.skipped, report.checked) == (3, 26, 1, 30)
    assert report.missing_sample == [f"/Volumes/A/x/{i}.jpg" for i in range(29) if i % 10][:20]
    pruned = lib.prune(NOW)
    assert pruned["files"].filter(F.col("deleted_at") == NOW).count() == 26 and lib["files"].filter(F.col("deleted_at") == NOW).count() == 0
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    back = pruned.restore(ids)
    assert back["files"].filter("id IN (1, 2) AND deleted_at IS NULL").count() == 2
    gone = pruned.purge(ids)
    assert gone["files"].count() == 30 and gone["files"].filter("id IN (1, 2)").count() == 0
    expired = lib.purge(now=datetime.datetime(2025, 3, 1))
    assert expired["files"].filter("id >= 40").select("id").first()[0] == 41 and {r.file_id for r in expired["captions"].collect()} == {0, 41}
    for bad in ({}, {"ids": ids, "now": datetime.datetime(2025, 3, 1)}):
        with pytest.raises(ValueError, match="ids or now"):
            lib.purge(**bad)
    nobody = lib.changed(present_paths=lib["present_paths"].filter("size IS NULL"))
    assert nobody.prune(NOW)["files"].filter(F.col("deleted_at") == NOW).count() == 0
    none = lib.changed(files=lib["files"].limit(0)).reconcile_report().first()
    assert (none.checked, none.missing_sample) == (0, [])


def test_tags_captions_vectors_faces_overrides_drives(spark, lib):
    seen = spark.createDataFrame([("/Volumes/A/x/0.jpg", [("Receipt", 0.9)], ["total"])], "path string, labels array<struct<id: string, conf: double>>, texts array<string>")
    tagged = lib.tag(seen, NOW)
    assert tagged["vision_tags"].filter("file_id = 0").first().content_bucket == "Documents" and {r.file_id for r in tagged["vision_tags"].collect()} == {0, 10, 20, 40, 41}
    captioned = tagged.caption(NOW)
    assert "Receipt" in captioned["captions"].filter("file_id = 0").first().caption
    embedded = lib.embed(lambda paths: [[1.0, 0.0] for _ in paths], part="/x/1")
    assert {r.file_id for r in embedded["embeddings"].filter("vec IS NOT NULL").collect()} == {10}
    faces = spark.createDataFrame([("/Volumes/A/x/0.jpg", [([0.1] * 4, [1.0, 0.0])]), ("/Volumes/A/x/10.jpg", [([0.1] * 4, [1.0, 0.0])])], "path string, faces array<struct<bbox: array<double>, vec: array<float>>>")
    assert lib.find_faces(faces).people().first().size == 2
    moved = lib.override("A::x", "Somewhere", "trips")
    assert moved.trips().first().trip == "Somewhere" != lib.trips().first().trip
    assert moved.override("A::x", "Elsewhere", "trips").trips().first().trip == "Elsewhere"
    mapped = lib.map_drive("Old", "/Volumes/B")
    assert mapped["learned_drives"].first().asDict() == {"device_name": "Old", "mount": "/Volumes/B", "uuid": "u2"} and lib.map_drive("Old", "/nowhere")["learned_drives"].count() == 0
    totals, members = lib.changed(embeddings=spark.createDataFrame([(0, "/Volumes/A/x/0.jpg", [1.0, 0.0]), (10, "/Volumes/A/x/10.jpg", [1.0, 0.0]), (11, "/Volumes/A/x/11.jpg", [0.0, 1.0])], schema.EMBEDDINGS)).near_duplicate_report()
    assert totals.first().asDict() == {"duplicates": 1, "reclaim_bytes": 5} and {r.id for r in members.collect()} == {0, 10}


def test_upsert_takes_one_row_of_a_key(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (2, "d"), (3, None), (3, "e"), (None, "f"), (None, "g")], "k long, v string")
    got = [tuple(r) for r in maintenance.upsert(old, new, "k").collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (2, "d"), (3, "e"), (None, "f"), (None, "g")], key=str)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "in ventory.sqlite3")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE files (id INTEGER PRIMARY KEY, full_path TEXT, file_size BIGINT, score REAL, "odd name" VARCHAR(3), body BLOB, loose)')
        db.executemany("INSERT INTO files VALUES (?, ?, ?, ?, ?, ?, ?)", [(k * 3 - 20, f"/p/é{k}" if k % 7 else None, k if k % 5 else "no number", k / 4 if k % 3 else k, "x", b"\x00\xff", k) for k in range(1, 500)])
        db.execute("CREATE TABLE empty (a INTEGER)")
    df = sqlite_table.read(spark, path, "files", slices=5)
    assert df.dtypes == [("id", "bigint"), ("full_path", "string"), ("file_size", "bigint"), ("score", "double"), ("odd name", "string"), ("body", "binary"), ("loose", "string")]
    assert df.rdd.getNumPartitions() == 5
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 499
    for k in range(1, 500):
        r = rows[k * 3 - 20]
        assert (r.full_path, r.file_size, r.score, r["odd name"], bytes(r.body), r.loose) == (f"/p/é{k}" if k % 7 else None, k if k % 5 else None, float(k / 4 if k % 3 else k), "x", b"\x00\xff", str(k))
    assert sqlite_table.read(spark, path, "empty").count() == 0
    with pytest.raises(Exception, match="no table nope"):
        sqlite_table.read(spark, path, "nope").count()
    lib = Library(spark, sqlite_table.tables(spark, {"files": (path, "files")}))
    assert lib["files"].count() == 499
