import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenark.operators import clusters, dedupe, drives, maintenance, search, sinks, staging
from lumenark.sources import inventory, schema

FILES = "id long, sha256 string, device_name string, full_path string, file_name string, file_size long"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def test_dedupe_plan(spark):
    df = files(spark, [(1, "AAA", "T7 SSD2", "/a/1.arw", "1.arw", 5), (2, "AAA", "Past T9", "/b/1.arw", "1.arw", 5), (3, "AAA", "T7 SSD1", "/c/1.arw", "1.arw", 5), (4, "BBB", "T7 SSD2", "/a/2.arw", "2.arw", 7)])
    got = {r.id: (r.decision, r.keep_path) for r in dedupe.plan(df).collect()}
    assert got == {1: ("KEEP", "/a/1.arw"), 2: ("DELETE", "/a/1.arw"), 3: ("DELETE", "/a/1.arw")}
    assert [tuple(r) for r in dedupe.plan_summary(dedupe.plan(df)).orderBy("device_name").collect()] == [("Past T9", 1, 5), ("T7 SSD1", 1, 5)]
    line = sinks.plan_lines(dedupe.plan(df)).filter("line like 'KEEP%'").first()[0]
    assert line == 'KEEP,AAA,"1.arw",T7 SSD2,5,"/a/1.arw","/a/1.arw"'


def test_no_plan_without_hashes(spark):
    df = files(spark, [(1, None, "a", "/1", "1", 1), (2, None, "a", "/2", "2", 1), (3, "", "a", "/3", "3", 1), (4, "", "a", "/4", "4", 1)])
    assert dedupe.plan(df).count() == 0
    assert tuple(dedupe.duplicate_groups(df).first()) == (0, 0, 0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None, ""]), st.sampled_from(["T7 SSD2", "Past T9", "q"]), st.integers(1, 3)), max_size=12))
def test_one_keep_per_hash(spark, rows):
    df = files(spark, [(i, h, d, "/" + "p" * n, "f", 1) for i, (h, d, n) in enumerate(rows)])
    plan = dedupe.plan(df).collect()
    for h in {r.sha256 for r in plan}:
        own = [r for r in plan if r.sha256 == h]
        kept = [r for r in own if r.decision == "KEEP"]
        assert len(kept) == 1 and len(own) == sum(x[0] == h for x in rows) and all(r.keep_path == kept[0].full_path for r in own)


LAYOUT = "id long, full_path string, file_name string, extension string, stage string, device string, orientation string, bucket string"


def lay(spark, **change):
    from lumenark.functions import scalar as S

    row = {"id": 1, "full_path": "/r/x.arw", "file_name": "x.arw", "extension": ".arw", "stage": "original", "device": "Sony", "orientation": "Horizontal"} | change
    df = spark.createDataFrame([tuple(row.values())], LAYOUT.replace(", bucket string", "")).withColumn("bucket", S.bucket("extension"))
    parents = spark.createDataFrame([(2, "/r/A.ARW", "A.ARW", ".arw", "edited", "Sony", "Vertical", "raw"), (3, "/r/A.jpg", "A.jpg", ".jpg", "original", "Sony", "Vertical", "photos")], LAYOUT)
    return staging.layout(df, parents).first().dest_rel


def test_layout(spark):
    assert lay(spark) == "raw/images/Sony/Horizontal"
    assert lay(spark, extension=".mp4", stage="edited", device="Drone", orientation="Vertical") == "edited/videos/Drone/Vertical"
    assert lay(spark, extension=".jpg") == "raw/images/Sony/Horizontal"
    assert lay(spark, extension=".thm", file_name="a.thm") is None and lay(spark, file_name="._a.arw") is None and lay(spark, file_name=".DS_Store") is None
    assert lay(spark, extension=".xmp", file_name="b.xmp", full_path="/r/b.xmp") == "_Sidecars"
    assert lay(spark, extension=".xmp", file_name="a.ARW.xmp", full_path="/r/a.ARW.xmp") == "edited/images/Sony/Vertical"
    assert lay(spark, extension=".xml", file_name="a.xml", full_path="/r/a.xml") == "_Sidecars"
    assert lay(spark, extension=".zzz", device=None) == "raw/other/Unknown"


def items(spark, *rows):
    names = schema.STAGE_ITEMS.names
    return spark.createDataFrame([tuple(({"state": "pending", "dest_rel": "raw", "size": 10} | r).get(n) for n in names) for r in rows], schema.STAGE_ITEMS)


def test_job_states_and_removals(spark):
    c = lambda *paths: [("D" + p[1], p, "") for p in paths]
    job = items(
        spark, {"sha256": "h1", "dest_name": "a", "candidates": c("/s1", "/s2", "/nas/raw/a", "/gone")}, {"sha256": "h2", "dest_name": "b", "candidates": c("/s3")}, {"sha256": "h3", "dest_name": "c", "candidates": c("/gone")},
        {"sha256": "__nh4", "dest_name": "d", "candidates": c("/s4")}, {"sha256": "h5", "dest_name": "e", "candidates": c("/s5")}, {"sha256": "h6", "dest_name": "f", "candidates": c("/s5"), "state": "copying"},
    )
    sources = spark.createDataFrame([(p, p) for p in ("/s1", "/s2", "/nas/raw/a", "/s3", "/s4", "/s5")], "path string, used_path string")
    copies = spark.createDataFrame([("/s1", 10, "h1"), ("/s3", 9, "h2"), ("/s4", 10, "any"), ("/s5", 10, "bad")], "used_path string, size long, sha256 string")
    there = spark.createDataFrame([("raw", "f", 10, "h6")], "dest_rel string, dest_name string, size long, sha256 string")
    done = staging.run_pass(job, sources, copies, there, True)
    got = {r.sha256: (r.state, r.verify_status) for r in done.collect()}
    assert got == {"h1": ("verified", "sha256-verified"), "h2": ("error", "size-mismatch"), "h3": ("pending", None), "__nh4": ("verified", "size-verified"), "h5": ("error", "sha256-mismatch"), "h6": ("verified", "sha256-verified (resumed)")}
    removed = staging.planned_removals(done, sources, "/nas").orderBy("source_path").collect()
    assert [(r.sha256, r.source_path) for r in removed] == [("h1", "/s1"), ("h1", "/s2"), ("h6", "/s5")]
    assert staging.summary(done).first().asDict() == {"total_files": 6, "total_bytes": 60, "verified_bytes": 30, "verified": 3, "error": 2, "skipped": 0, "pending": 1}
    assert {r.sha256 for r in staging.retry(done).filter("state = 'pending'").collect()} == {"h2", "h3", "h5"}
    assert staging.skip_absent(done, sources).filter("state = 'skipped'").first().sha256 == "h3"
    assert staging.next_drive(done).first().device == "Dg"
    assert [(r.dest_name, r.source) for r in staging.errors(done).orderBy("dest_name").collect()] == [("b", "/s3"), ("e", "/s5")]
    assert staging.run_pass(job, sources, copies, there, True, dry_run=True).filter("state = 'verified'").count() == 5
    assert staging.manifest(done, "/nas").filter("sha256_inventory = 'h1'").first().destination_path == "/nas/raw/a"


INVENTORY = "id long, full_path string, file_size long, device_name string, root_path string, deleted_at string"


def test_reconcile_and_guard(spark):
    df = spark.createDataFrame([(1, "/Volumes/A/x", 1, "A", "/Volumes/A", None), (2, "/Volumes/A/y", 1, "A", "/Volumes/A", None), (3, "/Volumes/A/q/z", 1, "A", "/Volumes/A", None), (4, "/Volumes/B/x", 1, "B", "/Volumes/B", None)], INVENTORY)
    mounts = spark.createDataFrame([("A", "/m/A"), ("B", None)], "device_name string, mount string")
    present = spark.createDataFrame([("/m/A/x", 1, None, True), ("/m/A/y", None, None, True)], schema.PRESENT_PATHS)
    statuses = maintenance.reconcile(df, mounts, present)
    assert {r.id: r.status for r in statuses.collect()} == {1: "present", 2: "missing", 3: "skipped", 4: "skipped"}
    assert tuple(maintenance.reconcile_counts(statuses).first()) == (1, 1, 2)
    assert [r.id for r in maintenance.prune(df, statuses, "now").filter("deleted_at = 'now'").collect()] == [2]
    assert maintenance.prune(df, statuses.filter("status <> 'present'"), "now").filter("deleted_at IS NOT NULL").count() == 0


def test_trash_life_cycle(spark):
    df = spark.createDataFrame([(i, f"/f{i}", 1, "A", "/", None) for i in (1, 2, 3)], INVENTORY)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    df = maintenance.soft_delete(df, ids(1, 2), "2025-01-01 00:00:00")
    assert maintenance.trash(df).count() == 2 and inventory.live(df).count() == 1
    df = maintenance.restore(df, ids(1))
    assert maintenance.trash(df).count() == 1
    meta = spark.createDataFrame([(1,), (2,), (3,)], "file_id long")
    before = maintenance.cutoff(datetime.datetime(2025, 3, 1), 0)
    df, meta, side = maintenance.purge(df, meta, {"captions": df.select("full_path")}, before=before)
    assert sorted(r.id for r in df.collect()) == [1, 3] and sorted(r.file_id for r in meta.collect()) == [1, 3] and side["captions"].count() == 2


def test_upserts(spark):
    old = spark.createDataFrame([("/a", 1, "old", None), ("/b", 2, "old", "gone")], "full_path string, file_size long, device_name string, deleted_at string")
    new = spark.createDataFrame([("/b", 5, "new"), ("/c", 6, "new")], "full_path string, file_size long, device_name string")
    got = sorted(tuple(r) for r in maintenance.partial_upsert(old, new, "full_path", maintenance.RENEWED_FILES).collect())
    assert got == [("/a", 1, "old", None), ("/b", 5, "old", "gone"), ("/c", 6, "new", None)]
    learned = spark.createDataFrame([("D", "/old", "u")], "device_name string, mount string, uuid string")
    assert tuple(drives.remembered(learned, spark.createDataFrame([("D", "/new", "")], learned.schema)).first()) == ("D", "/new", "u")
    ledger = spark.createDataFrame([], schema.MOVES)
    row = spark.createDataFrame([("h", "/s", "D", "/d", 4, True)], "sha256 string, source_path string, source_device string, dest_path string, size long, verified_hash boolean")
    ledger = maintenance.record_moves(maintenance.record_moves(ledger, row, "trash", "t"), row, "trash", "t")
    assert tuple(maintenance.moves_summary(ledger).first()) == (2, 8) and len({r.id for r in ledger.collect()}) == 2
    assert maintenance.saved_settings({"verify_hash": False}, {"x": 1}) == {"trash_retention_days": 30, "verify_hash": False}


def test_search_filters_before_ranking(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vec array<float>")
    about = spark.createDataFrame([(1, "Sony"), (2, "Drone"), (3, "Drone")], "id long, device string")
    got = search.semantic(vectors, about, [1.0, 0.0], k=1, device="Drone").collect()
    assert [r.id for r in got] == [2] and search.semantic(vectors, about, [0.0, -1.0]).count() == 0


def test_tags_and_captions(spark):
    df = spark.createDataFrame([(1, "/t/My_Trip-x/DSC_beach_01.jpg"), (2, "/t/b.jpg")], "id long, full_path string")
    seen = spark.createDataFrame([("/t/My_Trip-x/DSC_beach_01.jpg", [("ocean", 0.9), ("paper", 0.1), ("sky", 0.95)], ["a", "hello", "x"])], "path string, labels array<struct<id: string, conf: double>>, texts array<string>")
    tags = search.tag(df, seen)
    first = tags.filter("file_id = 1").first()
    assert (first.top_label, [x.id for x in first.labels], first.text_sample, first.content_bucket) == ("sky", ["sky", "ocean"], "hello", "Nature")
    assert tags.filter("file_id = 2").first().content_bucket == "Unsorted"
    assert search.caption(df, tags).filter("file_id = 1").first().caption == "Nature, sky, My Trip x, beach, hello"


def test_components_and_pairs_match_a_loop(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, None if i % 2 else "b", [float(x) for x in row]) for i, row in enumerate(v)], "id long, block string, vec array<double>")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if (i - j) % 2 == 0 and v[i] @ v[j] >= 0.9}
    pairs = clusters.similar_pairs(df, 0.9, tile=7)
    found = [(r.a, r.b) for r in pairs.collect()]
    assert set(found) == want and len(found) == len(want)
    label = list(range(60))
    for _ in label:
        for i, j in want:
            label[i] = label[j] = min(label[i], label[j])
    assert {r.id: r.component for r in clusters.components(df, pairs).collect()} == dict(enumerate(label))


def test_greedy_groups_match_a_loop(spark):
    rng = np.random.default_rng(2)
    v = [[float(x) for x in row / np.linalg.norm(row)] for row in rng.normal(size=(40, 3))]
    sums, want = [], []
    for x in v:
        best, at = 0.8, -1
        for i, (s, n) in enumerate(sums):
            alike = sum(a * b / n for a, b in zip(x, s))
            if alike >= best:
                best, at = alike, i
        if at < 0:
            sums.append((list(x), 1))
        else:
            sums[at] = ([a + b for a, b in zip(sums[at][0], x)], sums[at][1] + 1)
        want.append(at if at >= 0 else len(sums) - 1)
    got = clusters.greedy_groups(spark.createDataFrame(list(enumerate(v)), "id long, vec array<double>").repartition(3), 0.8)
    assert [r.person_id for r in got.orderBy("id").collect()] == want


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/_b/.c").mkdir(parents=True)
    for name in ("a/x.JPG", "a/x.arw", "a/._y.jpg", "a/notes.txt", "z.png", "_MG_1234.JPG", "a/_b/_DSC1.ARW", "a/_b/.c/deep é.jpg", "a/.jpg"):
        (tmp_path / name).write_bytes(name.encode())
    rows = {r.file_name: r for r in inventory.walk(spark, str(tmp_path), content=True).collect()}
    assert set(rows) == {"x.JPG", "x.arw", "z.png", "._y.jpg", "_MG_1234.JPG", "_DSC1.ARW", "deep é.jpg"}
    assert rows["deep é.jpg"].full_path == f"{tmp_path}/a/_b/.c/deep é.jpg" and rows["_DSC1.ARW"].file_size == len("a/_b/_DSC1.ARW")
    assert inventory.walk(spark, f"{tmp_path}/a/_b/.c").count() == 1
    import hashlib

    assert rows["z.png"].sha256 == hashlib.sha256(b"z.png").hexdigest() and rows["x.JPG"].extension == ".jpg"
    assert sorted(r.file_name for r in inventory.folder_shots(spark, str(tmp_path)).collect()) == ["_DSC1.ARW", "_MG_1234.JPG", "deep é.jpg", "x.JPG", "z.png"]
    assert inventory.folder_photos(spark, str(tmp_path), 2).count() == 2
    path = f"{tmp_path}/z.png"
    assert inventory.folder_shots(spark, str(tmp_path)).filter("file_name = 'z.png'").first().id == int(hashlib.sha1(path.encode()).hexdigest()[:15], 16)
    lines = spark.createDataFrame([('{"path": "/a", "n": 1}',), ("broken",), ('{"n": 2}',)], "value string")
    assert [tuple(r) for r in inventory.extracted(lines, "path string, n int").collect()] == [("/a", 1)]
    got = inventory.extract_with(spark.createDataFrame([("/a",), ("/b",)], "full_path string"), lambda paths: {p: {"make": p * 2} for p in paths if p == "/a"}, "make string")
    assert {r.full_path: r.make for r in got.collect()} == {"/a": "/a/a", "/b": None}


def test_manifests_and_archives(spark, tmp_path):
    import json

    done = items(spark, {"sha256": "h", "dest_name": 'a "b"', "candidates": [], "state": "error", "error": "gone"}, {"sha256": "i", "dest_name": "c", "candidates": [], "state": "verified", "size": 3 << 29})
    job = {"trip": "A b", "dest_root": "/nas", "status": "done"}
    where = sinks.archive_manifest(done, job, str(tmp_path / "m"), datetime.datetime(2025, 1, 2))
    assert where.endswith("A-b_20250102-000000")
    text = lambda name: [r.value for r in spark.read.text(f"{where}/{name}").collect()]
    lines = text("manifest.csv")
    assert len(lines) == 3 and lines[0].split(",")[:3] == ["trip", "dest_name", "dest_subfolder"] and len(lines[0].split(",")) == 18
    assert [line.split(",")[1] for line in text("errors.csv")] == ["dest_name", "\"a 'b'\""]
    whole = json.loads("\n".join(text("manifest.json")))
    assert whole["summary"]["verified_gb"] == 1.5 and whole["summary"]["trip"] == "A b" and [f["dest_name"] for f in whole["files"]] == ['a "b"', "c"] and len(whole["files"][0]) == 18
    (tmp_path / "m/Zz_20260101-000000").mkdir()
    (tmp_path / "m/Zz_20260101-000000/stage_summary.json").write_text("{broken")
    got = [tuple(r) for r in inventory.archived_summaries(spark, str(tmp_path / "m")).collect()]
    assert got == [("Zz_20260101-000000", None, None, None, None, None, None), ("A-b_20250102-000000", "A b", 1, 1, 1.5, "done", "/nas")]
    assert sinks.write_manifest(done.limit(0), job, f"{tmp_path}/none") and json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/none/manifest.json").collect()))["files"] == []


def test_state_files(spark, tmp_path):
    fields = "trash_retention_days int, verify_hash boolean"
    for name, text in (("good", '{"trash_retention_days": 7}'), ("corrupt", "{nope"), ("empty", "")):
        (tmp_path / name).write_text(text)
    got = {n: tuple(inventory.load_state(spark, f"{tmp_path}/{n}", fields).first()) for n in ("good", "corrupt", "empty", "missing")}
    assert got == {"good": (7, None), "corrupt": (None, None), "empty": (None, None), "missing": (None, None)}


def test_relations_are_kept_by_version(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(len(built))
    assert [sinks.kept(spark, str(tmp_path), v, build).count() for v in ("a", "a", "b")] == [1, 1, 2] and len(built) == 2
    from lumenark.library import Library

    row = lambda i: tuple({"id": i, "full_path": f"/Volumes/D/Iceland/x{i}.jpg", "file_name": f"x{i}.jpg", "extension": ".jpg", "file_size": 5, "root_path": "/Volumes/D", "device_name": "D"}.get(n) for n in schema.FILES.names)
    tables = lambda n: {"files": spark.createDataFrame([row(i) for i in range(n)], schema.FILES)}
    assert [Library(spark, tables(n), str(tmp_path / "lib"), v).trips().first().files for n, v in ((1, "1"), (3, "1"), (3, "2"))] == [1, 1, 3]


def test_ingest_job(spark):
    scan = "full_path string, file_name string, extension string, file_size long, modified_time string, sha256 string"
    rows = [("/r/a.jpg", "a.jpg", ".jpg", 1, "t1", "x"), ("/r/a.jpg", "a.jpg", ".jpg", 2, "t2", "y"), ("/r/b.mp4", "b.mp4", ".mp4", 3, "t1", "z")]
    files, run = maintenance.ingest(spark.createDataFrame([], schema.FILES), spark.createDataFrame(rows, scan), 1, "D", "/r", "now")
    assert {r.full_path: (r.file_size, r.sha256, r.mime_type) for r in files.collect()} == {"/r/a.jpg": (2, "y", "image/jpg"), "/r/b.mp4": (3, "z", "video/mp4")}
    assert run.first().asDict() == {"id": 1, "root_path": "/r", "started_at": "now", "finished_at": "now", "files_seen": 2, "files_added": 2, "errors": 0, "status": "completed"}
    said = "full_path string, camera_make string, capture_date string, raw_metadata_json string"
    meta = maintenance.ingest_metadata(files, spark.createDataFrame([], schema.METADATA), spark.createDataFrame([("/r/a.jpg", "Sony", "2024", "{}"), ("/r/b.mp4", "DJI", "2023", "{}"), ("/other", "x", "y", "z")], said), "now")
    assert {r.camera_make: (r.media_type, r.capture_date) for r in meta.collect()} == {"Sony": ("photo", "2024"), "DJI": ("video", "2023")}
    files2, run = maintenance.ingest(files, spark.createDataFrame([("/r/a.jpg", "a.jpg", ".jpg", 9, "t3", "w"), ("/r/c.arw", "c.arw", ".arw", 4, "t3", "v")], scan), 2, "E", "/q", "later")
    by_path = {r.full_path: r for r in files2.collect()}
    assert (by_path["/r/a.jpg"].file_size, by_path["/r/a.jpg"].device_name, by_path["/r/a.jpg"].first_seen_scan_id, by_path["/r/a.jpg"].last_seen_scan_id) == (9, "D", 1, 2) and run.first().files_added == 1
    assert len({r.id for r in by_path.values()}) == 3
    again = maintenance.ingest_metadata(files2, meta, spark.createDataFrame([("/r/a.jpg", None, "1999", "new")], said), "later")
    row = next(r for r in again.collect() if r.raw_metadata_json == "new")
    assert (row.camera_make, row.capture_date, row.extracted_at) == (None, "2024", "now") and again.count() == 2


def test_tag_caption_face_and_embed_jobs(spark):
    from lumenark.operators import jobs

    names = schema.FILES.names
    row = lambda i, name: tuple({"id": i, "full_path": f"/t/{name}", "file_name": name, "extension": name[name.index("."):], "file_size": 5, "sha256": f"h{i}"}.get(n) for n in names)
    files = spark.createDataFrame([row(1, "a.jpg"), row(2, "b.jpg"), row(3, "c.jpg"), row(4, "a.arw")], schema.FILES)
    present = spark.createDataFrame([("/t/a.jpg",), ("/t/b.jpg",)], "path string")
    meta = spark.createDataFrame([(2, "Sony")], "file_id long, camera_make string")
    seen = spark.createDataFrame([("/t/a.jpg", [("ocean", 0.9)], ["hello there, friend"])], "path string, labels array<struct<id: string, conf: double>>, texts array<string>")
    old = spark.createDataFrame([(1, "/t/a.jpg", "old"), (9, "/t/z.jpg", "old")], "file_id long, full_path string, top_label string")
    tags = jobs.tag_job(files, meta, old, seen, present, "now")
    assert {r.file_id: (r.top_label, r.tagged_at) for r in tags.collect()} == {1: ("ocean", "now"), 9: ("old", None)}
    captions = jobs.caption_job(files, spark.createDataFrame([(1, "/t/a.jpg", "x", "old", "then")], schema.CAPTIONS), tags, present, "now", part="/t")
    assert {r.file_id: r.source for r in captions.collect()} == {1: "lexical", 2: "lexical"}
    vectors = jobs.embed_job(files, spark.createDataFrame([(2, "/t/b.jpg", [9.0])], schema.EMBEDDINGS), present, lambda paths: [[float(len(p)), 0.0] for p in paths])
    assert {r.file_id: list(r.vec) for r in vectors.collect()} == {1: [1.0, 0.0], 2: [1.0, 0.0]}
    box = [0.1, 0.2, 0.3, 0.4]
    found = spark.createDataFrame([("/t/b.jpg", [(box, [0.0, 1.0]), (box, None), (box, [1.0, 0.0])]), ("/t/a.jpg", [(box, [1.0, 0.0])]), ("/t/c.jpg", [(box, [1.0, 0.0])])], "path string, faces array<struct<bbox: array<double>, vec: array<float>>>")
    faces = jobs.face_job(files, found, present)
    assert faces.columns == schema.FACES.names and sorted((r.full_path, list(r.vec), r.person_id) for r in faces.collect()) == [("/t/a.jpg", [1.0, 0.0], 0), ("/t/b.jpg", [0.0, 1.0], 1), ("/t/b.jpg", [1.0, 0.0], 0)]
    sizes = spark.createDataFrame([("/t/a.jpg", 1000.0, 500.0), ("/t/b.jpg", 10.0, 10.0)], "full_path string, width double, height double")
    got = [tuple(round(x, 6) for x in r[1:]) for r in jobs.crops(faces, sizes).collect()]
    assert got == [(55.0, 170.0, 390.0, 260.0)]


def test_null_vectors_are_left_out(spark):
    df = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "x", None), (3, "x", [1.0, 0.0])], "id long, block string, vec array<double>")
    assert [(r.a, r.b) for r in clusters.similar_pairs(df, 0.9).collect()] == [(1, 3)]
    assert sorted(tuple(r) for r in clusters.greedy_groups(df).collect()) == [(1, 0), (3, 0)]


def test_drives_by_hand(spark):
    learned = spark.createDataFrame([("A", "/old", "u")], "device_name string, mount string, uuid string")
    volumes = spark.createDataFrame([("/Volumes/N", "")], "mount string, uuid string")
    assert tuple(drives.mapped_by_hand(learned, "A", "/Volumes/N", volumes).first()) == ("A", "/Volumes/N", "u")
    assert tuple(drives.mapped_by_hand(learned, "A", "/gone", volumes).first()) == ("A", "/old", "u")


def test_stream_merges_scans_once(spark, tmp_path):
    from lumenark.streaming import ingest

    row = {"id": 1, "full_path": "/a", "file_size": 5, "device_name": "D"}
    spark.createDataFrame([tuple(row.get(n) for n in schema.FILES.names)], schema.FILES).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.merge_scans(ingest.scans(spark, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    row |= {"file_size": 6, "device_name": "E"}
    spark.createDataFrame([tuple(row.get(n) for n in schema.FILES.names)], schema.FILES).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.merge_scans(ingest.scans(spark, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    last = max(ingest._versions(spark, f"{tmp_path}/t"))
    got = spark.read.parquet(f"{tmp_path}/t/v{last:08d}").collect()
    assert [(r.full_path, r.file_size, r.device_name) for r in got] == [("/a", 6, "D")]


def test_a_batch_that_died_is_written_again(spark, tmp_path):
    from lumenark.streaming import ingest

    row = lambda **c: tuple(({"id": 1, "full_path": "/a", "device_name": "D"} | c).get(n) for n in schema.FILES.names)
    spark.createDataFrame([row(file_size=5, last_seen_scan_id=1, modified_time="t"), row(file_size=7, last_seen_scan_id=2, modified_time="t"), row(file_size=6, last_seen_scan_id=1, modified_time="u")], schema.FILES).write.parquet(f"{tmp_path}/in")
    (tmp_path / "t/v00000000").mkdir(parents=True)
    (tmp_path / "t/v00000000/part-00000.parquet").write_bytes(b"cut off")  # what a writer left that died before _SUCCESS
    ingest.merge_scans(ingest.scans(spark, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    assert ingest._versions(spark, f"{tmp_path}/t") == [0]
    assert [r.file_size for r in spark.read.parquet(f"{tmp_path}/t/v00000000").collect()] == [7]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_version(spark.range(1), f"{tmp_path}/t", 0)


def test_library_answers(spark):
    from lumenark.library import Library

    names = schema.FILES.names
    row = lambda i, h, d: tuple({"id": i, "full_path": f"/Volumes/{d}/Iceland/x{i}.jpg", "file_name": f"x{i}.jpg", "extension": ".jpg", "file_size": 5, "sha256": h, "root_path": f"/Volumes/{d}", "device_name": d}.get(n) for n in names)
    lib = Library(spark, {"files": spark.createDataFrame([row(1, "h", "A"), row(2, "h", "B"), row(3, None, "A")], schema.FILES)})
    assert lib.summary().first().asDict() == {"total_files": 3, "total_bytes": 15, "dup_groups": 1, "dup_files": 2, "reclaim_bytes": 5, "unique_files": 1, "unique_bytes": 5}
    trip = lib.trips().first()
    assert (trip.trip, trip.files, trip.unique_files, trip.nas_folder, trip.devices) == ("Iceland", 3, 1, "Iceland/2024/2024-09", "A,B")
    assert lib.sources().first().files == 2 and lib.dedupe_plan().count() == 2 and lib.stage_plan("Iceland").count() == 2
    assert lib.search("iceland").count() == 0 and lib.people().count() == 0 and lib.near_duplicates().count() == 0 and lib.counts().count() == 4
    assert lib.stage_status().first().asDict()["pct"] == 0.0
    assert {r.status for r in lib.identity().collect()} == {"absent"} and lib.identity_report().count() == 2 and lib.reconcile().count() == 3


def test_near_duplicates_of_unknown_files(spark):
    from lumenark.library import Library

    vectors = spark.createDataFrame([(7, "/x/a.JPG", [1.0, 0.0]), (8, "/x/b.dng", [1.0, 0.0]), (9, "/x/c.png", [0.0, 1.0])], schema.EMBEDDINGS)
    rows = Library(spark, {"embeddings": vectors}).near_duplicates().orderBy("place").collect()
    assert [(r.id, r.file_name, r.extension, r.component) for r in rows] == [(8, "b.dng", ".dng", 7), (7, "a.JPG", ".jpg", 7)]


def test_startup_overrides_and_status(spark, tmp_path):
    df = spark.createDataFrame([(1, "/f1", 1, "A", "/", "2025-01-01 00:00:00"), (2, "/f2", 1, "A", "/", "2025-03-01 00:00:00"), (3, "/f3", 1, "A", "/", None)], INVENTORY)
    files, meta, _ = maintenance.startup(df, spark.createDataFrame([(1,), (3,)], "file_id long"), {}, {"trash_retention_days": 10}, datetime.datetime(2025, 3, 5))
    assert sorted(r.id for r in files.collect()) == [2, 3] and [r.file_id for r in meta.collect()] == [3]
    overrides = spark.createDataFrame([("A::x", "old", None)], schema.OVERRIDES)
    assert tuple(maintenance.put_override(overrides, "A::x", "new", "trips").first()) == ("A::x", "new", "trips")
    job = items(spark, {"sha256": "a", "candidates": [("D1", "/p", ""), ("D1", "/q", ""), ("D2", "/r", "")]}, {"sha256": "b", "candidates": [], "state": "verified", "size": 30})
    row = staging.status(job, spark.createDataFrame([("D2",)], "device_name string")).first()
    assert (row.pct, row.next_drive) == (75.0, "D1")
    assert inventory.locate(spark, [f"{tmp_path}/none", str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        inventory.locate(spark, [f"{tmp_path}/none"])


def test_scores_shown_as_equal_are_equals(spark):
    """Ranked as they are shown: 0.50001 and 0.49999 are both 0.5, and the larger key is first."""
    vectors = spark.createDataFrame([(1, [0.50001, 0.0]), (2, [0.49999, 0.0]), (3, [0.4, 0.0])], "id long, vec array<double>")
    assert [(r.id, r.score) for r in search.top_k(vectors, [1.0, 0.0], 1, digits=4).collect()] == [(2, 0.5)]
    assert [r.id for r in search.top_k(vectors, [1.0, 0.0], 1).collect()] == [1]
    files = vectors.select("id", F.lit("Drone").alias("device"))
    assert [r.id for r in search.semantic(vectors, files, [1.0, 0.0], 2, 0.49999, 4, device="Drone").orderBy("id").collect()] == [1, 2]


def test_written_query_ranks_scores_as_shown(spark):
    files = spark.createDataFrame([(i, "/a/b.jpg") for i in range(3)], "id long, full_path string")
    v = [[0.0] * 512 for _ in range(3)]
    asked = spark.range(1).select(search.S.lexical_embedding(F.lit("beach")).alias("v")).first().v
    for row, size in zip(v, (0.90001, 0.89999, 0.9)):
        row[:] = [x * size for x in asked]
    vectors = spark.createDataFrame(list(enumerate(v)), "id long, vec array<double>")
    assert [r.id for r in search.text_search(vectors, files, "beach", 1, digits=4).collect()] == [2]


def test_means_of_many_groups(spark):
    """More groups than the first arrays hold, among them equal ones, each mean renewed alone."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 96))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = np.concatenate([v, v[::2] + rng.normal(size=(200, 96)) * 0.02])
    sums, want = [], []
    for x in v:
        alike = np.array([s / n @ x for s, n in sums])
        at = len(alike) - 1 - int(alike[::-1].argmax()) if len(alike) and alike.max() >= 0.8 else len(sums)
        if at == len(sums):
            sums.append((np.zeros(96), 0))
        sums[at] = (sums[at][0] + x, sums[at][1] + 1)
        want.append(at)
    got = clusters.greedy_groups(spark.createDataFrame(list(enumerate(v.tolist())), "id long, vec array<double>"), 0.8).orderBy("id").collect()
    assert [r.person_id for r in got] == want and max(want) > 300


def test_manifest_reads_its_items_once(spark, tmp_path):
    """Each of its files, and each part of the JSON document, made the items anew."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    done = items(spark, {"sha256": "h", "dest_name": "a", "candidates": [], "state": "error", "error": "gone"}, {"sha256": "i", "dest_name": "c", "candidates": [], "state": "verified", "size": 3})
    sinks.write_manifest(done.mapInArrow(counted, done.schema), {"trip": "A", "dest_root": "/nas", "status": "done"}, f"{tmp_path}/m")
    assert made.value == 2
