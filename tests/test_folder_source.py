"""The folder source against os.walk: whole trees, shares, filters, and as a stream that is stopped and started again."""

import hashlib
import os
import time

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from lumenark.sources import folder as source
from lumenark.streaming import ingest


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def put(root, name, content="x"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path)


def tree(root):
    """A deep chain, a wide folder, names that Spark's own sources hide, and files of no interest."""
    deep = "/".join(f"d{i}" for i in range(40))
    for k in range(60):
        put(root, f"wide/IMG_{k:03d}.{'JPG' if k % 2 else 'arw'}", "w" * k)
        put(root, f"many/f{k % 20}/_{k}.mov", "v")
    put(root, f"{deep}/end.png", "deep")
    for name in (".hidden/a.jpg", "_under/.b.jpg", "._c.jpg", "no_extension", "notes.txt", ".jpg", "odd.", "x.tar.HEIC", "empty/é ü.dng"):
        put(root, name, name)
    (root / "really empty").mkdir()
    os.symlink(root, root / "wide" / "loop")
    return root


def walked(root, extensions=source.INGEST_EXTENSIONS):
    out = {}
    for folder, _, names in os.walk(root):
        for name in names:
            stem, ext = os.path.splitext(name)
            if ext.lower() in extensions and stem:
                path = os.path.join(folder, name)
                data = open(path, "rb").read()
                out[path] = (name, ext.lower(), len(data), hashlib.sha256(data).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r.full_path: (r.file_name, r.extension, r.file_size, r.sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("slices", [1, 7, 64])
@pytest.mark.parametrize("a_slice", [3, 2000])
def test_same_rows_however_it_is_shared_out(spark, tmp_path, slices, a_slice, monkeypatch):
    monkeypatch.setattr(source, "FILES_A_SLICE", a_slice)
    walker = source.Walker({"path": str(tree(tmp_path)), "content": "true", "slices": str(slices)})
    shares = walker.plan()
    rows = [r for s in shares for r in walker.rows(s)]
    assert len(rows) == len({r[0] for r in rows}) and {r[0]: (r[1], r[2], r[3], r[5]) for r in rows} == walked(tmp_path)
    assert len(shares) <= source.ROUNDS * slices and (slices == 1 or len(shares) >= min(slices, 7))


def test_read(spark, tmp_path):
    source.register(spark)
    df = spark.read.format("media_folder").option("content", True).load(str(tree(tmp_path)))
    assert got(df) == walked(tmp_path) and df.rdd.getNumPartitions() > 20
    assert got(spark.read.format("media_folder").option("content", True).load(f"file://{tmp_path}")) == walked(tmp_path)
    assert {r.sha256 for r in spark.read.format("media_folder").load(str(tmp_path)).collect()} == {None}
    told = spark.read.format("media_folder").option("content", True).option("extensions", "txt, .HEIC").load(str(tmp_path))
    assert got(told) == walked(tmp_path, (".txt", ".heic")) and len(got(told)) == 2
    every = spark.read.format("media_folder").option("extensions", "*").load(str(tmp_path)).count()
    assert every == sum(len(names) for _, _, names in os.walk(tmp_path))
    assert spark.read.format("media_folder").load(str(tmp_path / "nowhere")).count() == 0
    assert spark.read.format("media_folder").load(str(tmp_path / "really empty")).count() == 0
    with pytest.raises(Exception, match="takes the folder"):
        spark.read.format("media_folder").load().count()


FILTERS = [
    "extension = '.jpg'", "extension IN ('.mov', '.png')", "extension <> '.mov'", "file_name LIKE 'IMG%'", "file_name LIKE '%c.jpg'", "file_name LIKE '%é%'", "file_size > 30", "file_size <= 1 AND extension = '.mov'",
    "full_path LIKE concat('{root}', '/wide/%')", "full_path = concat('{root}', '/many/f3/_3.mov')", "NOT (file_name LIKE '%1%')", "modified_time >= '2001-01-01'", "modified_time < '2001-01-01'", "file_size % 2 = 0 AND extension = '.arw'",
    "extension = '.jpg' OR file_size = 4", "sha256 IS NOT NULL AND extension = '.png'", "file_name IS NULL", "extension IN ('.mov', NULL)",
]


def test_filters_give_what_spark_gives(pushing, tmp_path):
    tree(tmp_path)
    read = lambda: source.read(pushing, str(tmp_path), content=True)
    every = read().persist()
    for condition in FILTERS:
        where = condition.format(root=tmp_path)
        assert got(read().filter(where)) == got(every.filter(where)), condition
    every.unpersist()


def test_filters_are_in_the_plan_and_prune_the_walk(pushing, tmp_path, monkeypatch):
    tree(tmp_path)
    df = source.read(pushing, str(tmp_path)).filter("extension = '.mov' AND file_size > 0 AND file_size % 2 = 1")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    left = next(line for line in plan.split("\n") if "Filter" in line)
    assert df.count() == 60 and "% 2" in left and "extension" not in left and "> 0" not in left  # what Spark still has to do
    reader = source.FilteringReader({"path": str(tmp_path)})
    kept = [D.StringStartsWith(("full_path",), f"{tmp_path}/many/f1"), D.IsNotNull(("extension",)), D.EqualTo(("sha256",), "x"), D.In(("extension",), (".mov", None))]
    assert list(reader.pushFilters(kept)) == kept[2:]
    seen = []
    listed = source.Tree.list
    monkeypatch.setattr(source.Tree, "list", lambda self, folder: seen.append(folder) or listed(self, folder))
    rows = [r[0] for s in reader.partitions() for r in reader.rows(s)]
    assert len(rows) == 3 * 11 and all(r.startswith(f"{tmp_path}/many/f1") for r in rows)  # f1 and f10 to f19
    assert {os.path.relpath(f, tmp_path).split("/")[0] for f in seen} == {".", "many"}


def test_content_is_only_read_where_other_filters_pass(tmp_path, monkeypatch):
    tree(tmp_path)
    reader, read = source.FilteringReader({"path": str(tmp_path), "content": "true"}), []
    list(reader.pushFilters([D.GreaterThan(("file_size",), 50)]))
    monkeypatch.setattr(source.Tree, "sha256", lambda self, path: read.append(path))
    assert len([r for s in reader.partitions() for r in reader.rows(s)]) == len(read) == 9


def window(root, after, until):
    reader = source.StreamReader({"path": str(root)})
    return sorted(os.path.relpath(r[0], root) for s in reader.partitions({"until": after}, {"until": until}) for r in reader.rows(s))


def test_windows_hold_what_is_new_changed_or_moved(tmp_path):
    root = tmp_path / "in"
    put(root, "a/one.jpg"), put(root, "b/two.jpg")
    put(tmp_path, "away/x/three.jpg"), put(tmp_path, "away/four.jpg")
    os.utime(tmp_path / "away/four.jpg", (1e9, 1e9))
    moments, found = [0], []

    def mark():
        time.sleep(0.05)
        moments.append(time.time_ns())
        found.append(window(root, *moments[-2:]))
        time.sleep(0.05)

    mark()
    put(root, "a/new.jpg"), put(root, "b/two.jpg", "changed")
    mark()
    os.rename(tmp_path / "away/four.jpg", root / "four.jpg")  # keeps its old time
    mark()
    os.rename(tmp_path / "away", root / "b/away")  # nothing in it changes
    mark()
    os.rename(root / "a", root / "c")
    mark()
    os.remove(root / "c/new.jpg")
    mark()
    assert found == [["a/one.jpg", "b/two.jpg"], ["a/new.jpg", "b/two.jpg"], ["four.jpg"], ["b/away/x/three.jpg"], ["c/new.jpg", "c/one.jpg"], []]
    # The same windows once more, late: nothing that is still there and has not changed since is lost.
    assert all(want in window(root, *moments[k : k + 2]) for k, want in ((1, "b/two.jpg"), (2, "four.jpg"), (3, "b/away/x/three.jpg"), (4, "c/one.jpg")))
    assert window(root, moments[5], moments[5]) == []


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source.register(spark)
    root, seen, fails = tmp_path / "in", [], [False]
    put(root, "a.jpg"), put(root, "deep/er/b.jpg")
    time.sleep(0.05)

    def take(batch, number):
        rows = sorted(os.path.relpath(r.full_path, root) for r in batch.collect())
        if fails[0]:
            raise RuntimeError("lost")
        seen.append((number, rows))

    def run():
        stream = spark.readStream.format("media_folder").load(str(root))
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
        time.sleep(0.05)

    run()
    put(root, "deep/c.jpg"), put(root, "a.jpg", "changed")
    time.sleep(0.05)
    fails[0] = True
    with pytest.raises(Exception, match="lost"):
        run()
    fails[0] = False
    put(root, "d.jpg")
    time.sleep(0.05)
    run()  # what failed
    run()  # what came since
    rows = [r for _, rows in seen for r in rows]
    # The folder and what it is in changed at once, so all of it comes again.
    assert seen[0][1] == ["a.jpg", "deep/er/b.jpg"] and sorted(rows[2:]) == ["a.jpg", "d.jpg", "deep/c.jpg", "deep/er/b.jpg"]
    put(root, "deep/er/e.jpg")
    time.sleep(0.05)
    run()
    assert [r for _, rows in seen for r in rows][len(rows) :] == ["deep/er/e.jpg"]


def test_folder_stream_into_the_inventory(spark, tmp_path):
    root = tmp_path / "in"
    put(root, "a.jpg", "1"), put(root, "x/b.mov", "22")

    def run():
        time.sleep(0.05)
        ingest.merge_scans(ingest.folder_scans(spark, str(root), "T7", content=True), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
        versions = sorted(p for p in os.listdir(tmp_path / "table") if p.startswith("v"))
        return {os.path.relpath(r.full_path, root): r for r in spark.read.parquet(str(tmp_path / "table" / versions[-1])).collect()}

    first = run()
    assert {k: (r.file_size, r.device_name, r.mime_type, r.sha256) for k, r in first.items()} == {
        "a.jpg": (1, "T7", "image/jpg", hashlib.sha256(b"1").hexdigest()), "x/b.mov": (2, "T7", "video/mov", hashlib.sha256(b"22").hexdigest())
    }
    put(root, "a.jpg", "333"), put(root, "c.png", "")
    second = run()
    assert {k: r.file_size for k, r in second.items()} == {"a.jpg": 3, "x/b.mov": 2, "c.png": 0}
    assert second["a.jpg"].id == first["a.jpg"].id and second["x/b.mov"] == first["x/b.mov"]
