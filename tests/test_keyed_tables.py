"""Tables by key against dictionaries: changes, what they touch, crashes, plans, old versions, and a stream into one."""

import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenark.functions import scalar as S
from lumenark.operators import keyed, maintenance
from lumenark.sources import schema
from lumenark.streaming import ingest

ROWS = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("deleted_at", T.StringType())])


def table(spark, path, **options):
    return keyed.KeyedTable(spark, str(path), "path", ROWS, **{"by": S.dirname, "parts": 16, "buckets": 4, **options})


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()] if isinstance(rows, dict) else rows, ROWS)


def held(df):
    rows = df.collect()
    out = {r.path: (r.size, r["first"], r.deleted_at) for r in rows}
    assert len(out) == len(rows)
    return out


def fill(n=400):
    return {f"/d{i % 20}/f{i}": (i, 1, None) for i in range(n)}


def test_changes_equal_a_dictionary(spark, tmp_path):
    t, now, rng = table(spark, tmp_path / "t"), {}, random.Random(1)
    assert held(t.read()) == {}
    now = fill()
    t.upsert(frame(spark, now))
    for _ in range(2):
        new = {f"/d{rng.randrange(25)}/f{i}": (rng.randrange(9), 2, "x" if rng.random() < 0.2 else None) for i in rng.sample(range(500), 30)}
        t.upsert(frame(spark, [*((k, *v) for k, v in new.items()), *((k, -1, 0, None) for k in list(new)[:5]), (None, 1, 1, None)]))  # twice in the change, and a null key
        now |= new
        assert held(t.read()) == now
    renewed = {k: (77, 9, "no") for k in rng.sample(sorted(now), 20)} | {"/new/one": (5, 9, None)}
    t.upsert(frame(spark, renewed), ("size",))
    now |= {k: (77, *now[k][1:]) if k in now else v for k, v in renewed.items()}
    assert held(t.read()) == now
    gone = rng.sample(sorted(now), 25)
    t.mark(frame(spark, {k: (0, 0, None) for k in gone}), "deleted_at", F.coalesce("deleted_at", F.lit("now")))
    now |= {k: (*now[k][:2], now[k][2] or "now") for k in gone}
    assert held(t.read()) == now
    back = gone[:10]
    t.mark(frame(spark, {k: (0, 0, None) for k in back}), "deleted_at", F.lit(None).cast("string"))
    now |= {k: (*now[k][:2], None) for k in back}
    t.delete(frame(spark, {k: (0, 0, None) for k in [*gone[10:], "/never/there"]}))
    now = {k: v for k, v in now.items() if k not in gone[10:]}
    assert held(t.read()) == now
    t.upsert(frame(spark, []))  # nothing
    assert held(t.read()) == now and held(t.read(version=0)) == fill()
    t.release()
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("keyed_")] and held(t.read()) == now


def test_a_partition_that_loses_all_rows(spark, tmp_path):
    t, rows = table(spark, tmp_path / "t"), fill(60)
    t.upsert(frame(spark, rows))
    t.delete(frame(spark, rows))
    assert held(t.read()) == {}
    t.upsert(frame(spark, {"/d1/f1": (1, 1, None)}))
    assert set(held(t.read())) == {"/d1/f1"}


def test_only_touched_partitions_are_written(spark, tmp_path):
    t, rows = table(spark, tmp_path / "t", parts=32), fill(2000)
    t.upsert(frame(spark, rows))
    t.upsert(frame(spark, {f"/d3/f{i}": (i, 2, None) for i in range(20)}))  # one folder, 1 %
    first, second = t.versions()
    assert len(second.parts) == 1 < len(first.parts)
    assert [p for p in os.listdir(tmp_path / "t/v00000001") if p.startswith("_part=")] == [f"_part={next(iter(second.parts))}"]
    assert held(t.read())["/d3/f3"] == (3, 2, None) and held(t.read())["/d4/f4"] == (4, 1, None)


def test_the_table_is_not_shuffled(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.upsert(frame(spark, fill(2000)))
    delta = maintenance.newest(frame(spark, {f"/d3/f{i}": (i, 2, None) for i in range(20)}), "path")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for merged in (maintenance.partial_upsert(t.read(), delta, "path", ("size",)), maintenance.upsert(t.read(), delta, "path"), t.read().join(t.read().select("path", F.col("size").alias("s")), "path")):
            plan = merged._jdf.queryExecution().executedPlan().toString().split("\n")
            scans = [k for k, line in enumerate(plan) if "FileScan parquet" in line]
            assert scans and all("Bucketed: true" in plan[k] for k in scans)
            for k in scans:  # up to the join no exchange stands over the table
                depth = len(plan[k]) - len(plan[k].lstrip(" :+-*"))
                for line in reversed(plan[:k]):
                    own = len(line) - len(line.lstrip(" :+-*"))
                    if own < depth:
                        depth = own
                        assert "Exchange" not in line
                        if "Join" in line:
                            break
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_writer_that_dies_leaves_the_table_readable(spark, tmp_path, monkeypatch):
    t, rows = table(spark, tmp_path / "t"), fill(100)
    t.upsert(frame(spark, rows))
    bad = F.udf(lambda s: 1 // (s - 3), "long")
    with pytest.raises(Exception, match="ZeroDivision"):  # in the middle of the writing job
        t._change(frame(spark, rows), lambda old, delta: old.withColumn("size", bad("size")), "")
    assert held(t.read()) == rows and len(t.versions()) == 1
    with monkeypatch.context() as m:  # after the files, before the record
        m.setattr(keyed.KeyedTable, "_record", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            t.upsert(frame(spark, {"/d1/f1": (9, 9, None)}))
    assert os.path.isdir(tmp_path / "t/v00000001") and held(t.read()) == rows
    t.upsert(frame(spark, {"/d2/f2": (9, 9, None)}))
    assert held(t.read()) == rows | {"/d2/f2": (9, 9, None)}


def test_old_versions_go_by_age(spark, tmp_path):
    t, rows = table(spark, tmp_path / "t"), fill(100)
    t.upsert(frame(spark, rows))
    t.upsert(frame(spark, {"/d1/f1": (9, 9, None)}))
    os.makedirs(tmp_path / "t/v00000007")  # of a dead writer
    assert t.vacuum(3600) == 0 and held(t.read(version=0)) == rows
    time.sleep(0.1)
    assert t.vacuum(0) == 2
    assert held(t.read()) == rows | {"/d1/f1": (9, 9, None)} and len(held(t.read(version=0))) < len(rows)
    assert t.vacuum(0) == 0


def test_stream_into_a_table(spark, tmp_path):
    def land(name, rows):
        columns = "full_path string, file_size long, sha256 string, modified_time string, last_seen_scan_id long"
        schema.ensure_columns(spark.createDataFrame(rows, columns), schema.FILES).select(*schema.FILES.names).coalesce(1).write.parquet(str(tmp_path / "land" / name))
        for f in os.listdir(tmp_path / "land" / name):
            if f.endswith(".parquet"):
                shutil.move(tmp_path / "land" / name / f, tmp_path / "in" / f"{name}.parquet")

    os.makedirs(tmp_path / "in")
    t = keyed.files_table(spark, str(tmp_path / "t"), parts=8, buckets=2)
    run = lambda: ingest.merge_into(ingest.scans(spark, str(tmp_path / "in")), t, str(tmp_path / "state")).awaitTermination()
    land("a", [("/a/1", 1, "x", "t1", 1), ("/b/2", 2, "y", "t1", 1), (None, 0, None, None, 1)])
    run()
    land("b", [("/a/1", 5, "z", "t2", 2), ("/a/1", 4, "w", "t1", 1), ("/c/3", 3, "q", "t1", 2)])
    run()
    run()
    assert {r.full_path: (r.file_size, r.sha256) for r in t.read().collect()} == {"/a/1": (5, "z"), "/b/2": (2, "y"), "/c/3": (3, "q")}
    assert [v.note for v in t.versions()] == ["batch 0", "batch 1"] and len(t.versions()[1].parts) <= 2
