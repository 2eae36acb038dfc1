"""Summaries after random changes against those built anew."""

import random

from pyspark.sql import functions as F

from lumenark.operators import dedupe, views

SCHEMA = "id long, full_path string, device_name string, sha256 string, file_size long, deleted_at string"


def row(rng, path):
    return (rng.randrange(10**6), path, rng.choice(["T7", "T9", None]), rng.choice(["", None, *(f"h{rng.randrange(12)}" for _ in range(6))]), rng.choice([None, 0, 5, 7, 7, rng.randrange(1000)]), None)


def same(spark, got, files):
    assert got.totals.first() == dedupe.totals(files).first()
    assert got.duplicates.first() == dedupe.duplicate_groups(files).first()
    assert got.unique.first() == dedupe.unique_bytes(files).first()
    assert sorted(map(str, got.drive_usage().collect())) == sorted(map(str, dedupe.drive_usage(files).collect()))
    key = lambda r: r["sha256"]
    assert sorted(got.hashes.collect(), key=key) == sorted(views.build(files).hashes.select(*got.hashes.columns).collect(), key=key)


def test_changes_equal_a_rebuild(spark):
    rng, now = random.Random(3), {}
    for k in range(80):
        now[f"/{k}"] = row(rng, f"/{k}")
    frame = lambda rows: spark.createDataFrame(list(rows.values()), SCHEMA)
    state = views.build(frame(now))
    same(spark, state, frame(now))
    for _ in range(2):
        before, kept = dict(now), dict(now)
        touched = rng.sample(sorted(now), 14) + [f"/new{rng.randrange(999)}" for _ in range(6)] + [None]
        for path in touched:
            do = rng.random()
            if path in now and do < 0.35:
                del now[path]
            elif path in now and do < 0.6:
                now[path] = (*now[path][:5], "gone")
            elif path is not None:
                now[path] = row(rng, path)
        state = views.update(state, frame(before), frame(now), spark.createDataFrame([(p,) for p in touched], "full_path string"))
        same(spark, state, frame(now))
        # and back
        back = views.update(state, frame(now), frame(kept), spark.createDataFrame([(p,) for p in touched], "full_path string"))
        same(spark, back, frame(kept))


def test_from_nothing_to_nothing(spark):
    none, rng = spark.createDataFrame([], SCHEMA), random.Random(1)
    some = spark.createDataFrame([row(rng, f"/{k}") for k in range(9)] + [(1, None, "T7", "h1", 3, None)], SCHEMA)
    keys = some.select("full_path")
    state = views.update(views.build(none), none, some, keys)
    same(spark, state, some)
    state = views.update(state, some, none, keys)
    same(spark, state, none)
    assert state.hashes.count() == state.drives.count() == 0


def test_smallest_copy_is_looked_up_only_where_it_may_have_gone(spark):
    files = spark.createDataFrame([(k, f"/{k}", "T7", f"h{k % 5}", 10 + k, None) for k in range(20)], SCHEMA)
    after = files.filter("full_path NOT IN ('/0', '/19')")
    looked = after.withColumn("file_size", F.when(F.col("sha256").isin("h0") | F.col("full_path").isin("/0", "/19"), F.col("file_size")).otherwise(-1))
    got = views.update(views.build(files), files, looked, spark.createDataFrame([("/0",), ("/19",)], "full_path string"))
    same(spark, got, after)  # the sizes of other hashes, spoilt above, were not read
