"""A stage job's events as a stream, stopped and started again, against one pass over the same facts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lumenark.operators import staging
from lumenark.sources import schema
from lumenark.streaming import stages


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stages.ROCKSDB)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def facts(rng, n=60):
    """items (sha, size, candidate paths), readable paths, copies, destination files."""
    items = [(f"{'__nh' if k % 9 == 0 else 'h'}{k}", k % 7, [f"/p{k}/{i}" for i in range(rng.randint(1, 3))]) for k in range(n)]
    sources = {p: p.replace("/p", "/mnt/p") if rng.random() < 0.3 else p for _, _, ps in items for p in ps if rng.random() < 0.7}
    size = {p: s for _, s, ps in items for p in ps}
    sha = {p: h for h, _, ps in items for p in ps}
    copies = {u: (size[p] + (rng.random() < 0.2), sha[p] if rng.random() < 0.8 else rng.choice(["other", None])) for p, u in sources.items() if rng.random() < 0.8}
    there = {h: (s if rng.random() < 0.7 else s + 1, h if rng.random() < 0.7 else "x") for h, s, _ in items if rng.random() < 0.3}
    return items, sources, copies, there


def run_stream(spark, root, seen, patience=600, verify=True):
    stream = spark.readStream.schema(stages.EVENTS).json(str(root / "in"))

    def take(batch, number):
        for r in batch.collect():
            seen[r.sha256] = r.asDict()

    query = stages.states(stream, verify, patience=patience).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(root / "state")).trigger(once=True).start()
    query.awaitTermination()


def land(spark, root, events, number):
    spark.createDataFrame(events, stages.EVENTS).coalesce(1).write.json(str(root / "made" / str(number)))
    (root / "in").mkdir(exist_ok=True)
    for f in (root / "made" / str(number)).glob("*.json"):
        f.rename(root / "in" / f"{number}.json")


@pytest.mark.parametrize("verify", [True, False])
def test_final_states_equal_a_pass(rocks, tmp_path, verify):
    rng = random.Random(8)
    items, sources, copies, there = facts(rng)
    events = [(h, "item", None, None, s, None) for h, s, _ in items] + [(h, "source", i, sources[p], None, None) for h, _, ps in items for i, p in enumerate(ps) if p in sources]
    owner = {sources[p]: h for h, _, ps in items for p in ps if p in sources}
    events += [(owner[u], "started", None, u, None, None) for u in copies] + [(owner[u], "copied", None, u, s, x) for u, (s, x) in copies.items()] + [(h, "there", None, None, s, x) for h, (s, x) in there.items()]
    rng.shuffle(events)
    seen = {}
    for number in range(3):  # the stream stops after each part
        land(rocks, tmp_path, events[number::3], number)
        run_stream(rocks, tmp_path, seen, verify=verify)
    table = rocks.createDataFrame([(h, "d", h, s, [("A", p, "") for p in ps], "pending") for h, s, ps in items], "sha256 string, dest_rel string, dest_name string, size long, candidates array<struct<device: string, path: string, root: string>>, state string")
    table = schema.ensure_columns(table, schema.STAGE_ITEMS)
    want = staging.run_pass(table, rocks.createDataFrame(list(sources.items()), "path string, used_path string"), rocks.createDataFrame([(u, *c) for u, c in copies.items()], "used_path string, size long, sha256 string"), rocks.createDataFrame([("d", h, *x) for h, x in there.items()], "dest_rel string, dest_name string, size long, sha256 string"), verify)
    columns = ("sha256", "size", "state", "verify_status", "error", "used_path", "verified_sha")
    assert sorted([tuple(r[c] for c in columns) for r in seen.values()], key=str) == sorted([tuple(r[c] for c in columns) for r in want.select(*columns).collect()], key=str)
    assert len({r["state"] for r in seen.values()}) == 3


def test_stalled_copies_are_told(rocks, tmp_path):
    seen = {}
    land(rocks, tmp_path, [(h, *e) for h in ("slow", "done") for e in (("item", None, None, 3, None), ("source", 0, f"/{h}", None, None), ("started", None, f"/{h}", None, None))] + [("done", "copied", None, "/done", 3, "done")], 0)
    run_stream(rocks, tmp_path, seen, patience=0.5)
    assert {h: (r["state"], r["stalled"]) for h, r in seen.items()} == {"slow": ("error", False), "done": ("verified", False)}
    time.sleep(1)
    land(rocks, tmp_path, [("other", "item", None, None, 1, None)], 1)
    run_stream(rocks, tmp_path, seen, patience=0.5)
    assert {h: r["stalled"] for h, r in seen.items()} == {"slow": True, "done": False, "other": False}
    land(rocks, tmp_path, [("slow", "copied", None, "/slow", 3, "slow")], 2)
    run_stream(rocks, tmp_path, seen, patience=0.5)
    assert (seen["slow"]["state"], seen["slow"]["stalled"]) == ("verified", False)
