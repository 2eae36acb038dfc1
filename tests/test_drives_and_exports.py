"""Matches of many drives and volumes against all pairs; numbers of clusters against a sort."""

import random

import pytest

from lumenark.operators import drives, sinks


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0, 0.01])
def test_matches_equal_all_pairs(spark, least):
    rng = random.Random(7)
    names = [f"n{k}" for k in range(40)]
    draw = lambda: [n for k, n in enumerate(names) if rng.random() < 1 / (1 + k / 4)]  # noqa: E731 - some names are everywhere
    want = {f"d{k}": draw() + ["n0"] for k in range(30)} | {"empty": [], "lone": ["nowhere"], "one": ["n0"]}
    held = {(f"/v{k}", f"u{k % 9}"): draw() for k in range(25)} | {("/none", "u"): [], ("/all", "u"): names}
    for k, (name, top) in enumerate(list(want.items())[:6]):
        held[f"/copy{k}", ""] = top[: max(1, len(top) * 3 // 4)]
    got = drives.matches(spark.createDataFrame(list(want.items()), "device_name string, top array<string>"), spark.createDataFrame([(*v, t) for v, t in held.items()], "mount string, uuid string, top array<string>"), least).collect()
    brute = {(d, *v): len(set(a) & set(b)) / len(set(a)) for d, a in want.items() for v, b in held.items() if a and len(set(a) & set(b)) / len(set(a)) >= least}
    assert {(r.device_name, r.mount, r.uuid): r.score for r in got} == brute and len(got) == len(brute)


def test_cluster_numbers(spark):
    rng = random.Random(2)
    clusters = [(k * 10, rng.randint(2, 5)) for k in range(300)]
    rows = [(c, c + i, i + 1, m) for c, m in clusters for i in range(m)]
    got = sinks.cluster_rows(spark.createDataFrame(rows, "component long, id long, place int, members int").repartition(6)).collect()
    number = {c: k + 1 for k, (c, _) in enumerate(sorted(clusters, key=lambda x: (-x[1], x[0])))}
    assert len(got) == len(rows) and all(r.cluster == number[r.component] and r.action == ("KEEP" if r.place == 1 else "REVIEW") for r in got)
    assert sinks.cluster_rows(spark.createDataFrame([], "component long, id long, place int, members int")).count() == 0
