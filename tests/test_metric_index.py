"""The index of angles against all pairs, on vectors in clusters, vectors without any, hot blocks and odd ones."""

import numpy as np
import pandas as pd
import pytest

from lumenark.operators import clusters

SCHEMA = "id long, block string, vec array<double>"


def scenes(n, count, d=24, spread=0.08, seed=1):
    """Unit vectors around random directions."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(count, d))
    v = (middle / np.linalg.norm(middle, axis=1, keepdims=True))[rng.integers(0, count, n)] + rng.normal(size=(n, d)) * spread
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def brute(rows, threshold):
    out = {}
    for block in {b or "Unsorted" for _, b, _ in rows}:
        own = [(i, v) for i, b, v in rows if (b or "Unsorted") == block and v is not None]
        if own:
            m = np.array([v for _, v in own])
            for i, j in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
                a, b = sorted((own[i][0], own[j][0]))
                out[block, a, b] = float(m[i] @ m[j])
    return out


def check(spark, rows, threshold, tile):
    got = clusters.similar_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold, tile).collect()
    want = brute(rows, threshold)
    assert len(got) == len(want) and {(r.block, r.a, r.b) for r in got} == want.keys()
    assert all(r.score == pytest.approx(want[r.block, r.a, r.b]) for r in got)
    return want


def listed(vectors, block="t", first=0):
    return [(first + k, block, [float(x) for x in v]) for k, v in enumerate(vectors)]


@pytest.mark.parametrize(("threshold", "tile"), [(0.9, 16), (0.6, 64), (0.0, 64), (-0.2, 2048)])
def test_same_pairs_as_all_pairs(spark, threshold, tile):
    rows = listed(scenes(300, 20)) + listed(np.random.default_rng(2).normal(size=(150, 24)) / 5, "loose", 1000) + listed(scenes(5, 2), None, 2000) + [(3000, "t", None), (3001, "t", [0.0] * 24), (3002, "alone", [1.0] * 24), (3003, "none", None)]
    assert check(spark, rows, threshold, tile)


def test_copies_and_lengths(spark):
    v = scenes(120, 6)
    rows = listed(np.concatenate([v, np.repeat(v[:1], 80, axis=0), v[:10] * 3, v[10:20] * 0.01, -v[:20]]))
    check(spark, rows, 0.9, 16)
    check(spark, rows, 2.0, 16)


def test_borders_of_cells(spark):
    """Vectors a little under and over the threshold apart, around a circle, so that partners live in different cells."""
    angle = np.cumsum(np.tile([0.99, 1.01], 130)) * np.arccos(0.95)
    rows = listed(np.stack([np.cos(angle), np.sin(angle), np.zeros(260), np.full(260, 0.0)], axis=1))
    check(spark, rows, 0.95, 8)


def test_products_are_few_where_vectors_lie_in_clusters(spark):
    n = 20_000
    hot, small = scenes(n, 400, d=32, spread=0.03), scenes(900, 30, d=32, spread=0.03, seed=3)
    rows = spark.createDataFrame([(k, "hot" if k < n else f"b{k % 3}", v) for k, v in enumerate(np.concatenate([hot, small]).tolist())], SCHEMA)
    made = {r.block: r for r in clusters.products(rows, 0.9, 256).collect()}
    assert made["hot"].vectors == n and made["hot"].products < 0.2 * n * n / 2
    assert {b: r.vectors for b, r in made.items()} == {"hot": n, "b0": 300, "b1": 300, "b2": 300}


def test_products_are_never_more_than_all_pairs(spark):
    v = np.random.default_rng(5).normal(size=(3000, 32))
    rows = spark.createDataFrame([(k, "t", x) for k, x in enumerate((v / np.linalg.norm(v, axis=1, keepdims=True)).tolist())], SCHEMA)
    assert clusters.products(rows, 0.9, 256).first().products < 1.1 * 3000 * 3000 / 2


def _shifted(spark, monkeypatch, meet, visits):
    monkeypatch.setattr(clusters, "MEET", meet)
    monkeypatch.setattr(clusters, "VISITS", visits)


@pytest.mark.parametrize("visits", [0, 1000])
@pytest.mark.parametrize("meet", [8, 50])
def test_small_tiles_by_index_and_without(spark, monkeypatch, meet, visits):
    """Cells of many tiles, by way of the index and as one cell each."""
    _shifted(spark, monkeypatch, meet, visits)
    rows = listed(scenes(150, 9)) + listed(np.random.default_rng(2).normal(size=(70, 24)) / 5, "loose", 1000) + listed([scenes(1, 1)[0]] * 60, "copies", 2000)
    check(spark, rows, 0.6, 16)


def test_vectors_do_not_multiply_where_nothing_can_be_left_out(spark):
    """Vectors without clusters went to a task for each tile they met, or visited most pivots: 6,000 vectors, tiles of 64."""
    v = np.random.default_rng(5).normal(size=(6000, 32))
    rows = spark.createDataFrame([(k, "t", x) for k, x in enumerate((v / np.linalg.norm(v, axis=1, keepdims=True)).tolist())], SCHEMA)
    assert clusters._meetings(rows, 0.4, 64).count() <= 2 * 6000


@pytest.mark.parametrize(("meet", "visits"), [(16, 0), (16384, 32)])
def test_links_reach_what_pairs_reach(spark, monkeypatch, meet, visits):
    _shifted(spark, monkeypatch, meet, visits)
    rows = listed(scenes(300, 40)) + listed(scenes(100, 60, seed=4), "loose", 1000) + listed([scenes(1, 1)[0]] * 80, "copies", 2000) + [(3000, "t", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    links = clusters.similar_links(df, 0.9, 32)
    pairs = {(a, b) for _, a, b in brute(rows, 0.9)}
    found = [(r.a, r.b) for r in links.collect()]
    assert set(found) <= pairs and (meet < 100 or len(found) < len(rows))
    got = {r.id: r.component for r in clusters.components(df, links).collect()}
    want = {r.id: r.component for r in clusters.components(df, spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    assert got == want and len(set(want.values())) > 40


@pytest.mark.parametrize("scale", [1.0, 1e-25, 3e14, 1e30])
@pytest.mark.parametrize("threshold", [0.3, 0.999999, 0.0, -2.0])
def test_products_equal_those_of_doubles(monkeypatch, threshold, scale):
    """Products just at the threshold, many, few and none of a block, numbers that single floats can't hold."""
    monkeypatch.setattr(clusters, "COLUMNS", 32)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(150, 24))
    v = np.concatenate([v, v[:40] + rng.normal(size=(40, 24)) * 1e-6, np.repeat(v[:1], 60, axis=0)])
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * scale
    a, b = v[:120], v[90:]
    exact = a @ b.T
    wanted = threshold * scale * scale
    i, j, score = clusters._comparing(a, b, wanted)(16, 110, 5, 150)
    part, near = exact[16:110, 5:150], np.abs(exact[16:110, 5:150] - wanted) <= 1e-14 * scale * scale
    found = np.zeros(part.shape, bool)
    found[i, j] = True
    assert len(i) == found.sum() and ((found == (part >= wanted)) | near).all()
    assert np.allclose(score, part[i, j], rtol=1e-12, atol=1e-14 * scale * scale)


def test_few_products_are_made_of_doubles(monkeypatch):
    """Unrelated vectors: all products were made of doubles, in blocks larger than the cache."""
    made, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda *x: made.append(len(x[1])) or einsum(*x))
    v = np.random.default_rng(12).normal(size=(5000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    i, _, _ = clusters._comparing(v, v, 0.6)(0, 128, 0, 5000)
    assert len(made) == 3 and len(i) <= sum(made) < 200


@pytest.mark.parametrize(("meet", "visits"), [(16, 0), (16384, 32)])
def test_stars_reach_what_pairs_reach(spark, monkeypatch, meet, visits):
    """Chains of vectors, whose trees of pairs are deep: in one meeting each leads to its least id at once."""
    _shifted(spark, monkeypatch, meet, visits)
    turn = np.linspace(0, 3, 120)
    chain = np.stack([np.cos(turn), np.sin(turn)], axis=1)[np.random.default_rng(6).permutation(120)]
    rows = listed(chain) + listed([scenes(1, 1)[0]] * 80, "copies", 2000) + [(3000, "t", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    links = clusters.similar_stars(df, 0.999, 16).collect()
    got = {r.id: r.component for r in clusters.components(df, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(120), 0), **dict.fromkeys(range(2000, 2080), 2000), 3000: 3000}
    frame = pd.DataFrame({"lo": 0, "hi": 0, "t": 0, "id": range(120), "vec": list(chain), "angle": 0.0, "resident": True, "theta": 3.2})
    found = clusters._stars(frame, 0.999)
    assert found["a"].tolist() == [0] * 119 and found["b"].tolist() == list(range(1, 120))


def test_plans_of_near_duplicates_stay_short(spark, monkeypatch):
    """The files' plan stood in the pairs' plan once for each use of the vectors, and the driver ran out of memory."""
    from lumenark.library import Library
    from lumenark.sources import schema

    seen, components, rounds = [], clusters.components, []
    monkeypatch.setattr(clusters, "components", lambda nodes, links: seen.append(links) or components(nodes, links))
    checkpoint = type(spark.range(1)).checkpoint
    turn = np.linspace(0, 3, 120)
    chain = np.stack([np.cos(turn), np.sin(turn)], axis=1)[np.random.default_rng(6).permutation(120)].tolist()
    vectors = spark.createDataFrame([(k, f"/x/{k}.jpg", v) for k, v in enumerate(chain)], schema.EMBEDDINGS)
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a, **k: rounds.append(1) or checkpoint(self, *a, **k))
    assert {r.component for r in Library(spark, {"embeddings": vectors}).near_duplicates(0.999).select("component").collect()} == {0}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and plan.count("\n") < 100
    assert len(rounds) <= 9
