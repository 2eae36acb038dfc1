"""The k most alike of many queries against all products."""

import numpy as np
import pytest

from lumenark.operators import topk

SCHEMA = "id long, vec array<double>"


def scenes(n, count, d=24, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(count, d))
    v = (middle / np.linalg.norm(middle, axis=1, keepdims=True))[rng.integers(0, count, n)] + rng.normal(size=(n, d)) * spread
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, vectors, column="id"):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)], SCHEMA.replace("id", column)).repartition(3)


def brute(vectors, queries, k):
    out = set()
    for q, query in enumerate(queries):
        if query is not None:
            scored = sorted(((-round(float(np.dot(query, v)), topk.DIGITS), -key) for key, v in enumerate(vectors) if v is not None))[:k]
            out |= {(q, -key) for _, key in scored}
    return out


@pytest.mark.parametrize("k", [1, 7, 400])
@pytest.mark.parametrize("small", [True, False])
def test_same_as_all_products(spark, k, small, monkeypatch):
    if small:
        monkeypatch.setattr(topk, "SLICE", 40)
        monkeypatch.setattr(topk, "QUERIES", 5)
    v = list(scenes(260, 15)) + list(np.random.default_rng(2).normal(size=(40, 24))) + [None, np.zeros(24)]
    v += [v[0]] * 30  # copies
    queries = [*v[:6], v[270] * 3, -v[1], None, np.zeros(24), np.random.default_rng(3).normal(size=24)]
    index = topk.build(frame(spark, v))
    got = topk.search(index, frame(spark, queries, "query_id"), k).collect()
    assert {(r.query_id, r.key) for r in got} == brute(v, queries, k) and len(got) == len({(r.query_id, r.key) for r in got})
    assert all(r.score == pytest.approx(float(np.dot(queries[r.query_id], v[r.key])), abs=1e-9) for r in got)


def test_cells_are_left_out(spark):
    v = scenes(4000, 60, d=32, spread=0.02)
    index = topk.build(frame(spark, v))
    told = topk.looked_into(index, frame(spark, v[:50], "query_id"), 10).first()
    assert told.queries == 50 and told.cells > 50 and told.left_out > 0.8 * told.queries * told.cells and told.looked + told.left_out == told.queries * told.cells


def test_nothing(spark):
    assert topk.build(frame(spark, [])) is None
    index = topk.build(frame(spark, [[1.0, 0.0]]))
    assert topk.search(index, frame(spark, [], "query_id"), 3).count() == 0
    assert [tuple(r) for r in topk.search(index, frame(spark, [[0.5, 1.0]], "query_id"), 3).collect()] == [(0, 0, 0.5)]


def test_a_query_travels_once_a_shelf(spark, monkeypatch):
    """Vectors without clusters: each query looks into most cells, and went along with each of them."""
    monkeypatch.setattr(topk, "SLICE", 500)
    v = np.random.default_rng(4).normal(size=(2000, 24))
    v = list(v / np.linalg.norm(v, axis=1, keepdims=True))
    index = topk.build(frame(spark, v))
    first, _, second = topk._both(index, frame(spark, v[:30], "query_id"), 5)
    assert index.bounds.shelf.max() <= 4 and first.count() + second.count() <= 2 * 5 * 30
    got = topk.search(index, frame(spark, v[:30], "query_id"), 5).collect()
    assert {(r.query_id, r.key) for r in got} == brute(v, v[:30], 5)
