"""Nearest places by cells against all pairs: at random, over the date line, at the poles, on borders of cells, and for many places."""

import math
import random

import pytest

from lumenark.functions import rules as R
from lumenark.functions import scalar as S
from lumenark.operators import places

POINT = "id int, gps_latitude double, gps_longitude double, place_hint string"


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def spread(rng, n):
    """All over the sphere, and thick at the poles, along the date line, and at one place."""
    out = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    out += [(s * rng.uniform(87, 90), rng.uniform(-180, 180)) for s in (-1, 1) for _ in range(n // 6)]
    out += [(rng.uniform(-80, 80), rng.choice([-1, 1]) * rng.uniform(178, 180)) for _ in range(n // 6)]
    return out + [(48 + rng.uniform(-1, 1), 2 + rng.uniform(-1, 1)) for _ in range(n // 6)] + [(90.0, 0.0), (-90.0, 7.0), (0.0, 180.0), (0.0, -180.0), (10.0, 180.0)]


@pytest.mark.parametrize("reach", [20.0, 160.0, 2500.0, 25_000.0])
def test_same_as_all_pairs(spark, reach):
    rng = random.Random(int(reach))
    known, asked = spread(rng, 60), spread(rng, 120)
    known += known[:10]  # as near: the earlier one counts
    asked += [(0.0, 0.0), (None, 3.0), (4.0, None), (91.0, 0.0), (5.0, 200.0)] + asked[:20]
    gazetteer = spark.createDataFrame([(i, f"p{i}", a, b) for i, (a, b) in enumerate(known)], "i int, place string, lat double, lon double")
    points = spark.createDataFrame([(k, a, b, "x") for k, (a, b) in enumerate(asked)], POINT).repartition(3)
    got = {r.id: r.place for r in places.nearest(points, gazetteer, reach).collect()}
    assert len(got) == len(asked)
    for k, (a, b) in enumerate(asked):
        if a is None or b is None or (a, b) == (0, 0) or abs(a) > 90 or abs(b) > 180:
            assert got[k] is None
            continue
        near = sorted((km(a, b, *p), i) for i, p in enumerate(known))
        best = [i for d, i in near if d < reach and d <= near[0][0] + 1e-7]
        assert (got[k] is None and near[0][0] > reach - 1e-6) or got[k] in {f"p{i}" for i in best}
        if len({known[i] for i in best}) == 1:
            assert got[k] == f"p{min(best)}"


def test_same_as_the_rules_gazetteer(spark):
    rng = random.Random(9)
    points = spark.createDataFrame([(k, a + rng.uniform(-2, 2), b + rng.uniform(-2, 2), "") for k, (_, a, b) in enumerate(R.PLACES * 3)], POINT)
    gazetteer = spark.createDataFrame([(i, *p) for i, p in enumerate(R.PLACES)], "i int, place string, lat double, lon double")
    want = points.select("id", S.nearest_place("gps_latitude", "gps_longitude").alias("place"))
    assert sorted(map(tuple, places.nearest(points, gazetteer).select("id", "place").collect())) == sorted(map(tuple, want.collect()))


def test_many_places_and_a_hot_spot(spark):
    n = 100_000
    gazetteer = spark.range(n).selectExpr("cast(id AS int) AS i", "concat('p', id) AS place", "degrees(asin(2 * rand(1) - 1)) AS lat", "360 * rand(2) - 180 AS lon").persist()
    points = spark.range(20_000).selectExpr("cast(id AS int) AS id", "CASE WHEN id % 3 = 0 THEN 48.8 ELSE degrees(asin(2 * rand(3) - 1)) END AS gps_latitude", "CASE WHEN id % 3 = 0 THEN 2.3 ELSE 360 * rand(4) - 180 END AS gps_longitude", "'' AS place_hint").persist()
    got = places.nearest(points, gazetteer, 160.0).persist()
    assert got.count() == 20_000
    held = [(r.lat, r.lon, r.place) for r in gazetteer.collect()]
    for r in got.filter("id % 997 = 0").collect():
        d, name = min((km(r.gps_latitude, r.gps_longitude, a, b), p) for a, b, p in held)
        assert r.place == (name if d < 160 else None)
    assert got.filter("id % 3 = 0").select("place").distinct().count() == 1
    for df in (gazetteer, points, got):
        df.unpersist()
