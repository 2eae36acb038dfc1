import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", *columns).orderBy("i").drop("i").collect()]


def test_bucket(spark):
    got = one(spark, [(e,) for e in (".arw", ".DNG", ".mp4", ".xmp", ".zzz", None, ".lrv", ".insp")], "e string", S.bucket("e"))
    assert [r[0] for r in got] == ["raw", "raw", "videos", "sidecar", "other", "other", "videos", "sidecar"]


DEVICES = [
    ("", "", ".insv", "VID_001.insv", False, "Insta360"), ("", "", ".gpr", "GX010001.gpr", False, "GoPro"), ("", "", ".arw", "DSC01234.arw", False, "Sony"), ("", "", ".heic", "IMG_1234.heic", False, "iPhone"),
    ("", "", ".mp4", "DJI_0001.mp4", False, "Drone"), ("Canon", "EOS R5", ".cr3", "x.cr3", False, "Canon"), (None, None, ".txt", "notes.txt", False, "Unknown"), ("", "", ".dng", "x.dng", True, "Drone"),
    ("DJI", "Osmo Pocket 3", ".mp4", "DJI_0007.mp4", False, "Osmo Pocket"), ("", "OSMO POCKET", ".jpg", "x.jpg", False, "Osmo Pocket"), ("DJI", "FC7303", ".dng", "DJI_0001.dng", True, "Drone"),
    ("Arashi Vision", "Insta360 X4", ".mp4", "x.mp4", False, "Insta360"), ("Insta360", "One RS", ".jpg", "x.jpg", False, "Insta360"), ("Hasselblad", "X2D", ".jpg", "x.jpg", False, "Hasselblad"),
]


def test_device(spark):
    got = one(spark, [r[:5] for r in DEVICES], "mk string, md string, e string, n string, a boolean", S.device("mk", "md", "e", "n", F.col("a")))
    assert [r[0] for r in got] == [r[5] for r in DEVICES]


def test_stage(spark):
    rows = [(".xmp", "x.xmp", False, ""), (".jpg", "sunset-edit.jpg", False, ""), (".jpg", "plain.jpg", True, ""), (".jpg", "plain.jpg", False, "Exports"), (".arw", "DSC0001.arw", False, None), (".prproj", "a.prproj", False, "")]
    got = one(spark, rows, "e string, n string, s boolean, f string", S.stage("e", "n", F.col("s"), "f"))
    assert [r[0] for r in got] == ["sidecar", "edited", "edited", "edited", "original", "edited"]


def test_orientation(spark):
    rows = [(4000, 3000, False), (3000, 4000, False), (4000, 3000, True), (0, 0, False), (None, None, False), (5, 5, True)]
    got = one(spark, rows, "w long, h long, r boolean", S.orientation("w", "h", F.col("r")))
    assert [r[0] for r in got] == ["Horizontal", "Vertical", "Vertical", "Unknown", "Unknown", "Horizontal"]


def test_dates_and_slugs(spark):
    got = one(spark, [("2024:06:02 10:00:00", None), (" ", "2023-03-01"), (None, "2023"), (None, None)], "a string, b string", S.year_month("a", "b"))
    assert [r[0] for r in got] == ["2024-06", "2023-03", "", ""]
    got = one(spark, [("Bora Bora / Trip!",), ("!!!",)], "a string", S.slug("a"))
    assert [r[0] for r in got] == ["Bora-Bora-Trip", "Untitled"]


def test_trip_rules(spark):
    rows = [("Costa Rica 2024",), ("iceland_trip",), ("o'neil fall-2024 trip3x vík_a",), ("",), (None,), ("__",), ("Sony Camera 15",)]
    got = one(spark, rows, "f string", S.trip_label("f"), S.trip_category("f"))
    assert got == [("Costa Rica", "trips"), ("Iceland", "trips"), ("O'Neil Fall-2024 Trip3X Vík A", "trips"), ("(Root)", "trips"), ("(Root)", "trips"), ("(root)", "trips"), ("Camera Card Dumps", "camera-dumps")]


def test_nearest_place(spark):
    rows = [(64.13, -21.90), (-16.50, -151.74), (51.17, -115.57), (0.0, 0.0), (5.0, -140.0), (None, None)]
    got = one(spark, rows, "a double, o double", S.nearest_place("a", "o"))
    assert [r[0] for r in got] == ["Reykjavík", "Bora Bora", "Banff", None, None, None]


def test_refined_trips(spark):
    rows = [("Iceland_Trip", 48.8, 2.3, "2024-09-01"), ("Sony Camera 15", 64.13, -21.90, "2024:06:02 10:00:00"), ("Sony Camera 15", None, None, "2023-03-01"), ("unsorted", None, None, None)]
    trip = S.refined_trip(S.trip_label("f"), S.trip_category("f"), S.nearest_place("a", "o"), S.year_month("d"))
    got = one(spark, rows, "f string, a double, o double, d string", trip)
    assert [r[0] for r in got] == ["Iceland", "Reykjavík 2024", "Camera Dump 2023", "Unsorted"]


def test_query_filters(spark):
    rows = [("drone sunset 2024",), ("vertical iphone portraits",), ("waterfall",), ("beach photos july",), (None,)]
    got = [tuple(r[0]) for r in one(spark, rows, "q string", S.query_filters("q"))]
    assert got == [("Drone", None, 2024, None, "sunset"), ("iPhone", "Vertical", None, None, "portraits"), (None, None, None, None, "waterfall"), (None, None, None, 7, "beach photos"), (None, None, None, None, None)]


@settings(max_examples=30, deadline=None)
@given(words=st.lists(st.text("abcXYZ019", min_size=1, max_size=6), max_size=8))
def test_lexical_embedding_is_the_signed_hash(spark, words):
    import hashlib

    v = [0.0] * R.EMBED_DIM
    for t in re.findall("[a-z0-9]+", " ".join(words).lower()):
        h = int(hashlib.sha1(t.encode()).hexdigest(), 16)
        v[h % R.EMBED_DIM] += 1.0 if (h >> 8) & 1 else -1.0
    n = sum(x * x for x in v) ** 0.5
    got = spark.range(1).select(S.lexical_embedding(F.lit(" ".join(words)))).first()[0]
    assert got == pytest.approx([x / n for x in v] if n else v)


def test_path_parts(spark):
    rows = [("/a/b/.hidden", "/a"), ("/a/b/X.ARW.xmp", "/a"), ("/z/DSC_Iceland2023.jpg", "/q")]
    got = one(spark, rows, "p string, r string", S.stem(S.basename("p")), S.suffix(S.basename("p")), S.dirname("p"), S.path_words("p"), S.rewritten("p", "r", "r"))
    assert [r[:3] for r in got] == [(".hidden", "", "/a/b"), ("X.ARW", ".xmp", "/a/b"), ("DSC_Iceland2023", ".jpg", "/z")]
    assert got[2][3] == " z DSC Iceland2023"


def test_snippet_and_buckets(spark):
    body = "x" * 50 + "Receipt" + "y" * 90
    got = one(spark, [(body,), ("none",)], "t string", S.snippet(F.col("t"), ["zz", "receipt"]))
    assert [r[0] for r in got] == [body[20:120], "none"]
    rows = [(["Scarf"], False, None), (["thing"], True, "long enough text"), (["Paper"], True, "ab"), ([], False, ""), (["sea_lion"], False, None)]
    got = one(spark, rows, "l array<string>, h boolean, s string", S.content_bucket(F.col("l"), F.col("h"), F.col("s")))
    assert [r[0] for r in got] == ["Vehicles", "Documents", "Documents", "Unsorted", "Nature"]
