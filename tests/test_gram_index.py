"""The index of grams against a scan of all texts, for a table of queries."""

import random

import pytest

from lumenark.operators import grams, search

RNG = random.Random(4)
WORDS = "beach sunset drone iceland waterfall 10% rakuten é naïve straße İstanbul of a ab abc x. $5.00 wedding".split()
TEXTS = [" ".join(RNG.choices(WORDS, k=RNG.randint(0, 9))).replace("sunset", RNG.choice(["Sunset", "SUNSETS", "sun set"])) for _ in range(120)] + [None, "", " ", "\U0001f600 smile", "Ab", "tab\tand\nlines"]
QUERIES = ["beach", "drone Iceland", "ab", "a", "of a", "sunset  BEACH", "set", "10%", "é", "naïve straße", "İstanbul", "\U0001f600", "unheard", "beach unheard", "", "   ", "x.", "each ach", "wedding wedding", "tab and", "and lines", "$5.00 rakuten", "screenshot of", "a x b"]


@pytest.fixture(scope="module")
def frames(spark):
    rows = spark.createDataFrame([(i, t, f"extra {i}") for i, t in enumerate(TEXTS)] + [(3, "the beach twice", "again"), (None, "beach", "lost")], "file_id long, caption string, key string").repartition(3)
    return rows, spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")


def test_captions_of_all_queries(spark, frames):
    rows, queries = frames
    named = rows.filter("file_id IS NOT NULL")
    for limit in (None, 5):
        got = grams.captions(grams.index(rows, "file_id", "caption"), rows, queries, limit=limit).collect()
        for k, query in enumerate(QUERIES):
            want = sorted((r.file_id, r.caption, r.key) for r in search.captions(named, query, limit=None).collect())
            own = sorted((r.file_id, r.caption, r.key) for r in got if r.query_id == k)
            assert own == want if limit is None else len(own) == min(limit, len(want)) and [x[0] for x in own] == [x[0] for x in want][:limit]


def test_keywords_of_all_queries(spark, frames):
    tags = spark.createDataFrame([(f"/p/{i}", t, RNG.choice(["sea_lion", "Receipt", None]), RNG.choice(["Documents", "", None])) for i, t in enumerate(TEXTS)], "full_path string, text_sample string, top_label string, content_bucket string")
    found = grams.index(tags, "full_path", grams.hay())
    queries = [*QUERIES, "receipt documents", "sea beach beach"]
    got = grams.keywords(found, tags, spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), limit=7).collect()
    for k, query in enumerate(queries):
        want = [] if not search.S.search_tokens(query) else [(r.score, r.full_path) for r in search.keywords(tags, query, 7).collect()]
        assert sorted((-r.score, r.full_path) for r in got if r.query_id == k) == sorted((-s, p) for s, p in want)


def test_written_index_reads_row_groups_of_its_grams(spark, frames, tmp_path):
    rows, queries = frames
    grams.write(grams.index(rows, "file_id", "caption"), str(tmp_path / "index"))
    found = spark.read.parquet(str(tmp_path / "index"))
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,bea)]" in found.filter("gram = 'bea'")._jdf.queryExecution().toString()
    got = grams.captions(found, rows, queries.filter("query = 'beach'"), limit=None)
    assert got.count() == search.captions(rows.filter("file_id IS NOT NULL"), "beach", None).count() > 0


def test_nothing(spark, frames):
    rows, queries = frames
    none = rows.limit(0)
    assert grams.captions(grams.index(none, "file_id", "caption"), none, queries).count() == 0
    assert grams.captions(grams.index(rows, "file_id", "caption"), rows, queries.limit(0)).count() == 0


def test_grams_of_a_text(spark):
    """Each once, all that stand there, for code points of any size."""
    for text in ("a", "ab", "abab", "\x00\U0010ffff\x00é", "the theme"):
        got = [grams._gram(c) for c in grams._codes(text).tolist()]
        assert sorted(got) == sorted({text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)})


def test_texts_are_read_once_and_only_what_is_asked_moves(spark, frames):
    """All grams of all texts went through a shuffle, twice; the index is made once for a table of queries."""
    rows, queries = frames
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = rows.filter("file_id IS NOT NULL")
    found = grams.index(rows, "file_id", "caption").mapInArrow(counted, "gram string, key long")
    total = grams.index(rows, "file_id", "caption").count()
    assert grams.captions(found, rows, queries, limit=None).count() > 0 and made.value == total
