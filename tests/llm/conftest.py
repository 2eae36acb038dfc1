import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents from (doc_id, text), with odd extra columns."""
    from pyspark.sql import functions as F

    def make(rows, lang="en", source="src1"):
        df = spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], SCHEMA)
        clashes = ("stay", "recipe", "fp", "place", "word", "row", "keep_id", "kept", "component_id", "mix_words", "copies", "count", "tokens", "n", "c", "shard", "length")
        return df.withColumns({c: F.lit(f"extra {c}") for c in clashes})

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def awkward():
    """Nulls in doc_id and text, empty and blank texts, ties, repeated rows, a very long text, and text of many kinds."""
    import random

    rng = random.Random(3)
    prose = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(20, prose[3]), (21, prose[3]), (22, prose[5] + " " + prose[6] + " " + prose[7])]
    rows += [(23, ""), (24, None), (25, " \t\n"), (26, "one"), (27, "ONE two"), (28, "é ß 漢字 \U0001f600 x" * 9), (28, "other text for the same id"), (29, prose[1]), (29, prose[1])]
    rows += [(None, prose[2]), (None, None), (40, " ".join(rng.choice(WORDS) for _ in range(60_000)))]
    return rows
