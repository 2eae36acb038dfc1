"""The filter audit, embedding whitening and toxicity against brute force on small fixtures."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.llm import audit, toxicity, whitening
from lumenark.llm.queries import op11_embedding_whitening

LABELS = "doc_id long, quality int, toxic int, note string"


# --- audit ----------------------------------------------------------------------------------------


def failures(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller]
    return {f for f, x in zip("ABCDE", fails) if x}


def audited(rows, labels):
    """rows (doc_id, text, lang) to {(part, order, step): counts}, order by order and row by row."""
    least, good, toxic = {}, set(), set()
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, quality, bad, _ in labels:
        good |= {i} if quality == 1 and i is not None else set()
        toxic |= {i} if bad == 1 and i is not None else set()
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        judged = [(i, failures(t or "", i is not None and least[t or ""] < i)) for i, t, lang in rows if (lang or "") == part]
        first = Counter()
        for order in permutations("ABCDE"):
            left = judged
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in judged) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in judged), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                first[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(first[order[step - 1]])
    return out


def got_audit(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_audit_equals_walking_every_order(spark, awkward):
    rng = random.Random(5)
    words = ["one", "Two", "THREE", "fo#ur", "five"] + [f"w{i}" for i in range(150)]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in awkward]
    rows += [(100 + i, " ".join(rng.choices(words[: rng.choice([3, 155])], k=rng.choice([5, 199, 200, 250]))), rng.choice(["en", "fr"])) for i in range(40)]
    rows += [(rng.randint(90, 160), rows[-1 - i][1], "de") for i in range(12)] + [(200 + i, "same text " * 150, "en") for i in range(30)] + [(200, "same text " * 150, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i, _, _ in rows if rng.random() < 0.7] + [(201, 1, 0, "x"), (201, 0, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("extra") for c in ("part", "own", "n", "sha", "good", "toxic", "least", "label")})
    assert got_audit(audit.audit(docs.repartition(3), spark.createDataFrame(labels, LABELS))) == audited(rows, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, labels).count() == 0
    one = audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels)
    assert got_audit(one) == audited([(1, None, None)], [])


def test_transform_inverts_the_parities(spark):
    rng = random.Random(2)
    counts = [rng.choice([0, 1, rng.randrange(10**12)]) for _ in range(32)]
    parities = [sum(c * (-1) ** bin(m & w).count("1") for m, c in enumerate(counts)) for w in range(32)]
    df = spark.createDataFrame([(parities,)], "parities array<long>")
    assert df.select(audit.cells(F.col("parities"))).first()[0] == counts


# --- whitening ------------------------------------------------------------------------------------


def whitened(rows, most=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by exact sums."""
    sound = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({x for _, x in sound})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    y = {x: [n * a - s for a, s in zip(x, sums)] for x in fit}
    cov = np.array([[float(Fraction(sum(v[a] * v[b] for v in y.values()), n**3)) for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(cov)
    out = {}
    for i, x in sound:
        for k in range(most):
            e, v = values[-1 - k], vectors[:, -1 - k]
            out[i, k + 1] = n, sum(a * a for a in y[x]), abs(float(np.dot([a / n for a in y[x]], v)) / e**0.5), e / np.trace(cov)
    return out


def check_whitened(df, rows):
    want, got = whitened(rows), {(r["vec_id"], r["component"]): r for r in df.collect()}
    assert got.keys() == want.keys()
    signs = {}
    for key, (n, deviation, size, share) in want.items():
        r = got[key]
        assert r["n"] == n and r["deviation"] == (deviation if deviation < 1 << 63 else None)
        assert abs(r["whitened"]) == pytest.approx(size, rel=1e-8, abs=1e-8) and r["explained"] == pytest.approx(share, rel=1e-9)
        signs.setdefault(key[1], set()).add(r["identity_error"])
    assert len({e for s in signs.values() for e in s}) == 1 and signs[1].pop() < 1e-4


def some_vectors(seed, n=60, d=7, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, d)) * np.arange(1, d + 1) + shift
    return [(k, [float(c) for c in v]) for k, v in enumerate(rows)]


@pytest.mark.parametrize("shift", [0.0, 1e6, -3e12])
def test_whitening_equals_exact_sums(spark, shift):
    rows = some_vectors(1, shift=shift)
    rows += [(100 + k, rows[3][1]) for k in range(40)] + [(200, None), (201, [1.0, None] + [0.0] * 5), (202, [float("nan")] * 7), (203, [float("inf")] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("extra") for c in ("x", "n", "component", "i", "size")})
    check_whitened(whitening.whiten(df.repartition(5)), rows)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, []), (4, None)], schema)).count() == 0  # one vector does not vary
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (3, [9.0])], schema)).collect()  # one direction; a row of another length
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], r["deviation"], abs(r["whitened"])) for r in two) == [(0, 1, 2, 512**2, 1.0), (1, 1, 2, 512**2, 1.0)]
    most = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [5.0, 2.0])], schema)).collect()  # beyond long: held at its bounds
    assert len(most) >= 3 and {r["deviation"] for r in most if r["vec_id"] == 1} == {None}


def test_products_are_exact_beyond_53_bits():
    rng = np.random.default_rng(7)
    for bits in (10, 40, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (300, 3))
        assert whitening.gram(y).tolist() == [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
        back = sum(d.astype(np.int64).astype(object) << (whitening.DIGIT * k) for k, d in enumerate(whitening.digits(y)))
        assert (back == y).all() and all(np.abs(d).max() <= 1 << (whitening.DIGIT - 1) for d in whitening.digits(y))
    assert 2 * (whitening.DIGIT - 1) + whitening.BLOCK.bit_length() - 1 <= 53


def test_whitening_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(op11_embedding_whitening(spark, "/root/testdata/sf0.001"), rows)


# --- toxicity -------------------------------------------------------------------------------------


def brute_grams(text):
    """Buckets of one text's n-grams, character by character."""
    letters = re.sub(" +", " ", " " + "".join(" " if ord(c) < 128 and not (c.isdigit() or c.islower()) else c for c in text.lower()) + " ")
    out = []
    for n in range(2, 8):
        for k in range(len(letters) - n + 1):
            gram = letters[k : k + n]
            if " " in gram[1:-1] or not gram.strip(" "):
                continue
            h = ord(gram[0])
            for c in gram[1:]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % (1 << 64)
            out.append(h >> (64 - toxicity.BUCKET_BITS))
    return out


@pytest.mark.parametrize("stride", [7, 64, 1 << 18])
def test_grams_in_pieces_equal_those_of_the_whole_text(monkeypatch, stride, awkward):
    monkeypatch.setattr(toxicity, "STRIDE", stride)
    texts = ["", " ", "a", "Ab", "don't,, stop  NOW!", "réeux über 漢字 \U0001f600 x", "x" * 90, "a b " * 20] + [t or "" for _, t in awkward[:12]]
    got = [[] for _ in texts]
    for places, buckets in toxicity.grams(texts):
        for p, b in zip(places.tolist(), buckets.tolist()):
            got[p].append(b)
    assert [sorted(g) for g in got] == [sorted(brute_grams(t)) for t in texts]


def labelled(spark, n=300, seed=4):
    rng = random.Random(seed)
    clean = "river stone bread window garden letter morning yellow quiet market".split()
    nasty = "idiot moron scum".split()
    rows, labels = [], []
    for i in range(n):
        words, bad = rng.choices(clean, k=rng.choice([3, 20, 60, 400])), int(rng.random() < 0.25)
        for _ in range(bad * max(1, len(words) // 25)):
            words.insert(rng.randrange(len(words)), rng.choice(nasty))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, bad, "x"))
    return rows, labels


def test_toxic_texts_of_the_held_out_fold_are_found(spark, documents):
    rows, labels = labelled(spark)
    rows += [(900, "the IDIOT!! came"), (901, "river bread garden"), (902, "you moron " + "bread " * 40), (903, None), (904, ""), (None, "scum idiot"), (905, rows[0][1]), (905, rows[0][1]), (906, "river window " * 40_000)]
    got = toxicity.score_toxicity(documents(rows).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    bad = {i: b for i, _, b, _ in labels}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    out = [r for r in got if r["held_out"] and r["doc_id"] in bad]
    assert len(out) > 40 and sum(r["predicted"] == bad[r["doc_id"]] for r in out) >= 0.97 * len(out)
    own = {r["doc_id"]: r["predicted"] for r in got}
    assert (own[900], own[901], own[902], own[None], own[903], own[904], own[906]) == (1, 0, 1, 1, 0, 0, 0)


def test_held_out_labels_do_not_matter(spark, documents):
    rows, labels = labelled(spark, 150)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, q, t, x in labels]
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents(rows), spark.createDataFrame(l, LABELS)).collect()} for l in (labels, flipped)]
    assert scores[0] == scores[1]


def test_toxicity_without_both_labels(spark, documents):
    docs = documents([(1, "one"), (2, None), (None, "three")])
    assert [r["score"] for r in toxicity.score_toxicity(docs, spark.createDataFrame([], LABELS)).collect()] == [0.0] * 3
    assert [r["score"] for r in toxicity.score_toxicity(docs, spark.createDataFrame([(1, None, 0, ""), (None, 1, 1, ""), (2, 1, None, "")], LABELS)).collect()] == [0.0] * 3
    rows, labels = labelled(spark, 40)
    assert toxicity.score_toxicity(documents([]), spark.createDataFrame(labels, LABELS)).count() == 0


def test_sample_is_bounded_and_weighted(spark, documents):
    rows, labels = labelled(spark, 300)
    sample, stands = toxicity.training_sample(documents(rows + rows[:50]).select("doc_id", "text"), spark.createDataFrame(labels, LABELS), 20)
    took = Counter(r["toxic"] for r in sample.collect())
    known = Counter(t for i, _, t, _ in labels if zlib.crc32(str(i).encode()) % 5)
    assert took == {0: 20, 1: 20} and stands == {t: n / 20 for t, n in known.items()}


def test_newton_steps_reach_the_minimum():
    rng = np.random.default_rng(3)
    x, y, importance = rng.normal(size=(80, 5)), (rng.random(80) < 0.4).astype(float), rng.random(80) + 0.5
    rows, columns = map(np.ravel, np.indices(x.shape))
    w = toxicity.fit_logistic((rows, columns, x.ravel()), y, importance, 5, 0.1)
    slope = x.T @ (importance * (1 / (1 + np.exp(-x @ w)) - y)) + 0.1 * w
    assert np.abs(slope).max() < 1e-3


def test_ratios_by_brute_force(spark, documents):
    rows, labels = labelled(spark, 60)
    column, ratios, _ = toxicity._model(documents(rows).select("doc_id", "text"), spark.createDataFrame(labels, LABELS), 1000)
    counts = {0: Counter(), 1: Counter()}
    for (_, text), (i, _, bad, _) in zip(rows, labels):
        if zlib.crc32(str(i).encode()) % 5:
            counts[bad].update(brute_grams(text))
    share = lambda c, b: (c[b] + toxicity.SMOOTHING) / (sum(c.values()) + toxicity.SMOOTHING * toxicity.BUCKETS)
    assert set(np.flatnonzero(column >= 0)) <= counts[0].keys() | counts[1].keys()
    for b in np.flatnonzero(column >= 0).tolist():
        assert ratios[column[b]] == pytest.approx(np.log(share(counts[1], b) / share(counts[0], b)))
