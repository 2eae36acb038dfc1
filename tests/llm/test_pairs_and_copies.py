"""Fingerprints, SimHash, exact dedup and substring dedup against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenark.llm import exact_dedup, simhash, sketches, substrings


def key(i):
    return -1 if i is None else i


# --- exact dedup ----------------------------------------------------------------------------------------


def check_exact(rows, got):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = sorted((key(i), key(max(groups[t or ""], key=key)), len(groups[t or ""]), key(i) == key(max(groups[t or ""], key=key)), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_dedup(documents, awkward):
    check_exact(awkward, exact_dedup.exact_dedup(documents(awkward)).collect())
    assert exact_dedup.exact_dedup(documents([])).count() == 0


def test_colliding_digests_are_found_out(documents, awkward):
    weak = (lambda b: b[:1], lambda b: hashlib.md5(b).digest())
    check_exact(awkward, exact_dedup.exact_dedup(documents(awkward), weak).collect())
    with pytest.raises(ValueError):
        exact_dedup.recipes(documents(awkward), weak[:1])


def test_keep_one_leaves_whole_rows(documents, awkward):
    df = documents(awkward)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len({t or "" for _, t in awkward})


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=4), st.binary(max_size=3000))
def test_cuts_depend_on_the_text_alone(others, text):
    alone = exact_dedup.cuts([text])[0]
    assert exact_dedup.cuts([*others, text, *others])[len(others)] == alone
    assert (alone[-1] if alone else 0) == len(text) and all(a < b <= a + exact_dedup.MOST for a, b in zip([0, *alone], alone))


# --- SimHash ---------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = dict.fromkeys(prints)
    for a in label:
        label[a] = a
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(documents, awkward):
    rows = awkward + [(60 + i, f"{awkward[8][1]} {w}") for i, w in enumerate("abc")]
    prints = [brute_fingerprint(t or "") for _, t in rows]
    label = brute_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    want = sorted((key(i), f"{p:016x}", least.get(label[p])) for (i, _), p in zip(rows, prints))
    got = simhash.near_duplicates(documents(rows)).collect()
    assert sorted((key(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(documents([])).count() == 0


def test_links_are_all_found(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64) << np.uint64(1)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(b ^ sum(1 << int(f) for f in flips))
    prints |= {0, 1, 7, (1 << 64) - 1, (1 << 64) - 8}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    want = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for a in prints for b in prints if 0 < (a ^ b).bit_count() <= 3}
    found = [tuple(r) for r in simhash.near_links(nodes).collect()]
    assert set(found) == want and len(found) == len(want)


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 131), 100), **dict.fromkeys(range(200, 209), 200)}


# --- near copies -------------------------------------------------------------------------------------------


def long_bits(text):
    return int.from_bytes(simhash.long_fingerprint(simhash.shingles(text.encode())).tobytes(), "little")


@pytest.mark.parametrize("spare, recall, big", [(10, 0.95, 64), (0, 0.99999, 3)])  # all in one cell; many choices of cells of 7 bits
def test_the_pipeline_drops_near_copies(documents, awkward, monkeypatch, spare, recall, big):
    import corpus_pipeline

    for name, value in (("SPARE", spare), ("RECALL", recall), ("BIG", big)):
        monkeypatch.setattr(simhash, name, value)
    rng, rows = np.random.default_rng(8), [r for r in awkward if r[0] != 40]
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 9999, 200)]
        for copy in range(5):  # words replaced: similarities on both sides of 0.8
            changed = list(words)
            for at in rng.choice(200, 3 * copy, replace=False):
                changed[at] = f"new{k}.{copy}.{at}"
            rows.append((1000 + 10 * k + copy, " ".join(changed)))
    texts = sorted({t or "" for _, t in rows})
    label, bits = dict(zip(texts, texts)), {t: long_bits(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if label[a] != label[b] and (bits[a] ^ bits[b]).bit_count() <= 104:
                old, new = label[a], label[b]
                label = {t: new if x == old else x for t, x in label.items()}
    least = {}
    for i, t in rows:
        place = float("inf") if i is None else i
        least[label[t or ""]] = min(place, least.get(label[t or ""], place))
    df = documents(rows)
    kept = corpus_pipeline.distant_documents(None, df, "")
    assert kept.columns == df.columns
    assert sorted(float("inf") if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.keep_one(documents([])).count() == 0


@pytest.mark.parametrize("tile, big", [(1 << 18, 64), (40, 3)])  # all in one tile; tiles that meet
def test_near_copies_that_share_no_cell_are_linked(documents, monkeypatch, tile, big):
    """One choice of 25 counts: nearly all near copies lie in different cells."""
    for name, value in (("SPARE", -40), ("RECALL", 1e-9), ("TILE", tile), ("BIG", big)):
        monkeypatch.setattr(simhash, name, value)
    rng, texts = np.random.default_rng(9), {}
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 9999, 200)]
        for copy in range(14):
            changed = list(words)
            for at in rng.choice(200, copy, replace=False):
                changed[at] = f"new{k}.{copy}.{at}"
            texts[100 * k + copy] = " ".join(changed)
    bits, label = {i: long_bits(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and label[i] != label[j] and (bits[i] ^ bits[j]).bit_count() <= 104:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    assert simhash.grids(len(texts)).shape == (1, 25) and len(set(label.values())) < 100
    assert sorted(r.doc_id for r in simhash.keep_one(documents(list(texts.items()))).collect()) == sorted(set(label.values()))


def test_meetings_find_all_that_is_apart(monkeypatch):
    """Against all pairs: words that cancel out, groups known before, borders of blocks."""
    for name, value in (("ROWS", 4), ("COLUMNS", 8), ("BIG", 5)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(10)
    bits = np.repeat(rng.integers(0, 2, (12, simhash.BITS), np.uint8), 8, axis=0)
    for row in bits:
        row[rng.choice(simhash.BITS, rng.integers(0, 90), replace=False)] ^= 1
    bits[90] = bits[91] ^ 1  # all bits differ
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T.copy()
    ids = rng.permutation(96) * 3 - 50
    roots = np.where(np.arange(96) < 24, ids[np.arange(96) // 8 * 8], ids)
    close = (bits[:, None] != bits).sum(-1) <= simhash.WITHIN

    def groups(pairs):
        label = dict(zip(ids.tolist(), roots.tolist()))
        for a, b in pairs:
            old, new = label[a], label[b]
            label = {k: new if x == old else x for k, x in label.items()}
        return {frozenset(k for k, x in label.items() if x == y) for y in label.values()}

    t = rng.integers(0, 3, 96)
    found = [p for lo in range(3) for hi in range(lo, 3) for m in [(t == lo) | (t == hi)] for p in simhash._joined(lo, hi, t[m], ids[m], roots[m], words[:, m])]
    place = {k: n for n, k in enumerate(ids.tolist())}
    assert all(close[place[a], place[b]] for a, b in found)
    want = groups((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(close)))
    assert groups(found) == want and 12 < len(want) < 80
    assert len(simhash._joined(0, 0, np.zeros(96, int), ids, roots, words)) == len(set(roots.tolist())) - len(want)


def test_bits_differ_by_the_angle():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600).astype(np.uint64)]))
    differ = np.unpackbits(simhash.long_fingerprint(a) ^ simhash.long_fingerprint(b)).mean()
    assert abs(differ - np.arccos(0.8) / np.pi) < 0.04


def test_cells_are_of_counts_and_find_pairs():
    """Segments whose bits change places keep their cells; a pair that differs in as many bits as it may shares one as often as RECALL says."""
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, (400, simhash.BITS), np.uint8)
    pack = lambda x: np.packbits(x, axis=1, bitorder="little")
    counts = simhash.embedded(pack(bits))
    assert (counts == bits.reshape(400, -1, 2).sum(-1)).all()
    turned = bits.reshape(400, -1, 2)[:, :, ::-1].reshape(400, -1)

    def cells(x):
        batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array([r.tobytes() for r in pack(x)], pa.binary())], ["id", "root", "bits"])
        return next(simhash._cells(choices)(iter([batch]))).column("cell").to_numpy().reshape(400, -1)

    choices = simhash.grids(200_000)
    assert (cells(bits) == cells(turned)).all()
    other = bits.copy()
    for row in other:
        row[rng.choice(simhash.BITS, simhash.WITHIN, replace=False)] ^= 1
    assert (np.abs(simhash.embedded(pack(other)).astype(int) - counts).sum(1) <= simhash.WITHIN).all()
    assert (cells(bits) == cells(other)).any(1).mean() > simhash.RECALL - 0.04
    apart = (cells(bits) == cells(bits[::-1])).mean()  # by chance
    assert apart < 2 * 2**simhash.SPARE / 200_000


# --- sketches ----------------------------------------------------------------------------------------------


def brute_hashes(text):
    words, hashes = text.encode().split(), []
    for i in range(max(len(words) - 5, 0) + 1 if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w, h)
        hashes.append(h - (1 << 64) if h >> 63 else h)
    return hashes


def brute_sketch(text):
    """Hashes below the threshold, and the least one where there are none."""
    hashes = brute_hashes(text)
    kept = sorted({h for h in hashes if h < -(1 << 63) + (1 << 64) // sketches.SCALE})
    return kept, None if kept or not hashes else min(hashes)


def brute_string(text):
    kept, least = brute_sketch(text)
    return ",".join(f"{h % (1 << 64):016x}" for h in kept) if kept or least is None else f"~{least % (1 << 64):016x}"


def brute_likeness(a, b):
    (a, x), (b, y) = brute_sketch(a), brute_sketch(b)
    return float(x == y) if not a and not b else len({*a} & {*b}) / len({*a} | {*b})


def test_fingerprints(documents, awkward):
    rows = [r for r in awkward if r[0] != 28 or "other" not in r[1]]  # ids repeat with one text only
    by_id = {i: t or "" for i, t in rows if i is not None}
    ids = sorted(by_id)
    follow = {i: by_id[j] for i, j in zip(ids, ids[1:] + ids[:1])}
    want = []
    for i, t in rows:
        t, after = t or "", follow.get(i, "")
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        want.append((key(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_string(t), brute_string(edited), brute_likeness(t, edited), brute_likeness(t, after) if i is not None else 0.0))
    got = sketches.fingerprints(documents(rows)).collect()
    assert sorted((key(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == sorted(want)
    assert sketches.fingerprints(documents([])).count() == 0
    assert sketches.fingerprints(documents(awkward)).count() == len(awkward)
    alone = sketches.fingerprints(documents([(7, "abcdefgh")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("f \f\t\n\x0bab", max_size=40), min_size=1, max_size=12, unique=True))
def test_sketches_of_letters_f_and_form_feeds(documents, texts):
    got = {r.doc_id: r.fingerprint for r in sketches.fingerprints(documents(list(enumerate(texts)))).collect()}
    assert got == {i: brute_string(t) for i, t in enumerate(texts)}


def test_form_feeds_are_space_and_the_letter_f_is_not(documents):
    rows = [(1, "\fa page that starts with a form feed"), (2, "and one that ends so\f\f"), (3, "ffor the life of f"), (4, "fff"), (5, "\f"), (6, "f"), (7, "\f \fother words")]
    got = {r.doc_id: r.fingerprint for r in sketches.fingerprints(documents(rows)).collect()}
    assert got == {i: brute_string(t) for i, t in rows}


def test_sketches_merge(spark):
    """The union of two sketches is the sketch of all shingles of both, short texts without a kept hash included."""
    from pyspark.sql import functions as F

    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"v{i}" for i in range(2000))
    rows = [(a, b), (a, "one"), ("one", "two"), ("", b), ("p q r", "s t u v w x")]
    df = spark.createDataFrame(rows, "a string, b string")
    for c in ("a", "b"):
        df = sketches.with_sketch(df, c, f"s_{c}")
    for row in df.withColumn("m", sketches.merged("s_a", "s_b")).collect():
        assert row.m == sorted({h for t in (row.a, row.b) for h in brute_hashes(t) if h < -(1 << 63) + (1 << 64) // sketches.SCALE})
    whole = sketches.with_sketch(spark.createDataFrame([(a, f"{a} {b}")], "a string, whole string"), "a", "s_a")
    row = sketches.with_sketch(whole, "whole", "s_whole").select(sketches.containment("s_a", "s_whole").alias("c"), F.size("s_a").alias("n")).first()
    assert row.c == 1.0 and 60 < row.n < 140


# --- substring dedup -----------------------------------------------------------------------------------------


def brute_removed(rows):
    place = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            at = tuple(w[k : k + 13])
            first[at] = min(first.get(at, place(i)), place(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < place(i):
                gone[k : k + 13] = [True] * 13
        out.append((key(i), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def test_substring_dedup(documents, awkward):
    rows = awkward + [(70, "a b " * 30), (71, "a b " * 20 + "c"), (72, "same " * 50), (73, "x " + "same " * 14)]
    got = substrings.remove_repeats(documents(rows)).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows)
    assert substrings.remove_repeats(documents([])).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab c\n", max_size=120), min_size=1, max_size=6))
def test_substring_dedup_of_few_words(documents, texts):
    rows = list(enumerate(texts))
    got = substrings.remove_repeats(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows)


def test_edges_that_stand_apart_in_their_source_are_verified(documents):
    """Windows that follow each other in a text, and stand in its source in another order."""
    w = [f"w{k}" for k in range(14)]
    rows = [(1, " ".join(w[1:14] + ["x"] + w[0:13])), (2, " ".join(w)), (3, "a b " * 9 + "c"), (4, "b " + "a b " * 12)]
    assert substrings.unverified(documents(rows), substrings.repeated_runs(documents(rows))) == 0
    got = substrings.remove_repeats(documents(rows)).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows)


def test_texts_handled_together_have_paths_of_their_own():
    """A text's anchors and paths are the same whatever stands before and after it, and a batch of many texts is hashed few times."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, n)).encode() for n in (13, 60, 5, 0, 14, 200, 12, 40)]

    def anchors(rows):
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([0] * len(rows)), pa.array([t.decode() for _, t in rows])], ["place", "spot", "text"])
        return [r for out in substrings._anchors(0)(iter([batch])) for r in out.to_pylist()]

    rows, made = list(enumerate(texts)), []
    alone = [r for row in rows for r in anchors([row])]
    whole, init = substrings.Ranges, substrings.Ranges.__init__
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(whole, "__init__", lambda self, words, seed=0: (made.append(len(words)), init(self, words, seed))[1])
        assert anchors(rows) == alone and made == [sum(len(t.split()) for t in texts if len(t.split()) >= 13)]


def test_spans_are_verified_at_their_source(documents, awkward, monkeypatch):
    """With a word hash of few values spans that differ are taken for equal; the comparison finds them, and another seed is tried."""
    rows = [*[r for r in awkward if r[0] != 40], (70, "a b " * 30), (71, "a b " * 20 + "c"), (72, " ".join(f"w{k}" for k in range(40))), (73, " ".join(f"v{k}" for k in range(40)) + " x")]
    monkeypatch.setattr(substrings, "HOT", 2)  # and most anchors are joined as hot or by key alike
    docs = documents(rows)
    assert substrings.unverified(docs, substrings.repeated_runs(docs)) == 0

    class Weak(substrings.Ranges):
        def __init__(self, words, seed=0):
            super().__init__(words, seed)
            if seed == 0:
                self.words = np.array([len(w) > 2 for w in words], np.uint64)

    monkeypatch.setattr(substrings, "Ranges", Weak)
    wrong = substrings.repeated_runs(docs)
    assert substrings.unverified(docs, wrong) > 0
    got = substrings.remove_repeats(docs).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows)
