"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into segments, and each segment mapped to its count of ones. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so vectors are laid on a grid, those
that share a cell or lie one step apart meet by a join on the cell, and candidates are verified.

`near_duplicates` links 64-bit fingerprints at 3 bits or fewer, exactly. Of two such fingerprints one half differs in at
most one bit. Its 16 segments of two bits then have equal counts, or are one step apart (a step changes the
parity, so asking from the odd side loses nothing). The other half, in segments of one bit, differs in at most
three bits in the first case and two in the second: of its 4 or 3 pieces one is equal, and its number lengthens the cell. Some
83 rows a fingerprint; between N random fingerprints some 5e-9 N**2 candidate pairs.

`keep_one` drops near copies: texts whose fingerprints over five-word shingles say that the cosine of their sets of shingles is 0.8 or
more (two SimHash bits differ with the probability of angle / pi; sets with a Jaccard similarity of 0.8 have a cosine of 0.89).
That is a fifth of the bits, so these fingerprints are BITS long: vectors of BITS / 2 counts, of segments of two bits, and the grid is laid over
many choices of them; a cell has as many counts as leave 2**SPARE of N texts in it by chance, and there would be as many choices as find a pair that
differs in as many bits as it may with the probability RECALL; FIRST of them are used. Candidates are verified by the exact distance of their
whole fingerprints, which go along with each cell. Only components are asked for: first, in ROUNDS, each text is linked to the nearest
of its cells' representatives that it is not linked to yet, which joins a large group by few links. Cells may miss a pair, and at a fifth of the
bits no choice of pieces is sure to find all; so then all texts meet, tile by tile, and all that is still apart is compared: every link is found, and the
work of this step grows with the square of the number of texts. A large known group is not compared within itself.

Equal fingerprints, or texts, are one node, so copies never meet in pairs. Components come from alternating
star contraction over the links, checkpointed each round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import cut, only, prepare, release, spool, whole_text

SEED, SHINGLE, RADIUS = 42, 3, 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes) -> int:
    """Of a text in UTF-8, as an unsigned number; 0 if it has no word."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % three for three in zip(words, words[1:], words[2:])]
    digest = xxhash.xxh64_intdigest
    n, ones = len(shingles), np.zeros(64, np.int64)
    bits = np.unpackbits(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    for at in range(0, n, 255):  # sums of 255 bits fit a byte, which numpy adds fastest
        ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(found.view(np.int64))], ["doc_id", "text_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, fp): the text's xxhash64, the fingerprint's bits as a signed long; a null text counts as empty."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_id"), whole_text().alias("text"))
    return texts.mapInArrow(_fingerprints, "doc_id long, text_id long, fp long")


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: the different fingerprints of nodes (fp, distinct) that differ in 1 to 3 bits."""
    words = nodes.selectExpr("fp", "fp & 4294967295L AS x0", "shiftrightunsigned(fp, 32) AS x1")
    # Two-bit fields of counts 0 to 2: each pair of bits less its upper bit.
    count = "x{0} - (shiftrightunsigned(x{0}, 1) & 1431655765L) AS v{0}"
    halves = words.selectExpr("fp", "x0", "x1", count.format(0), count.format(1), "bit_count(x0) % 2 = 1 AS odd0", "bit_count(x1) % 2 = 1 AS odd1")

    def pieces(h: int, widths: tuple[int, ...]) -> str:
        """Of the other half: what goes above the 32 bits of a cell of half h: which half, which piece of how many, its bits."""
        out, at = [], 0
        for j, width in enumerate(widths):
            kind = (h * 2 + len(widths) % 2) * 4 + j
            out.append(f"shiftleft((shiftrightunsigned(x{1 - h}, {at}) & {(1 << width) - 1}L) + {kind << 11}L, 32)")
            at += width
        return f"array({', '.join(out)})"

    def steps(h: int) -> str:
        up = f"filter(sequence(0, 15), i -> (shiftrightunsigned(v{h}, 2 * i) & 3) < 2)"
        down = f"filter(sequence(0, 15), i -> (shiftrightunsigned(v{h}, 2 * i) & 3) > 0)"
        return f"concat(transform({up}, i -> v{h} + shiftleft(1L, 2 * i)), transform({down}, i -> v{h} - shiftleft(1L, 2 * i)))"

    three, four, none = (11, 11, 10), (8, 8, 8, 8), "cast(array() AS array<bigint>)"
    same = "concat({})".format(", ".join(f"transform({pieces(h, four)}, p -> p + v{h})" for h in (0, 1)))
    even = "concat({})".format(", ".join(f"IF(odd{h}, {none}, transform({pieces(h, three)}, p -> p + v{h}))" for h in (0, 1)))
    odd = "concat({})".format(", ".join(f"IF(odd{h}, flatten(transform({pieces(h, three)}, p -> transform({steps(h)}, v -> p + v))), {none})" for h in (0, 1)))
    own = halves.selectExpr("fp AS b", f"explode(concat({same}, {even})) AS cell")
    asked = halves.selectExpr("fp AS a", f"inline(concat(transform({same}, c -> struct(c AS cell, true AS same)), transform({odd}, c -> struct(c AS cell, false AS same))))")
    pairs = asked.hint("merge").join(own, "cell").filter(f"(a < b OR NOT same) AND a <> b AND bit_count(a ^ b) <= {RADIUS}")
    return pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of links (a, b), by star contraction."""
    edges, before = cut(links.select("a", "b")), None
    while True:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.filter("b > a").join(least, "a").selectExpr("b AS a", "m AS b").filter("a <> b").distinct()  # b < a from here on
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").selectExpr("b AS a", "m AS b").unionByName(least.selectExpr("a", "m AS b")).distinct()
        edges = cut(small.selectExpr("least(a, b) AS a", "greatest(a, b) AS b"))
        release(links.sparkSession)  # of a round's small shuffles, which add up where there are many partitions
        now = tuple(edges.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) AS decimal(38, 0))"))).first())
        if now == before:
            break
        before = now
    # Now all edges lead from a root to its nodes.
    stars = edges.selectExpr("b AS node", "a AS root")
    return stars.unionByName(stars.selectExpr("root AS node", "root").distinct())


def _classes(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_id (the text's xxhash64), fp, root (least fingerprint reachable), n_links, component_id."""
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    links = cut(near_links(nodes.select("fp")))
    roots = components(links)
    degree = links.selectExpr("explode(array(a, b)) AS fp").groupBy("fp").agg(F.count("*").alias("n_links"))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").selectExpr("fp", "coalesce(root, fp) AS root", "least_id").join(degree, "fp", "left")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = cut(named.join(least, "root").select("fp", "root", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, any more): doc_id, fingerprint, component_id, n_links.

    Fingerprints at 3 or fewer differing bits are linked; component_id is the smallest doc_id
    reachable over links, n_links the number of other fingerprints linked to the row's own. Texts
    without a word have fingerprint zero and link like any other. A null text counts as empty; a
    null doc_id keeps its row and never names a component unless all of it is null.
    """
    return _classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


# --- near copies --------------------------------------------------------------------------------------------

#: Words of a shingle, and the least cosine of two near copies.
COPY_SHINGLE, SIMILAR = 5, 0.8
BITS = 512
SEGMENTS = BITS // 2
#: Differing bits of two near copies, at most.
WITHIN = math.floor(BITS * math.acos(SIMILAR) / math.pi)
#: Texts that share a cell by chance are 2**SPARE; a pair that differs in WITHIN bits is found with the probability RECALL.
SPARE, RECALL = 10, 0.95
#: Rounds of comparisons with representatives, the choices of segments they look at, and the representatives of a cell in
#: the first round and in others.
ROUNDS, FIRST, DRAWN = 2, 8, (2, 32)
#: Texts of a group known to be linked, from which on it is left out of comparisons within itself.
BIG = 64
#: Texts of a tile at most where all meet, and tiles at least (where they have some 1,024 texts), for tasks to share the work.
TILE, TILES = 1 << 18, 16
#: Texts of two tiles that are compared at once.
ROWS, COLUMNS = 16, 2048
#: The fingerprint as longs.
WORDS = [f"w{k}" for k in range(BITS // 64)]
CELLS = ", ".join(f"{c} long" for c in ("cell", "id", "root", *WORDS))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text in UTF-8; fewer than five words, or none, are one shingle."""
    words = text.translate(LOWER).split()
    joined = {b" ".join(five) for five in zip(*(words[k:] for k in range(COPY_SHINGLE)))} or {b" ".join(words)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(joined)))


def long_fingerprint(keys: np.ndarray) -> np.ndarray:
    """BITS bits, packed little-endian: set if so in over half of the shingles' hashes, each drawn out by a finalizer."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(keys), 255):
        x = keys[at : at + 255, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(keys), bitorder="little")


def embedded(packed: np.ndarray) -> np.ndarray:
    """Of fingerprints (rows of bytes) the counts of ones in their segments of two bits."""
    fields = packed - ((packed >> 1) & 0x55)
    return np.stack([(fields >> at) & 3 for at in (0, 2, 4, 6)], axis=-1).reshape(len(packed), SEGMENTS)


def grids(n: int) -> np.ndarray:
    """By row: the segments that make the cells of one choice, for n texts."""
    # Counts of unrelated texts are equal with the probability 3/8.
    size = min(25, max(0, math.ceil((math.ceil(math.log2(max(n, 1))) - SPARE) / math.log2(8 / 3))))
    # Counts of a pair are equal where no bit differs, or both do and there is one in each; j: segments of the second kind.
    met = sum(math.comb(size, j) * math.comb(BITS - 2 * size, WITHIN - 2 * j) / 2**j for j in range(size + 1)) / math.comb(BITS, WITHIN)
    count = 1 if met == 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - met))
    rng = np.random.default_rng(SEED)
    return np.array([rng.choice(SEGMENTS, size, replace=False) for _ in range(count)], np.int64).reshape(count, size)


def _long_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [long_fingerprint(shingles(text)).tobytes() for text in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "bits"])


def _cells(choices: np.ndarray):
    """A row of CELLS for each text and choice of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, size = choices.shape
        for batch in batches:
            n = batch.num_rows
            packed = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(n, BITS // 8)
            counts = embedded(packed)[:, choices.ravel()].reshape(n, count, size)
            cell = (np.arange(count) << 40) + counts.astype(np.int64) @ 3 ** np.arange(size, dtype=np.int64)
            columns = [cell.ravel(), *(np.repeat(x, count) for x in (batch.column("id").to_numpy(), batch.column("root").to_numpy(), *packed.view(np.int64).T))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "id", "root", *WORDS])

    return run


def _apart(other: str) -> str:
    return " + ".join(f"bit_count({w} ^ {other}{w})" for w in WORDS)


def _nearest(asked: DataFrame, drawn_from: DataFrame, number: int) -> DataFrame:
    """(a, b): each text of asked (rows of CELLS) with the nearest of the representatives of its cells that has another root.
    A cell's are drawn by hash among the rows of drawn_from, anew each round, so that a large group has many."""
    lot, draw = F.expr(f"pmod(xxhash64(id, {number}), {DRAWN[number > 0]})"), F.xxhash64("cell", "id", F.lit(number)).alias("draw")
    drawn = drawn_from.groupBy("cell", lot.alias("lot")).agg(F.min(F.struct(draw, "id", "root", *WORDS)).alias("r")).select("cell", "r")
    near = asked.join(drawn, "cell").filter(f"root <> r.root AND {_apart('r.')} <= {WITHIN}")
    best = near.groupBy("id").agg(F.min(F.struct(F.expr(_apart("r.")), F.col("r.id").alias("id"))).alias("o"))
    return best.selectExpr("least(id, o.id) AS a", "greatest(id, o.id) AS b").distinct()


def _joined(lo: int, hi: int, t: np.ndarray, ids: np.ndarray, roots: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """(a, b): near copies of texts of tile lo and tile hi (t: each one's tile; words: their fingerprints, a row for each word) that join groups
    which roots, and the pairs before, leave apart.

    All pairs are looked at but those within a group of BIG or more: the first half of the words shows of nearly all others that they differ in
    too many bits.
    """
    order = np.lexsort((ids, roots))
    left, right = order[t[order] == lo], order[t[order] == hi]
    distinct, group = np.unique(roots, return_inverse=True)
    x, y = words[:, left], words[:, right]
    own, other = group[left], group[right]
    label, out, half = np.arange(len(distinct)), [], len(words) // 2
    buf, ones, acc = (np.empty((ROWS, COLUMNS), kind) for kind in (np.uint64, np.uint8, np.uint8))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        some = label[own[i]] != label[other[j]]
        i, j = i[some], j[some]
        some = np.bitwise_count(x[:, i] ^ y[:, j]).sum(axis=0, dtype=np.int64) <= WITHIN
        i, j = i[some], j[some]
        if not len(i):
            return
        p, q = label[own[i]], label[other[j]]
        _, once = np.unique(np.minimum(p, q) * len(label) + np.maximum(p, q), return_index=True)
        to = np.arange(len(label))
        for k, m, n in zip(once.tolist(), p[once].tolist(), q[once].tolist()):
            while to[m] != m:
                to[m] = m = to[to[m]]
            while to[n] != n:
                to[n] = n = to[to[n]]
            if m != n:
                to[max(m, n)] = min(m, n)
                out.append((int(ids[left[i[k]]]), int(ids[right[j[k]]])))
        while (to != to[to]).any():
            to = to[to]
        label = to[label]

    for begin in range(0, len(left), ROWS):
        end = min(begin + ROWS, len(left))
        spans = [(begin if lo == hi else 0, len(right))]
        if own[begin] == own[end - 1]:  # rows are sorted by their groups
            first, last = np.searchsorted(other, own[begin], "left"), np.searchsorted(other, own[begin], "right")
            if last - first >= BIG:
                spans = [(spans[0][0], first), (max(last, spans[0][0]), len(right))]
        for start, stop in spans:
            for at in range(start, stop, COLUMNS):
                upto = min(at + COLUMNS, stop)
                b, o, s = (z[: end - begin, : upto - at] for z in (buf, ones, acc))
                s[...] = 0
                for k in range(half):
                    np.bitwise_xor(x[k, begin:end, None], y[k, at:upto], out=b)
                    np.add(s, np.bitwise_count(b, out=o), out=s)  # 256 of 256 becomes 0, which join() looks into
                i, j = np.divmod(np.flatnonzero(s <= WITHIN), upto - at)
                if len(i):
                    join(i + begin, j + at)
    return out


def _meeting(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    words = np.stack([table.column(w).to_numpy().view(np.uint64) for w in WORDS])
    found = _joined(key[0].as_py(), key[1].as_py(), *(table.column(c).to_numpy() for c in ("t", "id", "root")), words)
    return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})


def _apart_links(rows: DataFrame, n: int) -> DataFrame:
    """(a, b): near copies among texts (rows of CELLS, one for each; n or fewer), enough of them to link, with the links that root stands
    for, all that are. Tiles of texts meet in tasks of their own, each two once."""
    tiles = max(math.ceil(n / TILE), min(TILES, math.ceil(n / 1024)), 1)
    dealt = rows.drop("cell").withColumn("t", F.expr(f"cast(pmod(xxhash64(id, {SEED}), {tiles}) AS int)"))
    met = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"lo": F.least("t", "u"), "hi": F.greatest("t", "u")}).drop("u")
    return met.groupBy("lo", "hi").applyInArrow(_meeting, "a long, b long")


def near_copies(texts: DataFrame, n: int) -> DataFrame:
    """(a, b): near copies among texts (id, text; n rows), enough of them to link all that are, directly or over others."""
    prints = spool(texts.mapInArrow(_long_fingerprints, "id long, bits binary").dropDuplicates(["id"]))
    choices = grids(n)
    columns = ("id", "root", "bits")
    entries = prints.selectExpr("id", "id AS root", "bits").mapInArrow(_cells(choices[:FIRST]), CELLS)
    links = cut(_nearest(entries, entries, 0))
    for number in range(1, ROUNDS):
        # From here on representatives are texts with a link.
        roots = cut(components(links))
        release(texts.sparkSession)  # of many small shuffles
        placed = prints.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "bits", F.col("root").isNotNull().alias("linked"))
        drawn_from = placed.filter("linked").select(*columns).mapInArrow(_cells(choices[:FIRST]), CELLS)
        found = cut(_nearest(placed.select(*columns).mapInArrow(_cells(choices[:FIRST]), CELLS), drawn_from, number))
        release(texts.sparkSession)
        links = cut(links.unionByName(found))

    # What no cell has brought together may still be alike: all texts meet, each two once.
    roots = cut(components(links))
    release(texts.sparkSession)
    placed = prints.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "bits")
    rest = cut(_apart_links(placed.mapInArrow(_cells(choices[:1, :0]), CELLS), n))
    release(texts.sparkSession)
    return links.unionByName(rest)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of texts linked as near copies (see the module), the row with the smallest doc_id (of equals, the least text hash; nulls last), with docs' own columns.

    A null text counts as empty; texts without a word are near copies of each other and of no others. Texts of fewer than
    five words are near copies if their words, A-Z lower-cased, are the same.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.xxhash64(whole_text()).alias("id"), whole_text().alias("text"))
    roots = components(near_copies(texts, docs.count())).withColumnRenamed("node", "id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("id"))
    place = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    linked = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = linked.groupBy("root").agg(F.min(F.struct(place.alias("place"), "doc_id", "id")).alias("first"))
    return only(docs, first.select("first.doc_id", "first.id"), F.col("doc_id").cast("long"), F.xxhash64(whole_text()))
