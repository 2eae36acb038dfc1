"""Substring dedup on a compacted De Bruijn graph of tokens.

An edge is a window of 13 words, and leads from its first 12 words to its last 12. Consecutive edges of a
document whose least 5-word hash (the anchor) is the same one form a path of up to nine edges. All
edges with an anchor lie in that anchor's paths, so if every path of an anchor that any document
holds is the same word sequence, nothing branches in it and it is compacted into one record whose source is
the smallest doc_id: one aggregation and one join by anchor settle all its edges. Anchors whose
paths differ (ends of repeated passages, anchors that meet by chance) branch; only their edges are
written out one by one, aggregated and joined likewise. What comes back to a document is the coordinates of
its edges with an earlier source, from which its removed words follow.

Anchors that one document alone holds go no further than the first aggregation. Anchors with over a HOT-th of all
occurrences (at most HOT of them) are sent to all tasks; the join by anchor is left with keys of a smaller share.

Up to here identity is by hashes: anchor and path, or two of an edge. Then runs of edges with one source are joined into spans,
and every different span is compared, word by word, with its source at the coordinates where its first edge
occurs there. Equal words have equal hashes, so nothing is missed; if a span is not what its hashes say, all is
done again with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import prepare, release, spool, whole_text

WINDOW, ANCHOR = 13, 5
#: Words of some texts that are handled at a time, about.
TOGETHER = 1 << 15
HOT = 1 << 16
#: Seeds of the hashes that are tried before giving up.
SEEDS = 8

_MASK = (1 << 64) - 1
#: Odd multipliers of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LAST = (1 << 63) - 1  # the place of a null doc_id


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.steps = (base, pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up, self.down = (np.concatenate([p, p * np.uint64(pow(step, m, 1 << 64))]) for p, step in zip((self.up, self.down), self.steps))
        return self.up[:n], self.down[:n]


digest = xxhash.xxh64_intdigest
_powers = tuple(map(_Powers, BASES))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Ranges:
    """Hashes of ranges of a word sequence: sum of word hash times base to the power of minus its place in the range."""

    def __init__(self, words: list[bytes], seed: int = 0):
        self.n = len(words)
        self.words = np.fromiter(map(digest, words, repeat(seed)), np.uint64, self.n)

    def sums(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = _powers[which].to(self.n)
        own = self.words if not which else _mixed(self.words + np.uint64(which))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * down, dtype=np.uint64)]), up

    def fixed(self, size: int, which: int = 0) -> np.ndarray:
        """Of every range of `size` words."""
        total, up = self.sums(which)
        return _mixed((total[size:] - total[:-size]) * up[: self.n - size + 1])


def paths(ranges: Ranges, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First edge, end of edges, anchor's hash and path's hash of each path, in order, and which text's it is; ranges holds the words of texts of
    these sizes, one after another, and edges are numbered by their first words."""
    ends = np.cumsum(sizes)
    edges = np.maximum(sizes - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(sizes)), edges)
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), text
    own = np.arange(len(text)) + np.repeat(ends - sizes - np.cumsum(edges) + edges, edges)
    grams = ranges.fixed(ANCHOR)
    wide = WINDOW - ANCHOR + 1
    n = len(grams) - wide + 1
    # The least from each gram on: of two, four, eight, and then of all nine.
    least, span = grams, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[wide - span :][:n])
    # Where it stands first.
    at = np.full(n, wide, np.int64)
    for k in range(wide - 1, -1, -1):
        at[grams[k : k + n] == least] = k
    at = (at + np.arange(n))[own]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(own)) - 1
    start, end, anchor = own[first], own[last] + 1, at[first]
    total, up = ranges.sums(0)
    whole = (total[end + WINDOW - 1] - total[start]) * up[start]
    shape = ((end - start) * 64 + anchor - start).astype(np.uint64)
    return start, end, grams[anchor], _mixed(whole + shape * np.uint64(BASES[1])), text[first]


def _together(rows: Iterable[tuple]) -> Iterator[tuple[list[tuple], list[bytes], np.ndarray]]:
    """Rows that end with a text, some at a time: the rest of each, and the words of all with each text's number of them."""
    kept, words, sizes = [], [], []
    for *row, text in rows:
        own = text.split()
        if len(own) >= WINDOW:
            kept.append(row)
            sizes.append(len(own))
            words += own
            if len(words) >= TOGETHER:
                yield kept, words, np.array(sizes)
                kept, words, sizes = [], [], []
    if kept:
        yield kept, words, np.array(sizes)


def _columns(batch: pa.RecordBatch, *names: str) -> zip:
    return zip(*(batch.column(n).cast(pa.binary()).to_pylist() if n == "text" else batch.column(n).to_pylist() for n in names))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """first, size and source of the runs of each row, none if they are null."""
    runs = batch.column("runs")
    flat, ends = runs.flatten(), np.cumsum(runs.value_lengths().fill_null(0).to_numpy())
    first, size, source = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "size", "source"))
    for a, b in zip([0, *ends.tolist()], ends.tolist()):
        yield first[a:b], size[a:b], source[a:b]


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))


def _anchors(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words, sizes in _together(_columns(batch, "place", "spot", "text")):
                _, _, anchor, path, text = paths(Ranges(words, seed), sizes)
                place, spot = (np.array(c, np.int64)[text] for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([_signed([anchor]), _signed([path]), pa.array(place), pa.array(spot)], ["anchor", "path", "place", "spot"])

    return run


SPAN = "place long, spot long, first int, size int, source long, e1 long, e2 long"


def _spans(seed: int):
    """Runs of edges with an earlier source (e1 null), and the edges of branching paths one by one (size 1, source null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words, sizes in _together(_columns(batch, "place", "spot", "anchors", "sources", "text")):
                ranges = Ranges(words, seed)
                first, end, anchor, _, text = paths(ranges, sizes)
                begin = np.cumsum(sizes) - sizes
                place, spot = (np.array(c, np.int64)[text] for c in list(zip(*rows))[:2])
                cut, hashes, known = np.searchsorted(text, np.arange(len(rows) + 1)).tolist(), anchor.view(np.int64).tolist(), []
                for k, (own, _, anchors, sources) in enumerate(rows):
                    source = dict(zip(anchors, sources))  # null: it branches
                    known += [source.get(a, own) for a in hashes[cut[k] : cut[k + 1]]]
                branching = np.array([x is None for x in known], bool)
                source = np.array([0 if x is None else x for x in known], np.int64)
                settled = ~branching & (source < place)
                size = end - first
                # The edges of branching paths, one by one.
                each, count = np.flatnonzero(branching), size[branching]
                edge = np.repeat(first[each] - np.cumsum(count) + count, count) + np.arange(count.sum())
                each = np.repeat(each, count)
                of = np.concatenate([np.flatnonzero(settled), each])
                none = np.arange(len(of)) < len(of) - len(each)
                e1, e2 = (np.concatenate([np.zeros(none.sum(), np.int64), ranges.fixed(WINDOW, which)[edge].view(np.int64)]) for which in (0, 1))
                start = np.concatenate([first[settled], edge]) - begin[text[of]]
                columns = [place[of], spot[of], start.astype(np.int32), np.where(none, size[of], 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(source[of], mask=~none), pa.array(e1, mask=none), pa.array(e2, mask=none)], ["place", "spot", "first", "size", "source", "e1", "e2"])

    return run


def _quoted(seed: int):
    """(source, edge, words): the runs of a text with one source, joined where they touch; edge is the hash of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, bytes]] = []
            for (text,), (first, size, source) in zip(_columns(batch, "text"), _runs(batch)):
                words, order = text.split(), np.lexsort((first, source))  # no two runs of a text have an edge in common
                first, end, source = first[order], (first + size)[order], source[order]
                new = np.flatnonzero(np.concatenate([[True], (source[1:] != source[:-1]) | (first[1:] > end[:-1])]))
                for source, first, end in zip(source[new].tolist(), first[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist()):
                    edge = Ranges(words[first : first + WINDOW], seed).fixed(WINDOW).view(np.int64)
                    found.append((source, int(edge[0]), b" ".join(words[first : end + WINDOW - 1])))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["source", "edge", "words"])

    return run


def _compared(seed: int):
    """(span, same): whether a span's words stand in the text where its first edge does, or each 13 of them in turn somewhere in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words, windows, order, ordered = None, [], None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            same = []
            for text, edge, span in _columns(batch, "text", "edge", "words"):
                if text != last:
                    last, words, windows = text, text.split(), None
                    edges = Ranges(words, seed).fixed(WINDOW).view(np.int64) if len(words) >= WINDOW else np.zeros(0, np.int64)
                    order = np.argsort(edges, kind="stable")
                    ordered = edges[order]
                low, high = np.searchsorted(ordered, [edge, edge + 1] if edge < LAST else [edge, edge])
                spanned = span.split(b" ")
                found = any(words[at : at + len(spanned)] == spanned for at in order[low:high].tolist())
                if not found:  # edges that follow each other here may stand apart in the source
                    if windows is None:
                        windows = set(zip(*(words[k:] for k in range(WINDOW))))
                    found = windows.issuperset(zip(*(spanned[k:] for k in range(WINDOW))))
                same.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("span"), pa.array(same, pa.bool_())], ["span", "same"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, shas = [], [], []
        for (text,), (first, size, _) in zip(_columns(batch, "text"), _runs(batch)):
            words = text.split()
            sizes.append(len(words))
            if len(first):
                change = np.bincount(first, minlength=len(words) + 1) - np.bincount(first + size + WINDOW - 1, minlength=len(words) + 1)
                covered = np.cumsum(change[:-1]) > 0
                gone.append(int(covered.sum()))
                words = [w for w, c in zip(words, covered.tolist()) if not c]
            else:
                gone.append(0)
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, place (doc_id; null comes last), spot (tells texts apart that share a place)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.withColumns({"place": F.coalesce("doc_id", F.lit(LAST)), "spot": F.xxhash64("text")})


def repeated_runs(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(place, spot, runs): for each text with words to remove, runs (first, size, source) of edges, by number of their first
    word, that also start in an earlier document, source. See _texts for place and spot."""
    spark = docs.sparkSession
    prepare(spark)
    texts = _texts(docs)
    held = texts.select("place", "spot", "text").mapInArrow(_anchors(seed), "anchor long, path long, place long, spot long")
    shared = held.groupBy("anchor").agg(F.min("place").alias("source"), F.max("place").alias("most"), F.min("path").alias("p"), F.max("path").alias("q"), F.count("*").alias("n")).filter("source < most")
    shared = spool(shared.selectExpr("anchor", "IF(p = q, source, NULL) AS source", "n"))
    release(spark)
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(shared.filter(F.col("n") > total // HOT).selectExpr("anchor AS hot", "source AS hot_source"))  # fewer than HOT rows
    # What branches, or has an earlier source, is of use to a document; the source of a compacted path is done.
    marked = held.select("anchor", "place", "spot").join(hot, F.col("anchor") == F.col("hot"), "left")
    useful = "(source IS NULL OR source < place)"
    # Hot rows are dealt by a number of their own; they match nothing.
    marked = marked.withColumn("key", F.expr("IF(hot IS NULL, anchor, xxhash64(place, spot, anchor))"))
    cold = shared.filter(F.col("n") <= total // HOT).selectExpr("anchor AS key", "source", "true AS met")
    found = marked.filter("hot IS NULL OR hot_source IS NULL OR hot_source < place").join(cold, "key", "left").filter(f"hot IS NOT NULL OR met AND {useful}")
    found = spool(found.selectExpr("place", "spot", "anchor", "IF(hot IS NULL, source, hot_source) AS source"))
    release(spark)
    by_doc = found.distinct().groupBy("place", "spot").agg(F.collect_list(F.struct("anchor", "source")).alias("found")).selectExpr("place", "spot", "found.anchor AS anchors", "found.source AS sources")
    spans = spool(texts.join(by_doc, ["place", "spot"]).select("place", "spot", "text", "anchors", "sources").mapInArrow(_spans(seed), SPAN))
    release(spark)
    edges = spans.filter("e1 IS NOT NULL").drop("source")
    sources = spool(edges.groupBy("e1", "e2").agg(F.min("place").alias("source"), F.max("place").alias("most")).filter("source < most").drop("most"))
    later = edges.join(sources, ["e1", "e2"]).filter("source < place")
    columns = ("place", "spot", "first", "size", "source")
    runs = spans.filter("e1 IS NULL").select(*columns).unionByName(later.select(*columns))
    # Rows of one text differ in `first`, so that a list is no longer than its text.
    runs = spool(runs.distinct().groupBy("place", "spot").agg(F.collect_list(F.struct("first", "size", "source")).alias("runs")))
    release(spark)
    return runs


def unverified(docs: DataFrame, runs: DataFrame, seed: int = 0) -> int:
    """How many different spans of runs are not, word by word, what stands in their source."""
    texts = _texts(docs)
    spans = texts.join(runs, ["place", "spot"]).select("text", "runs").mapInArrow(_quoted(seed), "source long, edge long, words binary")
    spans = spool(spans.distinct().withColumn("span", F.xxhash64("source", "words")))  # a passage of many documents is one row
    release(docs.sparkSession)
    asked = spans.withColumnRenamed("source", "place").hint("merge").join(texts.select("place", "text"), "place")
    checked = asked.select("span", "edge", "words", "text").mapInArrow(_compared(seed), "span long, same boolean")
    wrong = checked.groupBy("span").agg(F.max("same").alias("same")).filter("NOT same").count()
    release(docs.sparkSession)
    return wrong


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, any more): doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller
    doc_id. A null text counts as empty and texts of fewer than 13 words lose nothing. Rows that share a doc_id
    do not count as each other's copies; a null doc_id stands after all others. Texts of any length are read whole. Spans
    are found and verified by jobs that run when this is called.
    """
    for seed in range(SEEDS):
        runs = repeated_runs(docs, seed)
        if not (wrong := unverified(docs, runs, seed)):
            break
    else:
        raise RuntimeError(f"{wrong} spans differ from their sources under each of {SEEDS} seeds")
    return _texts(docs).join(runs, ["place", "spot"], "left").select("doc_id", "text", "runs").mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
