"""Exact dedup by content-defined chunk recipes.

A rolling hash over the last 32 bytes cuts a text where its top bits are zero, so equal passages are
cut alike wherever they stand. Chunks are deduplicated (partial aggregation first, so a chunk that
half of the corpus repeats moves once per task) and their digests verified against the bytes: if
one digest stood for two chunks, the pass is made again with the next, longer digest. A document
is then the ordered list of its verified identifiers, some 16 bytes per KB, and only these lists
are grouped and joined; long documents do not move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import cut, only, prepare, whole_text

AVERAGE_BITS = 10  # chunks of 1 KB on average beyond the least size
LEAST, MOST = 256, 8192
WINDOW = 32

#: Digests to try in turn; the first whose chunks are all verified names them.
DIGESTS: tuple[Callable[[bytes], bytes], ...] = (
    lambda b: xxhash.xxh3_128_digest(b),
    lambda b: hashlib.sha256(b).digest(),
    lambda b: hashlib.sha512(b).digest(),
)


def _gear() -> np.ndarray:
    """One pseudo-random 32-bit weight per byte value; 0 for the separator byte."""
    weights = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint32)
    weights[0] = 0
    return weights


GEAR = _gear()


def cuts(texts: list[bytes]) -> list[list[int]]:
    """Ends of each text's chunks (none for an empty text). A cut depends on the text alone."""
    gap = bytes(WINDOW)
    rolled = GEAR[np.frombuffer(gap.join(texts) + gap, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint32(step))
    found = np.flatnonzero((rolled >> np.uint32(32 - AVERAGE_BITS)) == 0)
    out, begin = [], 0
    for text in texts:
        size = len(text)
        lo, hi = np.searchsorted(found, (begin, begin + size))
        ends, last = [], 0
        for end in (found[lo:hi] - begin + 1).tolist():
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                ends.append(end)
                last = end
        while size - last > MOST:
            last += MOST
            ends.append(last)
        if size > last:
            ends.append(size)
        out.append(ends)
        begin += size + WINDOW
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Row, text and chunks, a few MB of text at a time."""
    column = batch.column("text")
    texts = column.cast(pa.binary()).to_pylist()
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < 4 << 20):
            size += len(texts[stop])
            stop += 1
        for row, ends in zip(range(at, stop), cuts(texts[at:stop])):
            text = texts[row]
            yield row, text, [text[a:b] for a, b in zip([0, *ends], ends)]
        at = stop


def _recipes(digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes, shas = [], []
            for _, text, chunks in _pieces(batch):
                recipes.append(b"".join(map(digest, chunks)))
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return run


def _chunks(digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {chunk for _, _, chunks in _pieces(batch) for chunk in chunks}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(map(digest, found), pa.binary()), pa.array(found, pa.binary())], ["id", "bytes"])

    return run


def recipes(docs: DataFrame, digests: tuple[Callable[[bytes], bytes], ...] = DIGESTS) -> DataFrame:
    """(doc_id, text_sha256, recipe): each text as the list of its chunks' verified identifiers.

    Verified: no identifier stands for two different chunks of this input. Raises ValueError if
    no digest given can be verified.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    for digest in digests:
        distinct = texts.select("text").mapInArrow(_chunks(digest), "id binary, bytes binary").distinct()
        if distinct.groupBy("id").count().filter("count > 1").isEmpty():
            return texts.mapInArrow(_recipes(digest), "doc_id long, text_sha256 string, recipe binary")
    raise ValueError("each digest stands for two chunks somewhere")


def exact_dedup(docs: DataFrame, digests: tuple[Callable[[bytes], bytes], ...] = DIGESTS) -> DataFrame:
    """One row per row of docs (doc_id, text, any more): doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with identical texts the one with the largest doc_id stays. A null text counts as
    empty. A null doc_id counts below all others: it stays only if its whole group has none. Rows
    that repeat doc_id and text are one document seen twice; both carry the same answer.
    """
    lists = cut(recipes(docs, digests))
    # Cut too, so that both sides of the join are plain shuffles, whose hot recipes Spark deals to several tasks.
    groups = cut(lists.groupBy("recipe").agg(F.max("doc_id").alias("largest"), F.count("*").alias("n")).filter("n > 1"))
    found = lists.join(groups, "recipe", "left").withColumn("keep_id", F.coalesce("largest", "doc_id"))
    return found.select("doc_id", "keep_id", F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns; of rows that repeat doc_id and text, one."""
    stay = exact_dedup(docs).filter("kept").select("doc_id", "text_sha256")
    return only(docs, stay, F.col("doc_id").cast("long"), F.sha2(whole_text(), 256))
