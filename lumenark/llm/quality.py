"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

A text is a bag of hashed features: words and marks, their pairs, and pairs of word shapes (case, digits, the
mark itself, whether a token repeats the one before). Two generative models over the buckets are
counted: target (documents labelled good, a bounded sample of them) and raw (every document). A document's
log weight is the sum of its features' log ratios, scaled down to EVIDENCE features where it has more: features of
one text are far from independent, and a plain sum grows with the length and leaves nothing to the draw. Adding Gumbel
noise seeded by doc_id and taking the k largest draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import cut, fresh, prepare, whole_text

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 14, 1 << 12
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Labelled documents the target model is counted over, at most, by the hash of their ids.
TARGET_ROWS = 20_000
SEED = 23
#: The target model leans on the raw one as if it had seen so many more features of each bucket, dealt as in raw text.
PSEUDO_COUNT = 16

#: As many features a text's log weight may stand for.
EVIDENCE = 64

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens looked at at once, so that a very long text takes little more memory than others; the last one is carried over.
STRIDE = 1 << 17


def _shape(token: str) -> int:
    if token.islower():
        return 1
    if token.isupper():
        return 2 if len(token) > 1 else 3
    if token.isalpha():
        return 3 if token.istitle() else 4
    if token.isdigit():
        return 5
    return 6 if token[0].isalnum() else 7 + zlib.crc32(token.encode()) % 57


def features(text: str) -> np.ndarray:
    """The buckets of a text's features, repeats included."""
    found, tokens = [], TOKEN.finditer(text)
    before: tuple[int, int] | None = None  # the last token's word and shape
    while some := [m[0] for m in islice(tokens, STRIDE)]:
        own = np.fromiter((zlib.crc32(t.encode()) for t in map(str.lower, some)), np.uint64, len(some))
        shapes = np.fromiter(map(_shape, some), np.int64, len(some))
        found.append(own % WORD_BUCKETS)
        if before:
            own, shapes = np.concatenate([np.array([before[0]], np.uint64), own]), np.concatenate([[before[1]], shapes])
        pairs = (own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]) >> np.uint64(11)
        same = (own[:-1] == own[1:]).astype(np.int64)
        found += [pairs % WORD_BUCKETS, WORD_BUCKETS + (shapes[:-1] * 67 + shapes[1:] * 2 + same) % SHAPE_BUCKETS]
        before = int(own[-1]), int(shapes[-1])
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _count(target: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = np.bincount(features(text), minlength=BUCKETS)
                counts[0] += own
                if doc_id in target:
                    counts[1] += own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"])

    return run


def log_ratios(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """By bucket, log of its share in good documents over its share in all; all 0 where no good document is known.

    Raw counts cover all of docs. labels (doc_id, quality, toxic): good are rows with quality 1 and not toxic 1.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL AND NOT coalesce(toxic, 0) = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = good.count()
    if known > target_rows:  # about so many, so that finding the lowest needs no more
        spread = F.expr(f"pmod(xxhash64(doc_id, {SEED}), 1000000L)")
        good = good.filter(spread < int(1_000_000 * min(1.0, 1.1 * target_rows / known + 1e-5)))
    ids = frozenset(r[0] for r in good.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(target_rows).collect())
    counted = docs.select("doc_id", "text").mapInArrow(_count(ids), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted.collect():  # one row a bucket
        raw[row[0]], target[row[0]] = row[1], row[2]
    if not target.sum():
        return np.zeros(BUCKETS)
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        expected = raw[part] * (target[part].sum() / max(1.0, raw[part].sum()))
        out[part] = np.log((target[part] + PSEUDO_COUNT) / (expected + PSEUDO_COUNT))
    return out


def _score(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes = [], []
            for text in batch.column("text").to_pylist():
                found = features(text)
                sizes.append(len(found))
                sums.append(float(ratios[found].sum()) * min(1.0, EVIDENCE / max(1, len(found))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], ["doc_id", "log_weight", "n_features"])

    return run


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column without nulls, exactly; None if there are fewer.

    The range that holds the place is cut into 1,024 steps and counted, and the step that holds it becomes the next
    range, from its least to its largest value: a few aggregations of at most 1,024 rows.
    """
    least, most, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not 1 <= k <= n:
        return None
    low, high, need = least, most, k
    while low < high:
        width = (high - low) / 1024
        if width == 0:
            return low
        step = F.least(F.lit(1023), F.floor((F.col(column) - F.lit(low)) / F.lit(width))).cast("int")
        inside = df.filter(F.col(column).between(low, high)).withColumn("_step", step)
        rows = sorted(inside.groupBy("_step").agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["_step"])
        for row in rows:
            if row["n"] >= need:
                low, high = row["lo"], row["hi"]
                break
            need -= row["n"]
    return high


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, any more): doc_id, log_weight, n_features, sample_key, kept.

    kept marks the k rows with the largest sample_key (rows that tie with the last stay too). Without k it is the
    number of documents that target explains at least as well as raw, allowing for the share of good labels:
    those with log_weight >= log(1/2 / share). A null or empty text has no features and weight 0; null
    doc_ids share one draw of noise. Without good labels all weights are 0 and all rows stay. Texts of any length are read
    whole. Models are counted, and texts scored, by jobs that run when this is called.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ratios = log_ratios(texts, labels, target_rows)
    scored = texts.mapInArrow(_score(ratios), "doc_id long, log_weight double, n_features long")
    uniform = (F.expr(f"shiftrightunsigned(xxhash64(coalesce(doc_id, -1L), {seed}), 11)").cast("double") + 0.5) / float(1 << 53)
    scored = cut(scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))))
    if k is None:
        share = labels.agg(F.avg(F.when(F.col("quality") == 1, 1.0).when(F.col("quality").isNotNull(), 0.0))).first()[0]
        k = scored.filter(F.col("log_weight") >= float(np.log(0.5 / share) if share else 0.0)).count()
    least = kth_largest(scored, "sample_key", k)
    stays = F.lit(k > 0) if least is None else F.col("sample_key") >= F.lit(least)
    return scored.withColumn("kept", stays)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns. Rows that repeat a doc_id stay together, by their best one."""
    stay, name = resample(docs, labels).filter("kept").select("doc_id").distinct(), fresh(docs, "stay")
    return docs.join(stay.toDF(name), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
