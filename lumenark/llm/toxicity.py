"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the n-grams of 2 to 7 characters of the lower-cased text that hold no space but at their ends, hashed into
buckets. Over labelled texts each bucket is counted by label; the log of its smoothed share in toxic over its share in clean
text is its ratio, and the FEATURES buckets whose counts tell most about the label (likelihood ratio G) are kept. A
text's value for a bucket is ratio * count / sqrt(number of n-grams), beside 1 / sqrt(..) and sqrt(..) themselves: evidence for
and against a label adds up with a text's length, and its noise with the root of it. Logistic regression with a ridge is
fitted by Newton steps on a bounded sample of labelled texts, and all texts are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import cut, prepare, whole_text

SHORTEST, LONGEST = 2, 7
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
FEATURES = 4096
#: Labelled documents of each label that the classifier is fitted on, at most, by the hash of their ids.
TRAIN_ROWS = 8192
#: Tasks that count the sample's n-grams.
TRAIN_TASKS = 12
SMOOTHING, RIDGE, SEED = 1.0, 0.1, 31
#: Code points hashed at once, over as many texts as it takes.
STRIDE = 1 << 18
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that labels are not learnt from: crc32 of the id as text is a multiple of 5, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _letters(text: str) -> np.ndarray:
    """Code points between two spaces; ASCII other than letters and digits is space, and a run of them is one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (points < 128) & ~((points >= 97) & (points <= 122) | (points >= 48) & (points <= 57))
    stays = ~space
    stays[1:] |= ~space[:-1]
    return np.concatenate([[32], np.where(space, 32, points)[stays], [32]]).astype(np.uint64)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's place in the list, bucket) of each n-gram, some STRIDE code points at a time."""
    waiting, owners, size = [], [], 0
    for place, text in enumerate(texts):
        letters = _letters(text)
        for begin in range(0, len(letters), STRIDE):  # a long text goes in pieces; an n-gram belongs to the piece that it starts in
            piece = letters[begin : begin + STRIDE + LONGEST - 1]
            waiting.append(piece)
            owners.append((place, len(piece), min(STRIDE, len(piece))))
            size += len(piece)
            if size >= STRIDE:
                yield _hashed(waiting, owners)
                waiting, owners, size = [], [], 0
    if waiting:
        yield _hashed(waiting, owners)


def _hashed(pieces: list[np.ndarray], owners: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    points = np.concatenate(pieces)
    place = np.repeat([o[0] for o in owners], [o[1] for o in owners])
    ends = np.cumsum([o[1] for o in owners])
    stop = np.repeat(ends, [o[1] for o in owners])  # of the piece that a point is in
    starts = np.arange(len(points)) < np.repeat(ends - [o[1] - o[2] for o in owners], [o[1] for o in owners])
    space = points == 32
    before = np.concatenate([[0], np.cumsum(space)])
    found, hashed = [], points
    for n in range(2, LONGEST + 1):
        count = len(points) - n + 1
        if count < 1:
            break
        hashed = hashed[:count] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n < SHORTEST:
            continue
        # Not beyond the piece; no space inside; more than spaces.
        sound = starts[:count] & (np.arange(n, len(points) + 1) <= stop[:count]) & (before[n - 1 : len(points)] == before[1 : count + 1])
        if n == 2:
            sound &= ~(space[:count] & space[1:])
        own = hashed[sound]
        own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((place[:count][sound], (own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([b for _, b in found])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's n-grams in clean and toxic texts, by task."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for place, bucket in grams(batch.column("text").to_pylist()):
            counts += np.bincount(toxic[place] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS)
    seen = np.flatnonzero(counts.any(axis=0))
    for begin in range(0, len(seen), 1 << 16):
        some = seen[begin : begin + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "clean", "toxic"])


def _bags(batch: pa.RecordBatch, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of a batch's features, rows ascending, and the number of n-grams by row. column: a bucket's feature, or -1."""
    sizes = np.zeros(batch.num_rows, np.int64)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for place, bucket in grams(batch.column("text").to_pylist()):
        sizes += np.bincount(place, minlength=len(sizes))
        feature = column[bucket]
        known = feature >= 0
        own, n = np.unique(place[known] * FEATURES + feature[known], return_counts=True)
        keys.append(own)
        counts.append(n)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(inverse, np.concatenate(counts), len(key))
    return key // FEATURES, key % FEATURES, count, sizes


def _values(row: np.ndarray, feature: np.ndarray, count: np.ndarray, sizes: np.ndarray, ratios: np.ndarray):
    """Entries (row, column, value) of the matrix of scaled features; the last two columns stand for the text's length."""
    root = np.sqrt(np.maximum(1, sizes))
    every, width = np.arange(len(sizes)), len(ratios)
    return (
        np.concatenate([row, every, every]), np.concatenate([feature, np.full(len(sizes), width), np.full(len(sizes), width + 1)]),
        np.concatenate([ratios[feature] * count / root[row], 10 / root, root / 100]),
    )


def _sparse(column: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, count, sizes = _bags(batch, column)
            ends = np.searchsorted(row, np.arange(1, batch.num_rows + 1))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (feature, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(sizes), *lists], ["doc_id", "toxic", "size", "features", "counts"])

    return run


def fit_logistic(entries: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, importance: np.ndarray, width: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the least importance-weighted logistic loss plus ridge/2 * |w|^2, by Newton steps solved with conjugate gradients."""
    rows, columns, values = entries
    n = len(labels)
    times = lambda w: np.bincount(rows, values * w[columns], n)
    back = lambda u: np.bincount(columns, values * u[rows], width)
    sign = 2 * labels - 1
    loss = lambda w: float((importance * np.logaddexp(0, -sign * times(w))).sum() + ridge / 2 * w @ w)
    w = np.zeros(width)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(times(w), -500, 500)))
        slope = back(importance * (p - labels)) + ridge * w
        if np.linalg.norm(slope) < 1e-4 * max(1.0, np.linalg.norm(w)):
            break
        curve = importance * p * (1 - p)
        step, left = np.zeros(width), -slope
        towards, size = left.copy(), left @ left
        for _ in range(80):
            bent = back(curve * times(towards)) + ridge * towards
            reach = size / (towards @ bent)
            step, left = step + reach * towards, left - reach * bent
            size, last = left @ left, size
            if size < 1e-6 * (slope @ slope):
                break
            towards = left + size / last * towards
        scale, now = 1.0, loss(w)
        while scale > 1e-4 and loss(w + scale * step) > now + 1e-4 * scale * (slope @ step):
            scale /= 2
        w = w + scale * step
    return w


def training_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """((doc_id, toxic, text) to fit on, how many labelled ids each row of a label stands for).

    Ids of labels outside the held-out fold; an id is toxic if any of its label rows says so; of rows that share an id the text
    that sorts first counts.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order, ids, stands = F.xxhash64("doc_id", F.lit(SEED)), [], {}
    found = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    for label, n in sorted(found.items()):
        share = min(1.0, (train_rows + 8 * train_rows**0.5 + 32) / n)  # as many and some, so that finding the lowest looks at no more
        some = known.filter(F.col("toxic") == label).filter((F.lit(share) >= 1.0) | (F.pmod(order, F.lit(1_000_000)) < int(1_000_000 * share)))
        taken = [r[0] for r in some.orderBy(order, "doc_id").limit(train_rows).select("doc_id").collect()]
        ids += [(i, label) for i in taken]
        stands[label] = n / max(1, len(taken))
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))  # at most 2 * train_rows rows
    return docs.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), stands


def _model(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(a bucket's feature or -1, ratios of the features, weights); None without both labels."""
    sample, stands = training_sample(docs, labels, train_rows)
    if len(stands) < 2:
        return None
    sample = cut(sample.repartition(TRAIN_TASKS, "doc_id"))
    counted = sample.select("text", "toxic").mapInArrow(_count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = cut(counted)  # a row per bucket at most
    clean, toxic = counted.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    every = float(clean + toxic)
    told = lambda c, total: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * every / ((F.col("clean") + F.col("toxic")) * float(total)))).otherwise(0.0)
    best = counted.withColumn("g", told("clean", max(1, clean)) + told("toxic", max(1, toxic))).orderBy(F.desc("g"), "bucket").limit(FEATURES).collect()
    column = np.full(BUCKETS, -1, np.int32)
    column[[r["bucket"] for r in best]] = np.arange(len(best))
    shares = [np.log((np.array([float(r[c]) for r in best]) + SMOOTHING) / (total + SMOOTHING * BUCKETS)) for c, total in (("toxic", toxic), ("clean", clean))]
    ratios = shares[0] - shares[1]
    bags = sample.mapInArrow(_sparse(column), "doc_id long, toxic int, size long, features array<int>, counts array<int>").toArrow().sort_by("doc_id").combine_chunks()
    features, counts = (bags.column(c).combine_chunks() for c in ("features", "counts"))
    row = np.repeat(np.arange(len(bags)), np.diff(features.offsets.to_numpy()))
    entries = _values(row, features.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False), bags.column("size").to_numpy(), ratios)
    y = bags.column("toxic").to_numpy().astype(float)
    importance = np.where(y == 1, stands[1], stands[0]) / min(stands.values())
    return column, ratios, fit_logistic(entries, y, importance, len(ratios) + 2)


def _score(column: np.ndarray, ratios: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns, values = _values(*_bags(batch, column), ratios)
            sums = np.bincount(rows, values * weights[columns], batch.num_rows)
            score = pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), score], ["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher where label 1 is likelier), predicted (1 from 0.5 on).

    docs (doc_id, text, any more), labels (doc_id, toxic, any more); only the text decides a score. A null text counts as empty;
    an empty one is scored by its length alone. Rows that repeat a text have one score. Where labels outside the held-out fold
    do not show both labels there is nothing to tell them apart: all scores are 0, or 1 if all labels are toxic. Texts of
    any length are read whole, in pieces. The sample is fitted by jobs that run when this is called.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    model, flag = _model(texts, labels, train_rows), held_out(F.col("doc_id")).alias("held_out")
    if model is None:
        toxic = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id").cast("long"))).agg(F.min("toxic")).first()[0]
        scored = texts.select("doc_id", flag, F.lit(1.0 if toxic == 1 else 0.0).alias("score"))
    else:
        scored = texts.select("doc_id", "text", flag).mapInArrow(_score(*model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
