"""Whitening of embeddings with an exact covariance, by digit-slice matrix products.

Vectors are integers x. Around n vectors with sums S the centred vector is n*x - S, an integer too. Its entries are cut
into balanced digits of DIGIT bits; each digit is a float64 matrix of its own, and the product of two of them is exact in
float64 for a block of BLOCK rows, since no sum passes 2^53. Products are put together as big integers, which
leave each task as limbs of 32 bits that Spark adds up. Only the sum, one number per pair of dimensions, comes to
the driver, where its quotients are rounded once and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import fresh, prepare, spool

COMPONENTS = 4
#: Digits lie in [-2^(DIGIT-1), 2^(DIGIT-1)], so a product has at most 2^(2*DIGIT-2), and BLOCK of them at most 2^53.
DIGIT, BLOCK = 20, 1 << 15
LIMB = 32
#: Eigenvalues below this share of the largest one are rounding, not variance.
NOTHING = 1e-13


def quantised(column: str) -> Column:
    """floor(256 * c) of each entry as long, at the bounds of long beyond them; null for a vector that is null or holds a null or non-finite entry."""
    vector = F.col(column).cast("array<double>")
    sound = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda c: F.floor(c * 256.0).cast("long")))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, in longs where they hold it and else in Python's integers."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if n * largest + max(map(abs, sums)) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Float64 matrices d0, d1, ... with y = sum of dk * 2^(DIGIT*k)."""
    out, half = [], 1 << (DIGIT - 1)
    while y.any():
        rest = (y + half) >> DIGIT
        out.append((y - (rest << DIGIT)).astype(np.float64))
        y = rest
    return out


def gram(y: np.ndarray) -> np.ndarray:
    """y' y of an integer matrix, as an object array of exact integers."""
    total = np.zeros((y.shape[1],) * 2, object)
    for begin in range(0, len(y), BLOCK):
        slices = digits(y[begin : begin + BLOCK])
        for k, left in enumerate(slices):
            for m in range(k, len(slices)):
                product = (left.T @ slices[m]).astype(np.int64).astype(object)
                total += (product if k == m else product + product.T) << (DIGIT * (k + m))
    return total


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _grams(n: int, sums: list[int], limbs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = None, [], 0
        for batch in batches:
            waiting.append(_vectors(batch.column("x")))
            size += len(waiting[-1])
            if size >= BLOCK:
                own = gram(centred(np.concatenate(waiting), n, sums))
                total, waiting, size = own if total is None else total + own, [], 0
        if size:
            own = gram(centred(np.concatenate(waiting), n, sums))
            total = own if total is None else total + own
        if total is None:
            return
        i, j = np.triu_indices(len(total))
        value, columns = total[i, j], []
        for k in range(limbs):
            columns.append(pa.array((value & ((1 << LIMB) - 1) if k < limbs - 1 else value).astype(np.int64)))
            value = value >> LIMB
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *columns], ["i", "j", *(f"limb{k}" for k in range(limbs))])

    return run


def exact_gram(fit: DataFrame, n: int, sums: list[int], largest: int) -> list[list[int]]:
    """The sum over fit (x) of the centred vectors' products. largest: a bound of |x|."""
    bits = (n * (n * largest + max(map(abs, sums))) ** 2).bit_length() + 1
    limbs = bits // LIMB + 1  # the last one keeps the sign
    schema = "i int, j int, " + ", ".join(f"limb{k} long" for k in range(limbs))
    merged = fit.mapInArrow(_grams(n, sums, limbs), schema).groupBy("i", "j").agg(*(F.sum(f"limb{k}").alias(f"limb{k}") for k in range(limbs)))
    d = len(sums)
    out = [[0] * d for _ in range(d)]
    for row in merged.toLocalIterator():  # one row per pair of dimensions
        i, j, *parts = row
        out[i][j] = out[j][i] = sum(int(v) << (LIMB * k) for k, v in enumerate(parts))
    return out


def components(products: list[list[int]], n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows, shares of the trace), largest first; none where nothing varies.

    products is n^2 times the centred sum of products, hence n^3 times the covariance. Each vector's largest entry is positive.
    """
    d = len(products)
    largest = max((abs(v) for row in products for v in row), default=0)
    if not largest:
        return np.zeros(0), np.zeros((0, d)), np.zeros(0)
    scaled = np.array([[float(Fraction(v, largest)) for v in row] for row in products])  # quotients rounded once
    values, vectors = np.linalg.eigh(scaled)
    order = [k for k in np.argsort(-values, kind="stable")[:most] if values[k] > NOTHING * d * values.max()]
    rows = vectors.T[order]
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True) * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    trace = Fraction(sum(products[k][k] for k in range(d)), largest)
    unit = float(Fraction(largest, n**3))
    return values[order] * unit, rows, values[order] / float(trace)


def _project(y: np.ndarray, n: int, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return (y.astype(np.float64) / n) @ rows.T / np.sqrt(values)


def _moments(n: int, sums: list[int], values: np.ndarray, rows: np.ndarray):
    """Sums of the whitened vectors and of their products, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(len(values)), np.zeros((len(values),) * 2)
        for batch in batches:
            w = _project(centred(_vectors(batch.column("x")), n, sums), n, values, rows)
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([first.tolist()]), pa.array([second.ravel().tolist()])], ["first", "second"])

    return run


def _whiten(n: int, sums: list[int], values: np.ndarray, rows: np.ndarray, shares: np.ndarray, error: float):
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(_vectors(batch.column("x")), n, sums)
            w = _project(y, n, values, rows)
            # Longs hold the squares' sum unless it is larger; then it is made of Python's integers, and null beyond long.
            small = y.size and y.dtype != object and float(np.abs(y).max()) ** 2 * y.shape[1] < 2**62
            squares = (y * y).sum(axis=1) if small else (y.astype(object) ** 2).sum(axis=1)
            squares = [int(v) if v < 1 << 63 else None for v in squares]
            m = len(y)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per sound row of embeddings (vec_id, the vector, any more) and component: SCHEMA's columns.

    A vector that is null or holds a null or non-finite entry is dropped. Vectors have one length, the commonest among different
    sound vectors (of equally common ones the largest); others are dropped. Rows that repeat a vector count once in
    the covariance and are all returned; a null vec_id stays null. Components without variance are left out: one vector, or no
    row, gives no rows. A deviation beyond long is null. Jobs run when this is called: different vectors are written to the
    shared checkpoint folder and read for their sums, their products and the check of the identity.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    held = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(column).alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    fit = spool(held.select("x").distinct())
    sizes = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.greatest(F.abs(F.array_max("x").cast("decimal(20,0)")), F.abs(F.array_min("x").cast("decimal(20,0)")))).alias("largest"))
    chosen = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if chosen is None:
        return spark.createDataFrame([], SCHEMA)
    d, n, largest = chosen["d"], chosen["n"], int(chosen["largest"])
    fit, held = fit.filter(F.size("x") == d), held.filter(F.size("x") == d)
    by_place = fit.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in by_place.orderBy("place").collect()]  # one row a dimension
    values, rows, shares = components(exact_gram(fit, n, sums, largest), n, most)
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    k = len(values)
    first, second = np.zeros(k), np.zeros((k, k))
    tasks = fit.mapInArrow(_moments(n, sums, values, rows), "first array<double>, second array<double>")
    summed = tasks.select("first", "second").agg(
        F.array(*(F.sum(F.col("first")[a]) for a in range(k))).alias("first"), F.array(*(F.sum(F.col("second")[a]) for a in range(k * k))).alias("second")
    ).first()
    first, second = np.array(summed["first"]) / n, np.array(summed["second"]).reshape(k, k) / n
    # Whitened vectors are centred by whole numbers; what is left of their mean is rounding.
    error = float(np.abs(second - np.outer(first, first) - np.eye(k)).max())
    return held.mapInArrow(_whiten(n, sums, values, rows, shares, error), SCHEMA)
