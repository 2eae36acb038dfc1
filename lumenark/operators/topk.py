"""The k most alike vectors of each of many queries, exactly, by cells of vectors whose bounds say which can be left out.

A bounded sample gives pivots far from each other; each vector lies in its nearest pivot's cell, and of a cell the number of vectors, the
greatest angle to the pivot and the greatest length are known. A query first looks into the nearest cells that hold k vectors. By the triangle
inequality no vector of a cell is more alike to it than one at its angle to the pivot less the cell's; cells that can't reach its k-th score so
far are left out. Each task hands on k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenark.operators.clusters import _angles, _units
from lumenark.sources.durable import checkpointed

#: Cells, at most, and vectors of the sample for each: what the driver and each task hold of an index.
CELLS, SAMPLE = 1024, 4
#: Vectors of a shelf (a run of cells), at least, and of a slice of it, and queries, that meet in one task; queries that are looked at at once.
SLICE, QUERIES, AT_ONCE = 8192, 4096, 256
#: Scores are compared rounded to so many digits, so that the order of sums does not matter; equal ones go by the larger key.
DIGITS = 12
SAFE = 1e-9


@dataclass(frozen=True)
class Bounds:
    """By cell: pivot, radius, count and longest; small enough for every task."""

    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    longest: np.ndarray

    @property
    def shelf(self) -> np.ndarray:
        """Of each cell the shelf it stands on."""
        return ((np.cumsum(self.count) - self.count) // SLICE).astype(np.int32)

    def order(self, units: np.ndarray) -> np.ndarray:
        return _angles(units, self.pivots)

    def probed(self, angles: np.ndarray, k: int) -> list[np.ndarray]:
        """Of each query the nearest cells that hold k vectors together."""
        nearest = np.argsort(angles, axis=1, kind="stable")
        enough = np.cumsum(self.count[nearest], axis=1)
        return [row[: int(np.searchsorted(sums, k)) + 1] for row, sums in zip(nearest, enough)]

    def most(self, angles: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What a vector of each cell can score at most."""
        return lengths[:, None] * self.longest * np.cos(np.clip(angles - self.radius - SAFE, 0.0, np.pi / 2)) + SAFE


@dataclass(frozen=True)
class Index:
    """placed (key, vec, cell), and the cells' bounds."""

    placed: DataFrame
    bounds: Bounds


def _pivots(units: np.ndarray, most: int) -> np.ndarray:
    chosen, far = [0], _angles(units, units[:1])[:, 0]
    while len(chosen) < most and far.max() > 1e-3:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _angles(units, units[chosen[-1:]])[:, 0])
    return units[chosen]


def build(vectors: DataFrame, key: str = "id", vec: str = "vec", cells: int = CELLS) -> Index | None:
    """An index of vectors (key long, vec); rows with a null in either are left out. None if there is no row."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")).filter("key IS NOT NULL AND vec IS NOT NULL")
    n = rows.count()
    if not n:
        return None
    wanted = min(cells, max(1, int(np.ceil(np.sqrt(n)))))
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE * wanted).toPandas()  # bounded by SAMPLE * CELLS
    pivots = _pivots(_units(sample["vec"]), wanted)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            angles = _angles(_units(frame["vec"]), pivots) if len(frame) else np.zeros((0, len(pivots)))
            yield frame.assign(cell=angles.argmin(axis=1).astype(np.int32), angle=angles.min(axis=1), length=[float(np.linalg.norm(v)) for v in frame["vec"]])

    placed = checkpointed(rows.mapInPandas(place, "key long, vec array<double>, cell int, angle double, length double"))
    known = placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n"), F.max("length").alias("m")).toPandas()  # a row a cell
    radius, count, longest = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    radius[known["cell"]], count[known["cell"]], longest[known["cell"]] = known["r"], known["n"], known["m"]
    return Index(placed.select("key", "vec", "cell"), Bounds(pivots, radius, count, longest))


def _first(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key")))).filter(F.col("_k") <= k).drop("_k")


def _hits(index: Index, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score): of the cells that pairs (see PAIRS) name, k rows a query and task at most."""
    spark = pairs.sparkSession
    on, count = index.bounds.shelf, index.bounds.count
    held = np.bincount(on, count)
    sizes = F.broadcast(spark.createDataFrame([(c, int(s), int(-(-held[s] // SLICE))) for c, (s, n) in enumerate(zip(on, count)) if n], "cell int, shelf int, slices int"))  # at most CELLS rows
    shelves = F.broadcast(spark.createDataFrame([(s, int(-(-n // SLICE))) for s, n in enumerate(held.tolist()) if n], "shelf int, slices int"))
    asked = pairs.groupBy("shelf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    left = index.placed.join(sizes, "cell").join(asked, "shelf").select("shelf", F.expr("cast(pmod(xxhash64(key), slices) AS int)").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cell", "key", "vec")
    right = pairs.join(shelves, "shelf").join(asked, "shelf").select("shelf", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.expr("cast(pmod(xxhash64(query_id), parts) AS int)").alias("part"), "query_id", "qvec", "cells")

    def best(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "key": [], "score": []}
        if len(vectors) and len(queries):
            v, keys, cell = np.stack(vectors["vec"].to_numpy()), vectors["key"].to_numpy(), vectors["cell"].to_numpy()
            for begin in range(0, len(queries), AT_ONCE):
                some = queries.iloc[begin : begin + AT_ONCE]
                scores = np.round(np.stack(some["qvec"].to_numpy()) @ v.T, DIGITS) + 0.0
                for query, cells, row in zip(some["query_id"], some["cells"], scores):
                    own = np.flatnonzero(np.isin(cell, cells))  # cells of the shelf that the query does not ask are left out
                    row = row[own]
                    top = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if k < len(row) else np.arange(len(row))
                    top = top[np.lexsort((-keys[own[top]], -row[top]))][:k]
                    out["query_id"].append(np.full(len(top), query))
                    out["key"].append(keys[own[top]])
                    out["score"].append(row[top])
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.float64 if c == "score" else np.int64) for c, x in out.items()})

    groups = ("shelf", "slice", "part")
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(best, "query_id long, key long, score double")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("qvec")).filter("query_id IS NOT NULL AND qvec IS NOT NULL")


#: A row for each query and shelf, with the cells of it that the query looks into: a query travels once a shelf, not once a cell.
PAIRS = "query_id long, qvec array<double>, shelf int, cells array<int>"


def _pairs(frame: pd.DataFrame, cells: list[np.ndarray], on: np.ndarray) -> pd.DataFrame:
    at, shelves, parts = [], [], []
    for k, own in enumerate(cells):
        own = np.sort(own)
        first = np.flatnonzero(np.diff(on[own], prepend=-1))
        at += [k] * len(first)
        shelves.append(on[own[first]])
        parts += np.split(own.astype(np.int32), first[1:]) if len(own) else []
    frame = frame.iloc[at]
    return pd.DataFrame({"query_id": frame["query_id"].to_numpy(), "qvec": frame["qvec"].to_numpy(), "shelf": np.concatenate([np.zeros(0, np.int32), *shelves]), "cells": pd.Series(parts, dtype=object)})


def _some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for begin in range(0, len(frame), AT_ONCE):
            yield frame.iloc[begin : begin + AT_ONCE]


def _both(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of the first look, its hits, and pairs of the second."""
    bounds, on = index.bounds, index.bounds.shelf

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _some(frames):
            yield _pairs(frame, bounds.probed(bounds.order(_units(frame["qvec"])), k), on)

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _some(frames):
            angles = bounds.order(_units(frame["qvec"]))
            lengths = np.array([np.linalg.norm(v) for v in frame["qvec"]])
            can = (bounds.most(angles, lengths) >= frame["kth"].fillna(-np.inf).to_numpy(np.float64)[:, None]) & (bounds.count > 0)
            for row, seen in zip(can, bounds.probed(angles, k)):
                row[seen] = False
            yield _pairs(frame, [np.flatnonzero(row) for row in can], on)

    asked = _asked(queries)
    first = checkpointed(asked.mapInPandas(probe, PAIRS))
    hits = checkpointed(_first(_hits(index, first, k), k))
    kth = hits.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    second = checkpointed(asked.join(kth, "query_id", "left").select("query_id", "qvec", "kth").mapInPandas(reach, PAIRS))
    return first, hits, second


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score): for each query (query_id long, once; vec) the k vectors with the largest products, the larger key first among equals."""
    _, hits, second = _both(index, queries, k)
    return _first(hits.unionByName(_hits(index, second, k)), k)


def looked_into(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """One row: queries, cells that have vectors, and how many (query, cell) pairs were looked into and left out."""
    first, _, second = _both(index, queries, k)
    cells = int((index.bounds.count > 0).sum())
    both = first.select("cells").unionByName(second.select("cells")).agg(F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("looked"))
    return _asked(queries).agg(F.count("*").alias("queries")).join(F.broadcast(both)).select("queries", F.lit(cells).alias("cells"), "looked", (F.col("queries") * cells - F.col("looked")).alias("left_out"))  # one row each
