"""Near-duplicate clusters of vectors and greedy face groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.sources.durable import checkpoint_folder, checkpointed

#: Blocks larger than this have an index.
TILE = 2048
#: Vectors of a tile of a cell, at least: two tiles meet in one task, so a vector goes to as many tasks as its cell has tiles.
MEET = 16384
#: Cells that a vector visits, on average, at most, and at most a quarter of them (or as many as its block has tiles): where it would be more,
#: the block is one cell.
VISITS = 32
#: Vectors that are compared with their block's pivots in one task, and at once.
SLICE, AT_ONCE = 8192, 512
#: Vectors of a tile that are multiplied at once with some of another: their products stay in the processor's cache.
COLUMNS = 2048
#: Vectors to a pivot, at least, and pivots of a block, at most: one task chooses them, from so many times their number.
SHARE, PIVOTS, SAMPLE = 32, 4096, 4
#: Radians that rounding may move an angle by.
ROUNDING = 1e-6

PLACED = "block string, id long, vec {}, cell int, angle double, visits array<int>, visit_angles array<double>"


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _near(angles: np.ndarray, home: np.ndarray, own: np.ndarray, theta: np.ndarray | float) -> np.ndarray:
    """Which cells of a lower number than its own can hold a partner of a vector."""
    return (angles <= (own + 2 * theta)[:, None]) & (np.arange(angles.shape[1]) < home[:, None])


def _choose_pivots(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a block's sample, again and again the vector farthest from the pivots so far, until what is left lies close to one; the
    first alone if others of the sample would visit more cells than pay."""
    frame = frame.sort_values("id")
    units, theta, most = _units(frame["vec"]), frame["theta"].iat[0], int(frame["pivots"].iat[0])
    chosen, far = [0], _angles(units, units[:1])[:, 0]
    while len(chosen) < most and far.max() > theta / 2:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _angles(units, units[chosen[-1:]])[:, 0])
    angles = _angles(np.delete(units, chosen, axis=0)[:AT_ONCE], units[chosen])
    if len(angles) and _near(angles, angles.argmin(axis=1), angles.min(axis=1), theta).sum() > len(angles) * max(min(VISITS, len(chosen) // 4), frame["tiles"].iat[0]):
        chosen = chosen[:1]
    return pd.DataFrame({"block": frame["block"].iat[0], "cell": np.arange(len(chosen), dtype=np.int32), "pivot": list(units[chosen])})


def _place(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each vector's nearest pivot, and the cells of a lower number that can hold a partner: those whose pivot is at most twice the
    greatest angle farther off."""
    if not len(rows):
        return pd.DataFrame({c: np.empty(0, object) for c in ("block", "id", "vec", "cell", "angle", "visits", "visit_angles")})
    if not len(pivots):
        return pd.DataFrame({"block": rows["block"], "id": rows["id"], "vec": rows["vec"], "cell": np.int32(0), "angle": 0.0, "visits": [[]] * len(rows), "visit_angles": [[]] * len(rows)})
    pivots = np.stack(pivots.sort_values("cell")["pivot"].to_numpy())
    home, own, visits, visit_angles = [], [], [], []
    for begin in range(0, len(rows), AT_ONCE):
        some = rows.iloc[begin : begin + AT_ONCE]
        angles = _angles(_units(some["vec"]), pivots)
        home.append(angles.argmin(axis=1))
        own.append(angles.min(axis=1))
        for k, row in enumerate(_near(angles, home[-1], own[-1], some["theta"].to_numpy())):
            visits.append(np.flatnonzero(row).astype(np.int32))
            visit_angles.append(angles[k, visits[-1]])
    return pd.DataFrame({"block": rows["block"].to_numpy(), "id": rows["id"].to_numpy(), "vec": rows["vec"].to_numpy(), "cell": np.concatenate(home).astype(np.int32), "angle": np.concatenate(own), "visits": visits, "visit_angles": visit_angles})


def _meetings(vectors: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(block, cell, lo, hi, t, id, vec, angle, resident, theta): vectors by the task (block, cell, lo, hi) that compares them."""
    rows = vectors.filter("vec IS NOT NULL").select("id", F.coalesce(F.col("block").cast("string"), F.lit("Unsorted")).alias("block"), F.col("vec"))
    # Products are made of doubles; floats travel as they are.
    kind = vectors.schema["vec"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows, placed_as, tile_of = rows.withColumn("vec", F.col("vec").cast(kind)), PLACED.format(kind), max(tile, MEET)
    norm = F.sqrt(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    # Where vectors are not of unit length, a product of at least the threshold still means a cosine of at least threshold / longest^2.
    theta = F.acos(F.least(F.lit(1.0), F.lit(float(threshold)) / (F.col("longest") * F.col("longest")))) + ROUNDING if threshold > 0 else F.lit(np.pi)
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).withColumn("theta", F.coalesce(F.nanvl(theta, F.lit(np.pi)), F.lit(np.pi)))
    blocks = blocks.select("block", "n", "theta", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"), F.when(F.col("n") > tile, F.least(F.lit(PIVOTS), F.ceil(F.greatest(F.sqrt("n"), F.col("n") / SHARE)))).otherwise(0).cast("int").alias("pivots"), F.ceil(F.col("n") / tile_of).alias("tiles"))
    blocks = checkpointed(blocks)  # a row each, used in many places: without this the plan holds what vectors are made of as many times
    dealt = rows.join(blocks, "block").withColumn("slice", F.expr("cast(pmod(xxhash64(id), slices) AS int)"))
    sample = dealt.filter((F.col("pivots") > 0) & (F.expr("pmod(xxhash64(id, 7), 1000000)") < F.col("pivots") * (SAMPLE * 1e6) / F.col("n")))
    chosen = sample.select("block", "id", "vec", "theta", "pivots", "tiles").groupBy("block").applyInPandas(_choose_pivots, "block string, cell int, pivot array<double>")
    spread = chosen.join(blocks.select("block", "slices"), "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    placed = checkpointed(dealt.select("block", "slice", "id", "vec", "theta").groupBy("block", "slice").cogroup(spread.groupBy("block", "slice")).applyInPandas(_place, placed_as))
    # A block whose vectors would visit many cells is one cell: then little can be left out, and tiles cost less.
    spent = placed.groupBy("block").agg(F.sum(F.size("visits")).alias("visits"))
    blocks = blocks.join(spent, "block").select("block", "theta", (F.col("visits") > F.col("n") * F.greatest("tiles", F.least(F.lit(VISITS), F.floor(F.col("pivots") / 4)))).alias("dense"))
    blocks = checkpointed(blocks)
    cells = placed.groupBy("block", "cell").agg(F.min("angle").alias("least"), F.max("angle").alias("radius"))
    known = placed.join(blocks, "block")
    residents = known.select("block", F.when(F.col("dense"), 0).otherwise(F.col("cell")).alias("cell"), "id", "vec", F.when(F.col("dense"), 0.0).otherwise(F.col("angle")).alias("angle"), "theta", F.lit(True).alias("resident"))
    visitors = known.filter("NOT dense").select("block", "id", "vec", "theta", F.explode(F.arrays_zip("visits", "visit_angles")).alias("v")).select("block", F.col("v.visits").alias("cell"), "id", "vec", F.col("v.visit_angles").alias("angle"), "theta", F.lit(False).alias("resident"))
    visitors = visitors.join(cells, ["block", "cell"]).filter((F.col("angle") <= F.col("radius") + F.col("theta")) & (F.col("angle") >= F.col("least") - F.col("theta"))).drop("least", "radius")
    members = residents.unionByName(visitors)
    tiles = members.groupBy("block", "cell").agg(F.ceil(F.count("*") / tile_of).cast("int").alias("tiles"))
    dealt = members.join(tiles, ["block", "cell"]).withColumn("t", F.expr("cast(pmod(xxhash64(id), tiles) AS int)"))
    # Tile t meets every tile, the lower number first.
    meeting = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"lo": F.least("t", "u"), "hi": F.greatest("t", "u")})
    return meeting.select("block", "cell", "lo", "hi", "t", "id", "vec", "angle", "resident", "theta")


def _comparing(a: np.ndarray, b: np.ndarray, threshold: float):
    """A function of ranges (begin, end, first, last) of rows of a and b: places and products of those with a product >= threshold.

    Single floats, whose error is bounded by the lengths, tell which pairs can reach the threshold; those alone are multiplied as
    doubles. Where many do, or numbers are too large for that, all are.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max()
        # Of d products and their sum, and of rounding both factors; numbers under the least single float add d * 1e-37 at most.
        least = np.float32(threshold - lengths * (a.shape[1] + 8) * 1.2e-7 - a.shape[1] * 1e-37) if np.isfinite(threshold) else np.float32("nan")
        least = np.nextafter(least, np.float32("-inf"))
        single = bool(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1e15 and np.isfinite(least))
        left, right = (x.astype(np.float32) for x in (a, b)) if single else (a, b)

    def compared(begin: int, end: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for at in range(first, last, COLUMNS):
            upto = min(at + COLUMNS, last)
            near = np.flatnonzero(left[begin:end] @ right[at:upto].T >= least) if single else None
            if near is None or len(near) * 16 > (end - begin) * (upto - at):
                score = (a[begin:end] @ b[at:upto].T).ravel()
                near = np.flatnonzero(score >= threshold)
                score = score[near]
                i, j = np.divmod(near, upto - at)
            else:
                i, j = np.divmod(near, upto - at)
                score = np.einsum("ij,ij->i", a[begin + i], b[at + j])
                i, j, score = (z[score >= threshold] for z in (i, j, score))
            found.append((i, j + (at - first), score))
        return tuple(np.concatenate(z) for z in zip(*found))

    return compared


def _products(frame: pd.DataFrame, threshold: float) -> Iterator[tuple[dict, int]]:
    """Pairs found, and products made, some rows of a meeting at a time: by their angle to the pivot, each with those at most theta away.
    Residents of one tile meet all of the other, visitors its residents only."""
    lo, hi, theta = frame["lo"].iat[0], frame["hi"].iat[0], frame["theta"].iat[0]
    own, other = frame["t"] == lo, frame["t"] == hi
    at_home = frame["resident"].astype(bool)
    sides = [(own & at_home, other & at_home), (own & at_home, other & ~at_home)] + ([(own & ~at_home, other & at_home)] if lo != hi else [])
    for k, masks in enumerate(sides):
        left, right = (frame[m].sort_values(["angle", "id"]) for m in masks)
        if not len(left) or not len(right):
            continue
        (a, x, p), (b, y, q) = ((np.stack(f["vec"].to_numpy()).astype(np.float64), f["id"].to_numpy(), f["angle"].to_numpy()) for f in (left, right))
        triangle, compared = lo == hi and k == 0, _comparing(a, b, threshold)
        for begin in range(0, len(a), 128):
            end = min(begin + 128, len(a))
            first, last = int(np.searchsorted(q, p[begin] - theta, "left")), int(np.searchsorted(q, p[end - 1] + theta, "right"))
            first = max(first, begin) if triangle else first
            if first >= last:
                continue
            i, j, score = compared(begin, end, first, last)
            m, n = x[begin + i], y[first + j]
            once = (m != n) & (begin + i < first + j) if triangle else m != n
            yield {"a": np.minimum(m, n)[once], "b": np.maximum(m, n)[once], "score": score[once]}, (end - begin) * (last - first)


def similar_pairs(vectors: DataFrame, threshold: float = R.NEAR_DUPLICATE, tile: int = TILE) -> DataFrame:
    """(block, a, b, score), a < b: vectors (id, block, vec) of a block with a product >= threshold; a null block is Unsorted.

    Exact, by an index of angles: a block larger than a tile has pivots, one to SHARE vectors, far from each other; a vector lives in
    the cell of the nearest one and visits those of a lower number where a partner can live. By the triangle inequality that is a cell whose pivot is at most 2 theta
    farther off than its own, and whose radius reaches to within theta of it; theta is the angle of the threshold. In a cell, vectors are compared
    by their angle to the pivot, with those at most theta away. A cell is cut into tiles of MEET vectors or more, and each two of them meet in a
    task of their own, so a cell may be as large as it likes. Where vectors do not lie in clusters little can be left out; such a
    block is one cell, which a sample shows before any visit is written. Null vectors are like no other.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches), ignore_index=True)
        block = frame["block"].iat[0]
        for found, _ in _products(frame, threshold):  # handed on as they are found, so a task holds its vectors only
            yield pd.DataFrame({"block": np.full(len(found["a"]), block, object), **found})

    return _meetings(vectors, threshold, tile).groupBy("block", "cell", "lo", "hi").applyInPandas(pairs, "block string, a long, b long, score double")


def _joined(frame: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """A meeting's ids in order, for each the place of the least id that its pairs reach, and pairs, one fewer than vectors at most, that
    reach as much."""
    ids = np.unique(frame["id"].to_numpy())
    label, edges = np.arange(len(ids)), []
    for found, _ in _products(frame, threshold):
        x, y = np.searchsorted(ids, found["a"]), np.searchsorted(ids, found["b"])
        apart = np.flatnonzero(label[x] != label[y])
        if not len(apart):
            continue
        p, q = label[x[apart]], label[y[apart]]
        _, once = np.unique(np.minimum(p, q) * len(ids) + np.maximum(p, q), return_index=True)
        parent: dict[int, int] = {}
        for at, i, j in zip(apart[once].tolist(), p[once].tolist(), q[once].tolist()):
            i, j = _root(parent, i), _root(parent, j)
            if i != j:
                parent[max(i, j)] = min(i, j)
                edges.append((found["a"][at], found["b"][at]))
        to = np.arange(len(ids))
        for k in parent:
            to[k] = _root(parent, k)
        label = to[label]
    return ids, label, edges


def _forest(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(a, b): pairs of a meeting, one fewer than vectors at most, that reach all that its pairs reach."""
    return pd.DataFrame(_joined(frame, threshold)[2], columns=["a", "b"], dtype=np.int64)


def _stars(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(a, b): the least id that the pairs of a meeting reach from b, where it is another."""
    ids, label, _ = _joined(frame, threshold)
    own = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[label[own]], "b": ids[own]})


def _root(parent: dict[int, int], k: int) -> int:
    while k in parent:
        up = parent[k]
        if up in parent:
            parent[k] = parent[up]
        k = up
    return k


def similar_links(vectors: DataFrame, threshold: float = R.NEAR_DUPLICATE, tile: int = TILE) -> DataFrame:
    """(a, b): of similar_pairs() as many as reach all that all of them reach.

    All vectors meet as there, and each meeting hands on a spanning forest of its pairs: fewer rows than it has vectors,
    however many pairs there are.
    """

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        return _forest(frame, threshold)

    return _meetings(vectors, threshold, tile).groupBy("block", "cell", "lo", "hi").applyInPandas(links, "a long, b long")


def similar_stars(vectors: DataFrame, threshold: float = R.NEAR_DUPLICATE, tile: int = TILE) -> DataFrame:
    """(a, b), a < b: reaches all that similar_pairs() reaches, and is as small as similar_links(), but b's a is the least id that its meeting
    reaches from b, alike to it or not. Trees are then one step deep in each meeting, so components() needs few rounds; those of
    similar_links() may be deep, and each round costs the driver a plan, its code and its broadcasts.
    """

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        return _stars(frame, threshold)

    return _meetings(vectors, threshold, tile).groupBy("block", "cell", "lo", "hi").applyInPandas(links, "a long, b long")


def products(vectors: DataFrame, threshold: float = R.NEAR_DUPLICATE, tile: int = TILE) -> DataFrame:
    """(block, vectors, products): how many products similar_pairs makes in a block, beside those with pivots."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [frame["block"].iat[0]], "products": [sum(n for _, n in _products(frame, threshold))]})

    made = _meetings(vectors, threshold, tile).groupBy("block", "cell", "lo", "hi").applyInPandas(count, "block string, products long").groupBy("block").agg(F.sum("products").alias("products"))
    sizes = vectors.filter("vec IS NOT NULL").groupBy(F.coalesce(F.col("block").cast("string"), F.lit("Unsorted")).alias("block")).agg(F.count("*").alias("vectors"))
    return sizes.join(made, "block").select("block", "vectors", "products")


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over pairs (a, b), for every id of nodes.

    Labels spread to neighbours and then jump to their label's label; each round is checkpointed.
    """
    checkpoint_folder(nodes.sparkSession)
    both = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).checkpoint()  # pairs are found once
    labels = both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")).checkpoint()
    before = None
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        spread = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("component", "least").alias("component"))
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = spread.join(jump, "component", "left").select("id", F.least("component", "further").alias("component")).checkpoint()
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def ranked_members(members: DataFrame) -> DataFrame:
    """members (component, id, pixels, size, extension) of clusters of two or more, with place 1 for the shot to keep: most pixels, then bytes, then raw, then smallest id."""
    whole = Window.partitionBy("component")
    best = whole.orderBy(F.desc(F.coalesce("pixels", F.lit(0))), F.desc(F.coalesce("size", F.lit(0))), F.desc(F.lower("extension").isin(*R.BUCKETS["raw"])), "id")
    return members.withColumns({"place": F.row_number().over(best), "members": F.count("*").over(whole)}).filter("members > 1")


def report(ranked: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Totals over all clusters (what all but the kept shots hold), and the `limit` largest clusters' members."""
    totals = ranked.agg(F.count_if(F.col("place") > 1).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("place") > 1, F.coalesce("size", F.lit(0)))), F.lit(0)).alias("reclaim_bytes"))
    largest = ranked.select("component", "members").distinct().orderBy(F.desc("members"), "component").limit(limit)
    return totals, ranked.join(largest.select("component"), "component")


def greedy_groups(vectors: DataFrame, threshold: float = R.SAME_FACE, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, person_id): vectors (id, vec, and what order names) in that order, each to the group whose mean it is most alike to (its
    product with the mean, which is not brought to unit length; at or above the threshold, the later group of equals), else to a new one.

    What a vector joins depends on all before it, so this is one pass in one task by its nature; that task
    holds the groups' sums only, and reads vectors batch by batch. Null vectors belong to no group and are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = means = None
        sizes = np.zeros(64)
        n = 0
        for frame in frames:
            labels = []
            for v in frame["vec"]:
                v = np.asarray(v, np.float64)
                best = -1
                if n:
                    alike = means[:n] @ v
                    top = len(alike) - 1 - int(alike[::-1].argmax())
                    best = top if alike[top] >= threshold else -1
                if best < 0:
                    best, n = n, n + 1
                    if sums is None:
                        sums, means = np.zeros((64, len(v))), np.zeros((64, len(v)))
                    elif best == len(sums):
                        sums, means, sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (sums, means, sizes))
                sums[best] += v
                sizes[best] += 1
                means[best] = sums[best] / sizes[best]  # of one group; the others' stay as they are
                labels.append(best)
            yield pd.DataFrame({"id": frame["id"], "person_id": labels})

    return vectors.filter("vec IS NOT NULL").select("id", "vec", *(c for c in order if c != "id")).repartition(1).sortWithinPartitions(*order).mapInPandas(run, "id long, person_id int")


def people(faces: DataFrame, show: int = 12, limit: int = 60) -> DataFrame:
    """faces (id, person_id): the largest groups with their size and first members.

    Spark keeps the first `show` of a group in each task before they move, so a group may be as large as it likes.
    """
    largest = faces.groupBy("person_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "person_id").limit(limit)
    first = faces.withColumn("_n", F.row_number().over(Window.partitionBy("person_id").orderBy("id"))).filter(F.col("_n") <= show)
    members = first.groupBy("person_id").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return largest.join(members, largest["person_id"].eqNullSafe(members["person_id"])).select(largest["person_id"], "size", "members").orderBy(F.desc("size"), "person_id")
