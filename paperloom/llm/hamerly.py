"""Centroid clustering of integer vectors with Hamerly's bounds.

Each vector keeps one upper bound of the distance to its own centroid and one lower bound of the distance to the second
nearest. When centroids move, the upper bound grows by the drift of the own centroid and the lower one shrinks by the
largest drift of the others. While the upper bound is below the lower one, or below half the way from the own centroid
to the nearest other one, the assignment stands; else the upper bound is made exact, and what is still ambiguous gets a
full scan in exact integers, where ties go to the smaller number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import finite, scaled_ints, within
from .common import free, staged

CLUSTERS, ROUNDS, DIM = 40, 5, 64
#: Integer components lie within 2 to this power, so that a squared distance fits a long.
BITS = 26
#: Relative room given to bounds for the rounding of square roots.
ROOM = 1e-9


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows by centroids) of integer vectors. Doubles hold the sums exactly while they stay
    below 2**53; beyond, products are taken in integers, some rows at a time."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * max(1, x.shape[1]) * most * most < 1 << 52:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = ((x - c) ** 2).sum(axis=1)
    return out


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on ties) with the distances to it and to the second nearest."""
    d = squared(x, centroids)
    own = d.argmin(axis=1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, own])
    d[rows, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1)) if len(centroids) > 1 else np.full(len(x), np.inf)
    return own, upper * (1 + ROOM), lower * (1 - ROOM)


def drifts(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and for each the largest move of any other."""
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + ROOM)
    others = np.zeros_like(moved)
    if len(moved) > 1:
        first = moved.argmax()
        others[:] = moved[first]
        others[first] = np.delete(moved, first).max()
    return moved, others


def half_ways(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    if len(centroids) < 2:
        return np.full(len(centroids), np.inf)
    d = squared(centroids, centroids).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(axis=1)) / 2 * (1 - ROOM)


def reassign(x, own, upper, lower, old, new):
    """Assignments and bounds after centroids moved from old to new, and which vectors were scanned in full."""
    moved, others = drifts(old, new)
    upper, lower, own = upper + moved[own], np.maximum(0, lower - others[own]), own.copy()
    safe = np.maximum(lower, half_ways(new)[own])
    open_rows = np.nonzero(upper >= safe)[0]
    tight = np.sqrt(((x[open_rows] - new[own[open_rows]]) ** 2).sum(axis=1)) * (1 + ROOM)
    upper[open_rows] = tight
    open_rows = open_rows[tight >= safe[open_rows]]
    if len(open_rows):
        own[open_rows], upper[open_rows], lower[open_rows] = scan(x[open_rows], new)
    scanned = np.zeros(len(x), bool)
    scanned[open_rows] = True
    return own, upper, lower, scanned


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim).astype(np.int64)


STATE = "rid bigint, id bigint, v array<int>, cluster int, upper double, lower double, scanned boolean"


def _step(old: np.ndarray | None, new: np.ndarray):
    """Assign all vectors of a batch: by a scan where there are no bounds yet, else by the bounds kept."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), new.shape[1])
            if old is None:
                own, upper, lower = scan(x, new)
                scanned = np.ones(len(x), bool)
            else:
                own, upper, lower = (np.asarray(batch.column(k)) for k in ("cluster", "upper", "lower"))
                own, upper, lower, scanned = reassign(x, own.astype(np.int64), upper, lower, old, new)
            columns = [batch.column("rid"), batch.column("id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "id", "v", "cluster", "upper", "lower", "scanned"])

    return run


def _measured(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, own = _matrix(batch.column("v"), centroids.shape[1]), np.asarray(batch.column("cluster"))
                d = ((x - centroids[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(d)], ["id", "cluster", "distance"])

    return run


def start(rows: DataFrame, clusters: int) -> np.ndarray:
    """The first centroids: vectors with the smallest sha256 of `2:<id>`; rows without an id come last, and rows of one
    id are in the order of their components."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")).cast("binary"), 256)
    got = rows.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in got], np.int64)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; empty clusters stay. Sums are partial in the tasks, and one row a
    cluster comes to the driver."""
    sums = [F.sum(F.col("v")[k].cast("long")).alias(f"s{k}") for k in range(centroids.shape[1])]
    new = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[row["cluster"]] = [row[f"s{k}"] // row["n"] for k in range(centroids.shape[1])]
    return new


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """One row per kept vector: <id>, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dim` components, none of them null or non-finite; each component x becomes
    floor(256 * x). Vectors with a component of 2**26 or more after that are left out too, as their squared distances
    fit no long. Fewer kept vectors than `clusters` give as many centroids; rows that repeat an id or a vector are
    vectors of their own, and equal first centroids are allowed (the one of the larger number stays empty). Rows
    without an id are kept and start no cluster before those with one. Inertias beyond a long are null. Ids are
    integers, other columns are ignored, an empty table gives no rows.

    The state (vectors, assignments and both bounds) is a table in the shared folder, written anew each round; the
    driver holds the centroids only.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = kept.where(finite("vector") & (F.size("vector") == dim)).where(within("vector", BITS))
    state = staged(kept.select(F.monotonically_increasing_id().alias("rid"), "id", scaled_ints("vector").alias("v")), "vectors")
    centroids, old = start(state, clusters), None
    if not len(centroids):
        free(state)
        return spark.createDataFrame([], f"`{id_col}` bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for k in range(rounds + 1):
        assigned = staged(state.mapInArrow(_step(old, centroids), STATE), "assigned")
        free(state)
        state = assigned
        if k < rounds:
            old, centroids = centroids, moved_centroids(state, centroids)
    rows = staged(state.mapInArrow(_measured(centroids), "id bigint, cluster int, distance bigint"), "distances")
    free(state)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}

    def fits(n) -> int | None:
        return int(n) if n is not None and int(n) < 1 << 63 else None

    whole = fits(sum(int(v) for v in sums.values()))
    info = [(k, fits(sums.get(k)), names[k]) for k in range(len(names))]
    info = spark.createDataFrame(info, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    out = rows.join(F.broadcast(info), "cluster")  # a row for each centroid
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")
