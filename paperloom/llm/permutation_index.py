"""Nearest vectors by inner product through a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its PREFIX nearest pivots in order, and each
cell of the index holds inverted files: by pivot, the place that the pivot has in the order of each member. A query
adds up, over the lists of its own nearest pivots, what its order and a member's have in common, which is the footrule
distance of the two orders turned round (see `shared`), and computes true inner products of the best members only.

Cells: a member belongs to the nearest of the leading pivots, whose number follows the number of vectors, and a query
visits cells in the order of its own nearness to them. How many cells, and which footrule distance is still good enough,
is calibrated: a bounded number of probe queries is compared with all vectors, and both limits are set so that they keep
the wanted share of the true neighbours of the probes.

Inner products become nearness by one more component: a vector x is (x / M, sqrt(1 - |x / M|^2)), M being the largest
length, a query q is (q / |q|, 0); all then have length 1, and the nearest is the one of largest inner product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import whole_groups
from .blocks import best, finite, pieces
from .common import free, staged

#: Vectors that pivots are taken from at most (those with the smallest hash of their number), pivots of a vector length,
#: and pivots in the order of a vector. All vectors are indexed.
SAMPLE_ROWS, PIVOTS, PREFIX = 4096, 512, 64
#: Members of a cell on average; members and queries that meet in one piece.
CELL_ROWS, MEMBER_BLOCK, QUERY_BLOCK = 4096, 8192, 4096
#: Probe queries, and the shares of their true neighbours that the cells visited and the footrule limit shall keep.
PROBES, VISIT_RECALL, FOOTRULE_RECALL = 128, 0.99, 0.97
TOP = 20


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Members with the component that brings them all to length 1."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]])


def directions(q: np.ndarray) -> np.ndarray:
    """Queries as unit vectors, with nothing in the additional component."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    q = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
    return np.hstack([q, np.zeros((len(q), 1))])


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each row in order, PREFIX at most."""
    near = x @ pivots.T
    return near.argsort(axis=1, kind="stable")[:, ::-1][:, :PREFIX].astype(np.uint16)


def inverted(order: np.ndarray, pivots: int) -> np.ndarray:
    """The inverted files of members: row p holds for each member the weight of pivot p in its order, width minus place,
    0 where p is not among its nearest. Each list has an entry for every member, as an eighth of them is in it."""
    lists = np.zeros((pivots, len(order)), np.uint8)
    width = order.shape[1]
    lists[order, np.arange(len(order))[:, None]] = np.arange(width, 0, -1)
    return lists


def shared(query: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """What the orders of a query and of each member share: the sum over pivots of the smaller weight. With missing
    pivots placed at the width w, the footrule distance is w * (w + 1) - 2 * shared, so most shared is nearest."""
    weights = np.arange(len(query), 0, -1).astype(np.uint8)
    return np.minimum(lists[query], weights[:, None]).sum(axis=0, dtype=np.int32)


class Index:
    """Pivots, cells and limits of one vector length. Without pivots all members are one cell; without probes every cell
    is visited and no member is ruled out."""

    def __init__(self, pivots: np.ndarray, longest: float, members: int):
        self.pivots, self.longest = pivots, longest
        self.cells = max(1, min(len(pivots), math.ceil(members / CELL_ROWS)))
        self.visits, self.limit, self.sizes = self.cells, 0, np.zeros(self.cells, np.int64)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each lifted member."""
        return (x @ self.pivots[: self.cells].T).argmax(axis=1) if len(self.pivots) else np.zeros(len(x), np.int64)

    def route(self, q: np.ndarray) -> np.ndarray:
        """All cells in the order in which each query would visit them."""
        if not len(self.pivots):
            return np.zeros((len(q), 1), np.int64)
        return (q @ self.pivots[: self.cells].T).argsort(axis=1, kind="stable")[:, ::-1]

    def visited(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """The cells that each query visits: as calibrated, and more where these hold too few members for k results."""
        out = []
        for route in self.route(q):
            enough = int(np.searchsorted(np.cumsum(self.sizes[route]), k + 1)) + 1
            out.append(route[: max(self.visits, enough)].astype(np.int32))
        return out

    def calibrate(self, probes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Set the limits from unit probes and, for each, the cells and orders of its true neighbours."""
        steps, commons = [], []
        for route, order, (cells, members) in zip(self.route(probes), orders(probes, self.pivots), found, strict=True):
            if len(cells):
                place = np.empty(self.cells, np.int64)
                place[route] = np.arange(self.cells)
                steps.append(place[cells])
                commons.append(shared(order, inverted(members, len(self.pivots))))
        if steps:
            self.visits = 1 + int(np.quantile(np.concatenate(steps), VISIT_RECALL, method="higher"))
            self.limit = int(np.quantile(np.concatenate(commons), 1 - FOOTRULE_RECALL, method="lower"))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch):
    """The rows of each vector length, with their vectors."""
    sizes = np.asarray(batch.column("vector").value_lengths())
    for dim in np.unique(sizes).tolist():
        rows = batch.take(pa.array(np.nonzero(sizes == dim)[0]))
        yield dim, rows, _vectors(rows.column("vector"), dim)


def _binaries(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


MEMBER = "rid bigint, id bigint, dim int, cell int, vector binary, places binary"
QUERY = "rid bigint, id bigint, dim int, cells array<int>, vector binary, places binary"


def _place(index: dict[int, Index], k: int | None):
    """Members with their cell and order (k is None), or queries with the cells that they visit for k results."""

    def run(batches):
        for batch in batches:
            for dim, rows, x in _by_dim(batch):
                own = index.get(dim) or Index(np.zeros((0, dim + 1)), 1.0, 1)
                unit = lifted(x, own.longest) if k is None else directions(x)
                where = pa.array(own.cell_of(unit), pa.int32()) if k is None else pa.array(own.visited(unit, k), pa.list_(pa.int32()))
                columns = [rows.column("rid"), rows.column("id"), pa.array([dim] * len(x), pa.int32()), where, _binaries(x), _binaries(orders(unit, own.pivots))]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "id", "dim", "cell" if k is None else "cells", "vector", "places"])

    return run


def _stacked(column: pa.Array, kind) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), kind) for v in column])


def _top(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score, then by id, then by row number."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.nonzero(scores >= np.partition(scores, -k)[-k])[0]
    return at[np.lexsort((rids[at], ids[at], -scores[at]))][:k]


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(np.iinfo(np.int64).max)).astype(np.int64)


def _truth(probes: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """The k best members of a partition for each probe, by comparing all."""

    def run(batches):
        kept: dict[tuple[int, int], list] = {}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                if dim not in probes:
                    continue
                rows = batch.take(pa.array(np.nonzero(dims == dim)[0]))
                x, rids = _stacked(rows.column("vector"), np.float64), np.asarray(rows.column("rid"))
                near = probes[dim][1] @ x.T
                for p, rid in enumerate(probes[dim][0].tolist()):
                    near[p, rids == rid] = -np.inf
                    for j in near[p].argpartition(-min(k, len(x)))[-k:].tolist():
                        if rids[j] != rid:
                            kept.setdefault((dim, rid), []).append((float(near[p, j]), int(rids[j]), rows.column("cell")[j].as_py(), rows.column("places")[j].as_py()))
            for key, found in kept.items():
                kept[key] = sorted(found, reverse=True)[:k]
        flat = [(rid, *row) for (_, rid), found in kept.items() for row in found]
        if flat:
            names = ["probe", "score", "rid", "cell", "places"]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*flat, strict=True)], names).cast(pa.schema(zip(names, [pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.binary()], strict=True)))

    return run


def _searched(index: dict[int, Index], k: int):
    """For each query of a piece its k best members among those whose footrule distance is within the limit, or among
    the k nearest by footrule where these are more."""

    def run(batches):
        for batch, cuts in whole_groups(batches, ["dim", "cell", "pa", "pb"]):
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                piece = batch.slice(s, e - s)
                queries = int((np.asarray(piece.column("side")) == 0).sum())
                if 0 < queries < len(piece):
                    yield from _found(piece.slice(0, queries), piece.slice(queries), index, k)

    return run


def _found(queries: pa.RecordBatch, members: pa.RecordBatch, index: dict[int, Index], k: int):
    own = index.get(queries.column("dim")[0].as_py())
    pivots, limit = (len(own.pivots), own.limit) if own else (0, 0)
    x, q = _stacked(members.column("vector"), np.float64), _stacked(queries.column("vector"), np.float64)
    lists = inverted(_stacked(members.column("places"), np.uint16), pivots)
    asked = _stacked(queries.column("places"), np.uint16)
    rids, ids, mine = np.asarray(members.column("rid")), _ids(members.column("id")), np.asarray(queries.column("rid"))
    places, owners, scores = [], [], []
    for n in range(len(q)):
        common = shared(asked[n], lists)
        least = limit if len(common) <= k + 1 else min(limit, int(np.partition(common, -k - 1)[-k - 1]))
        some = np.nonzero((common >= least) & (rids != mine[n]) if len(common) > k + 1 else rids != mine[n])[0]
        near = (x[some] * q[n]).sum(axis=1)
        top = _top(near, ids[some], rids[some], k)
        places.append(some[top])
        owners.append(np.full(len(top), n))
        scores.append(near[top])
    at, who = pa.array(np.concatenate(places)), pa.array(np.concatenate(owners))
    columns = [queries.column("rid").take(who), queries.column("id").take(who), members.column("rid").take(at), members.column("id").take(at), pa.array(np.concatenate(scores))]
    yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "rid", "id", "score"])


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP) -> DataFrame:
    """The k vectors of largest inner product found for each row where the condition `queries` holds: query_id, rank,
    <id>, score, nearest first, ties to the smaller id (null ids last, then in the order of rows).

    Candidates are all rows but the query's own row; rows that repeat an id or a vector are candidates of their own, and
    repeated query ids have a list each. Vectors that are null, empty or zero or hold null or non-finite components take
    no part, and vectors of different lengths do not meet. A query with fewer than k candidates gets them all. Scores
    are inner products in double precision of the vectors given. Ids are integers, other columns are ignored, an empty
    table gives no rows. The index finds most, not all, of the true neighbours (see VISIT_RECALL, FOOTRULE_RECALL); a
    vector much longer than all others makes orders alike and the calibrated limits wide, which costs time.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(finite("vector") & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)))
    most = F.array_max(F.transform("vector", F.abs))
    length = most * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "asks", length.alias("length"), "vector"), "vectors")
    index = _fit(rows)
    members = staged(rows.mapInArrow(_place(index, None), MEMBER), "members")
    _calibrate(rows, members, index, k)
    asking = staged(rows.where("asks").mapInArrow(_place(index, k), QUERY), "queries")
    visits = asking.select("rid", "id", "dim", F.explode("cells").alias("cell"), "vector", "places")
    both = pieces(visits, members, ["dim", "cell"], QUERY_BLOCK, MEMBER_BLOCK)
    found = staged(both.mapInArrow(_searched(index, k), "query bigint, query_id bigint, rid bigint, id bigint, score double"), "found")
    free(rows, members, asking)
    top = best(found, ["query"], [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("rid")], k)
    return top.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _fit(rows: DataFrame) -> dict[int, Index]:
    """Pivots of each vector length from a bounded sample, with the number and the largest length of its vectors."""
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE_ROWS).select("vector").toArrow()
    pivots: dict[int, np.ndarray] = {}
    for batch in sample.to_batches():
        for dim, _, x in _by_dim(batch):
            pivots[dim] = np.vstack([pivots.get(dim, np.zeros((0, dim))), x])[:PIVOTS]
    sizes = rows.where(F.size("vector").isin(*pivots)).groupBy(F.size("vector").alias("dim")) if pivots else None
    got = sizes.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect() if pivots else []
    return {r["dim"]: Index(lifted(pivots[r["dim"]], r["longest"]), r["longest"], r["n"]) for r in got}


def _calibrate(rows: DataFrame, members: DataFrame, index: dict[int, Index], k: int) -> None:
    """Set the limits of each vector length by probes, and the sizes of its cells (at most PIVOTS a length)."""
    probes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sample = rows.where("asks").orderBy(F.xxhash64(F.lit("probe"), "rid"), "rid").limit(PROBES).select("rid", "vector").toArrow()
    for batch in sample.to_batches():
        for dim, some, x in _by_dim(batch):
            old = probes.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
            probes[dim] = (np.concatenate([old[0], np.asarray(some.column("rid"))]), np.vstack([old[1], x]))
    near = members.mapInArrow(_truth(probes, k), "probe bigint, score double, rid bigint, cell int, places binary")
    order = [F.col("score").desc(), F.col("rid")]
    near = best(near.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(64))), ["probe", "part"], order, k)
    truth: dict[int, list] = {}
    for r in best(near, ["probe"], order, k).collect():  # PROBES * k rows at most
        truth.setdefault(r["probe"], []).append((r["cell"], np.frombuffer(r["places"], np.uint16)))
    for dim, (rids, x) in probes.items():
        if dim in index:
            found = [truth.get(rid, []) for rid in rids.tolist()]
            index[dim].calibrate(directions(x), [(np.array([c for c, _ in f], np.int64), np.stack([o for _, o in f]) if f else np.zeros((0, 0))) for f in found])
    if index:
        for r in members.where(F.col("dim").isin(*index)).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect():
            index[r["dim"]].sizes[r["cell"]] = r["n"]
