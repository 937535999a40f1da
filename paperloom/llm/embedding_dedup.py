"""Near-duplicate vectors of equal label by an inverted multi-index.

Each half of a vector has its own codebook; the pairs of codes are the cells of a grid. A vector is listed in its home
cell and visits further cells in the order of the summed squared distances of its halves to the codes, up to a limit
that is calibrated so that the home cells of neighbours at the threshold are reached with the target recall. As either
of two neighbours may reach the other's home, pairs are missed only if both fail. Cosines of the vectors that meet are
computed in double precision.

The number of codes follows the number of vectors, so that cells stay of one size; a table of fewer vectors than one
cell holds has one cell by the same rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import whole_groups
from .common import components, free, hot_keys, spread_join, staged

LEAST, RECALL = 0.93, 0.99
#: Vectors of a cell on average, and codes at most of a half (so many can be fitted on FIT_ROWS vectors).
CELL_ROWS, CODES = 256, 1024
#: Vectors that the codebooks are fitted on at most: those with the smallest hash of their id. All are indexed.
FIT_ROWS = 8192
#: Vectors of a cell that are compared in one piece; any two blocks of a larger cell meet in one piece.
BLOCK = 1024


def codes_for(vectors: int) -> int:
    """Codes of each half for so many vectors: the grid has a cell for every CELL_ROWS of them."""
    return int(min(CODES, max(1, round((vectors / CELL_ROWS) ** 0.5))))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes**2).sum(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, codes: int, recall: float = RECALL, least: float = LEAST, seed: int = 0):
    """Two codebooks by k-means and the limit of the traversal, from unit vectors. The limit is the quantile `recall`
    of how much farther than its own home a vector finds the home of a simulated neighbour at the threshold."""
    rng = np.random.default_rng(seed)
    books = []
    for half in _halves(sample):
        book = half[rng.permutation(len(half))[:codes]].copy()
        for _ in range(12):
            near = _distances(half, book).argmin(axis=1)
            for k in range(len(book)):
                if (near == k).any():
                    book[k] = half[near == k].mean(axis=0)
        books.append(book)
    x = sample[rng.integers(0, len(sample), 4096)]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.maximum(1e-12, np.sqrt((away**2).sum(axis=1, keepdims=True)))
    y = least * x + np.sqrt(1 - least**2) * away
    rows, excess = np.arange(len(x)), 0
    for hx, hy, book in zip(_halves(x), _halves(y), books, strict=True):
        d = _distances(hx, book)
        excess = excess + d[rows, _distances(hy, book).argmin(axis=1)] - d.min(axis=1)
    return books, float(np.quantile(excess, recall)) + 1e-9


def traverse(x: np.ndarray, books, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and the cells that it visits in rising order, one vector's after another's, with
    their number: those that a multi-sequence walk over the two sorted code lists passes before the summed distance
    exceeds that of the home by more than limit. The walk goes down the first list for all vectors at once; at each code
    it takes the codes of the second list that are still within the limit, and it ends where none is."""
    sides = []
    for half, book in zip(_halves(x), books, strict=True):
        d = _distances(half, book)
        order = d.argsort(axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        sides.append((order, d - d[:, :1]))
    (first, e1), (second, e2) = sides
    width = second.shape[1]
    rows, cells = [], []
    for k in range(first.shape[1]):
        at = np.nonzero(e1[:, k] <= limit)[0]
        if not len(at):
            break
        who, j = np.nonzero(e2[at] <= (limit - e1[at, k])[:, None])
        rows.append(at[who])
        cells.append(first[at[who], k] * width + second[at[who], j])
    who, cell = np.concatenate(rows), np.concatenate(cells)
    order = np.lexsort((cell, who))
    return first[:, 0] * width + second[:, 0], cell[order], np.bincount(who, minlength=len(x))


def _member(lists: pa.Array, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the sorted list of each given row holds the value."""
    ends = np.asarray(lists.offsets).astype(np.int64)
    flat = np.asarray(lists.values)[ends[0] : ends[-1]].astype(np.int64)
    key = np.repeat(np.arange(len(lists)), np.diff(ends)) * (1 << 32) + flat
    want = rows * (1 << 32) + values
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return key[at] == want


def _linked(piece: pa.RecordBatch, least: float):
    """Links between the visitors (side 0) and the members (side 1) of one piece: by node the weight of its partners
    and the node above it in the tree that stands for its links."""
    side, cls, home, weight = (np.asarray(piece.column(k)).astype(np.int64) for k in ("side", "cls", "home", "weight"))
    a, b = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    if not len(a) or not len(b):
        return None
    vectors = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in piece.column("vector")])
    i, j = np.nonzero(vectors[a] @ vectors[b].T >= least)
    i, j = a[i], b[j]
    # Pairs of one cell meet with the smaller first; pairs of two cells that visit each other count in the smaller cell.
    once = np.where(home[i] == home[j], cls[i] < cls[j], home[i] > home[j])
    other = np.nonzero(~once & (home[i] < home[j]))[0]
    once[other] = ~_member(piece.column("cells"), j[other], home[i[other]])
    i, j = i[once], j[once]
    if not len(i):
        return None
    # cls of a and b in one cell may be the same vector in both roles, so labels are by class.
    names, where = np.unique(cls, return_inverse=True)
    total = np.bincount(where[i], weight[j], len(names)) + np.bincount(where[j], weight[i], len(names))
    i, j = where[i], where[j]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.nonzero(total)[0]
    # members of a component are joined as a tree of two links below a node, so that none has very many
    some = some[np.argsort(root[some], kind="stable")]
    first = np.concatenate([[0], np.nonzero(np.diff(root[some]))[0] + 1])
    start = np.repeat(first, np.diff([*first, len(some)]))
    above = start + np.maximum(0, np.arange(len(some)) - start - 1) // 2
    return names[some], total[some].astype(np.int64), names[some[above]]


def _pieces(least: float):
    def run(batches):
        for batch, cuts in whole_groups(batches, ["label", "dim", "cell", "pa", "pb"]):
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                got = _linked(batch.slice(s, e - s), least)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["cls", "n", "root"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """One row per input row: <id>, n_links, component_id, kept.

    Vectors of equal label and length are linked when their cosine is at least `least`. Vectors that are null, empty or
    zero or hold null or non-finite components, and those of null label, are linked with nothing: n_links 0, their own
    component. Equal vectors of a label are one class with a weight, never expanded into pairs; each counts the others
    among its links. component_id is the smallest id that links reach. Rows that repeat an id count as vectors of their
    own. Labels are integers. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    hashes = [F.when(F.col("valid"), F.xxhash64(F.lit(k), "label", "vector")).alias(f"h{k}") for k in (1, 2)]
    rows = staged(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "vector", *hashes), "vectors")
    classes = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("rid").alias("cls"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    classes = staged(classes, "classes")
    books: dict[int, tuple] = {}
    by_size = classes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    got = classes.orderBy(F.xxhash64("cls"), "cls").limit(FIT_ROWS).select("vector").toArrow()
    sample = [np.asarray(v, np.float64) for v in got.column("vector").to_pylist()]
    dims = {len(v) for v in sample}
    numbers = {r["dim"]: r["n"] for r in by_size.where(F.col("dim").isin(*dims)).collect()} if dims else {}
    for dim in dims:
        own = np.stack([v for v in sample if len(v) == dim])
        books[dim] = fit(_unit(own), codes_for(numbers[dim]), least=least)

    def place(batches):
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            out: dict[str, list] = {k: [] for k in ("cls", "dim", "home", "weight", "label", "vector", "cells")}
            for dim in np.unique(sizes).tolist():
                mine = np.nonzero(sizes == dim)[0]
                x = _unit(np.asarray(lists.take(pa.array(mine)).flatten()).reshape(len(mine), dim))
                if dim in books:
                    home, cells, count = traverse(x, *books[dim])
                else:  # a length that is not in the sample is one cell: all its vectors meet
                    home = cells = np.zeros(len(x), np.int64)
                    count = np.ones(len(x), np.int64)
                out["home"] += home.tolist()
                out["dim"] += [dim] * len(mine)
                out["vector"] += [v.tobytes() for v in x]
                out["cells"] += np.split(cells.astype(np.int32), np.cumsum(count)[:-1])
                for k in ("cls", "weight", "label"):
                    out[k] += batch.column(k).take(pa.array(mine)).to_pylist()
            kinds = {"vector": pa.binary(), "cells": pa.list_(pa.int32()), "dim": pa.int32(), "home": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    schema = "cls bigint, dim int, home int, weight bigint, label bigint, vector binary, cells array<int>"
    placed = staged(classes.select("cls", "weight", "label", "vector").mapInArrow(place, schema), "placed")
    cell = ["label", "dim", "cell"]
    data = ["cls", "home", "weight", "vector", "cells"]
    visitors = placed.select("label", "dim", F.explode("cells").alias("cell"), *data)
    members = placed.select("label", "dim", F.col("home").alias("cell"), *data)
    counts = placed.select("label", "dim", F.explode("cells").alias("cell"), "home")
    counts = counts.groupBy(*cell).agg(F.count(F.lit(1)).alias("na"), F.sum((F.col("home") == F.col("cell")).cast("long")).alias("nb"))
    counts = counts.where("nb > 0 AND na > 1").select(*cell, F.ceil(F.col("na") / BLOCK).alias("parts_a"), F.ceil(F.col("nb") / BLOCK).alias("parts_b"))
    counts = staged(counts, "cells")

    def spread(side: DataFrame, role: int, own: str, other: str) -> DataFrame:
        side = side.join(counts, cell).withColumn(f"p{own}", F.pmod(F.xxhash64("cls"), F.col(f"parts_{own}")))
        side = side.withColumn(f"p{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{other}") - 1)))
        # only members are asked which cells they visit
        cells = F.col("cells") if role else F.lit(None).cast("array<int>")
        return side.select(*cell, "pa", "pb", F.lit(role).alias("side"), *data[:-1], cells.alias("cells"))

    both = spread(visitors, 0, "a", "b").unionByName(spread(members, 1, "b", "a"))
    keys = [*cell, "pa", "pb"]
    both = both.repartition(*keys).sortWithinPartitions(*keys)
    found = staged(both.mapInArrow(_pieces(least), "cls bigint, n bigint, root bigint"), "found")
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    info = classes.select("h1", "h2", "cls", "weight").join(links, "cls", "left")
    info = info.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    key = F.struct("h1", "h2").alias("key")
    info = staged(info.select(key, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), "info")
    free(placed, counts, found, classes)
    keyed = staged(rows.where("h1 IS NOT NULL").select("id", key), "keyed")
    named = staged(spread_join(keyed, info, "key", hot_keys(keyed, "key")).select("id", "n_links", "root"), "named")
    heads = staged(named.groupBy("root").agg(F.min("id").alias("head")), "heads")
    linked = spread_join(named, heads, "root", hot_keys(named, "root")).select("id", "n_links", F.col("head").alias("component"))
    alone = rows.where("h1 IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
