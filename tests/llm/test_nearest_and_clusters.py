"""Permutation index, hard negatives and clusters against brute force, with odd rows among the vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import blocks, hamerly, hard_negatives, permutation_index, queries

ODD = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 1.0]]


def frame(spark, rows):
    """rows of (id, vector, label) beside columns with names that operators use themselves."""
    schema = "vec_id long, embedding array<double>, label int, rid string, cluster string, rank int, score double, side int"
    return spark.createDataFrame([(*r, "x", "y", 1, 2.0, 3) for r in rows], schema)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def corpus(n=700, dim=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for k in range(n):
        c = centres[k % 6] if k % 3 else centres[0]  # a third of all rows around one centre
        size = 4.0 if k % 50 == 7 else 1.0
        rows.append([size * (x + 0.4 * rng.gauss(0, 1)) for x in c])
    rows += [list(rows[20])] * 40 + [[-x for x in rows[20]]] * 3 + ODD
    return [(k, v, None if k % 41 == 5 else k % 5) for k, v in enumerate(rows)] + [(None, rows[3], 1), (20, rows[9], 2)]


# --- op11 -----------------------------------------------------------------------------------------------------------


def brute_nearest(rows, k, asks):
    real = [(i, v) for i, v, _ in rows if usable(v) and v and any(v)]
    out = []
    for a, (i, q) in enumerate(real):
        if i is not None and asks(i):
            found = [(sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(real) if b != a and len(v) == len(q)]
            found.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out.append((i, found[:k]))
    return out


@pytest.mark.parametrize("cell", [10_000, 64])
def test_nearest_finds_most(spark, monkeypatch, cell):
    monkeypatch.setattr(permutation_index, "CELL_ROWS", cell)
    monkeypatch.setattr(permutation_index, "MEMBER_BLOCK", 10 * cell)
    rows = corpus()
    got = {}
    for r in permutation_index.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i, want in brute_nearest(rows, 20, lambda i: i % 20 == 0):
        own = sorted(got[i], key=lambda s: s[0])
        if i == 20:  # two rows have this id, and each has a list
            assert len(own) == 40
            continue
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1))
        assert [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True) and i is not None
        least = want[-1][0]
        hits += sum(s >= least - 1e-9 for _, _, s in own)
        total += len(want)
    assert hits >= 0.95 * total and total > 600


def test_nearest_of_few_rows_is_exact(spark):
    rows = [(k, v, 0) for k, v in enumerate([[1.0, 0.0], [0.5, 0.5], [0.5, 0.5], [-1.0, 0.0], [0.0, 3.0], None, [0.0, 0.0]])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in permutation_index.nearest(frame(spark, rows), F.col("vec_id") < 2).collect()]
    want = [(i, n, j, s) for i, found in brute_nearest(rows, 20, lambda i: i < 2) for n, (s, j) in enumerate(found, 1)]
    assert sorted(got) == sorted(want) and len(got) == 8
    assert permutation_index.nearest(frame(spark, rows).where("vec_id < 0"), F.lit(True)).count() == 0
    assert permutation_index.nearest(frame(spark, rows), F.col("vec_id") > 99).count() == 0


def test_footrule_turned_round():
    """shared() is the footrule distance with missing pivots at the end: w * (w + 1) - 2 * shared."""
    rng = np.random.default_rng(0)
    members = np.stack([rng.permutation(40)[:12] for _ in range(30)]).astype(np.uint16)
    lists = permutation_index.inverted(members, 40)
    place = lambda order, p: list(order).index(p) if p in order else 12
    for query in members[:5]:
        want = [sum(abs(place(query, p) - place(m, p)) for p in range(40)) for m in members]
        assert (12 * 13 - 2 * permutation_index.shared(query, lists) == want).all()


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_nearest(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(table["embedding"]).astype(np.float64), table["vec_id"].to_numpy()
    hits = 0
    asked = np.nonzero(ids % 20 == 0)[0]
    for at in asked:
        scores = x @ x[at]
        scores[at] = -np.inf
        own = got[got["query_id"] == ids[at]].sort_values("rank")
        assert np.allclose(own["score"], [x[np.nonzero(ids == j)[0][0]] @ x[at] for j in own["vec_id"]], rtol=0, atol=1e-12)
        hits += len(set(own["vec_id"]) & set(ids[np.argsort(-scores)[:20]]))
    assert list(got.columns)[:4] == ["query_id", "rank", "vec_id", "score"] and len(got) == 20 * len(asked)
    assert hits >= 0.95 * 20 * len(asked)


# --- op12 -----------------------------------------------------------------------------------------------------------


def brute_negatives(rows, asks):
    real = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if usable(v) and label is not None]
    out = []
    first = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    for a, (i, q, own) in enumerate(real):
        if i is None or not asks(i):
            continue
        scored = [(sum(x * y for x, y in zip(q, v, strict=True)), j, b, label) for b, (j, v, label) in enumerate(real) if b != a and len(v) == len(q)]
        positives = sorted((s for s in scored if s[3] == own), key=first)[:5]
        for p in positives:
            negatives = sorted((s for s in scored if s[3] != own and 80 * p[0] <= 100 * s[0] <= 100 * p[0]), key=first)[:5]
            out += [(i, p[1], n, s[1], p[0], s[0]) for n, s in enumerate(negatives, 1)]
    return out


@pytest.mark.parametrize("block", [8192, 50])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
    rows = corpus()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(got, key=order) == sorted(want, key=order) and len(want) > 500
    assert hard_negatives.mine(frame(spark, rows).where("vec_id < 0"), F.lit(True)).count() == 0


def test_bounds_hold():
    """The true product of every row lies within its bounds, and the bounds leave most rows out."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(0, 0.125, (4000, 65))).astype(np.int64)
    books = hard_negatives.fit(x[:2000].astype(np.float64))
    codes, rest = hard_negatives.encode(x, books)
    scorer = hard_negatives.Scorer(codes.astype(np.int64), rest, books)
    kept = 0
    for a in x[:40]:
        low, high = scorer.bounds(a)
        true = x @ a
        assert (low <= true).all() and (true <= high).all()
        kept += (high >= hard_negatives._kth(low, 5)).sum()
    assert kept < 0.3 * 40 * len(x)


# --- op13 -----------------------------------------------------------------------------------------------------------


def brute_clusters(rows, clusters, rounds, dim):
    real = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if usable(v) and len(v) == dim]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(real, key=key)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for n in range(rounds + 1):
        own = [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in real]
        if n < rounds:
            for k in range(len(centroids)):
                mine = [v for (_, v), (_, o) in zip(real, own, strict=True) if o == k]
                if mine:
                    centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = {k: sum(d for d, o in own if o == k) for k in range(len(centroids))}
    return [(i, k, d, inertia[k], sum(inertia.values()), names[k]) for (i, _), (d, k) in zip(real, own, strict=True)]


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_clusters(spark, scale):
    """Also of integers so large that doubles do not hold their products."""
    rows = [(i, None if v is None else [None if x is None else scale * x for x in v], label) for i, v, label in corpus()]
    rows = [r for r in rows if not usable(r[1]) or all(abs(256 * x) < 2**26 for x in r[1])]
    got = [tuple(r) for r in hamerly.cluster(frame(spark, rows), clusters=12, dim=8).collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute_clusters(rows, 12, 5, 8)
    assert sorted(got, key=order) == sorted(want, key=order) and len({r[1] for r in got}) > 6
    assert hamerly.cluster(frame(spark, rows).where("vec_id < 0")).count() == 0


def test_fewer_vectors_than_clusters(spark):
    rows = [(1, [1.0] * 64, 0), (2, [1.0] * 64, 0), (3, [2.0] * 64, None), (4, [2.0] * 63, 0), (5, [1e30] + [0.0] * 63, 0)]
    got = sorted(tuple(r)[:5] for r in hamerly.cluster(frame(spark, rows)).collect())
    assert got == sorted(r[:5] for r in brute_clusters(rows[:3], 40, 5, 64)) and [r[2] for r in got] == [0, 0, 0]


def test_bounds_spare_scans():
    """After the first rounds most vectors keep their cluster without a scan, and every assignment is that of a scan."""
    rng = np.random.default_rng(5)
    x = (np.repeat(rng.normal(size=(20, 64)), 200, axis=0) * 200 + rng.normal(size=(4000, 64)) * 30).astype(np.int64)
    centroids = x[rng.permutation(4000)[:20]]
    own, upper, lower = hamerly.scan(x, centroids)
    scanned = []
    for _ in range(6):
        new = centroids.copy()
        for k in range(20):
            if (own == k).any():
                new[k] = x[own == k].sum(axis=0) // (own == k).sum()
        own, upper, lower, full = hamerly.reassign(x, own, upper, lower, centroids, new)
        centroids = new
        scanned.append(int(full.sum()))
        want, _, _ = hamerly.scan(x, centroids)
        assert (own == want).all()
    assert scanned[-1] < 0.1 * len(x)


def test_blocks_lose_nothing(spark):
    left = spark.range(37).select(F.col("id").alias("rid"), F.lit(1).alias("k"))
    right = spark.range(100, 253).select(F.col("id").alias("rid"), F.lit(1).alias("k"))
    pieces = blocks.pieces(left, right, ["k"], 10, 20).collect()
    met = {}
    for r in pieces:
        met.setdefault((r.pa, r.pb), ([], []))[r.side].append(r.rid)
    pairs = [(a, b) for one, two in met.values() for a in one for b in two]
    assert len(pairs) == len(set(pairs)) == 37 * 153
