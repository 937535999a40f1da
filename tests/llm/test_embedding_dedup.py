import random

import numpy as np
import pyarrow as pa
import pytest
from brute import linked_vectors

from paperloom.llm import embedding_dedup as ed


def corpus():
    rng = random.Random(2)
    unit = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    rows = [(unit(16), k % 3) for k in range(150)]
    for base, label in list(rows[:30]):
        for noise in (0.0, 0.05, 0.3, 0.42):
            rows.append(([x + noise * rng.gauss(0, 1) for x in base], label))
        rows.append(([2 * x for x in base], label))
        rows.append((base, (label + 1) % 3))
    centre = unit(16)
    rows += [([x + 0.25 * rng.gauss(0, 1) for x in centre], 1) for _ in range(120)] + [(centre, 1)] * 40
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [0.0] * 15, 1), ([None] + [1.0] * 15, 1), (centre, None), (unit(3), 1), ([1.0], 2), ([5.0], 2)]
    return [(k, v, label) for k, (v, label) in enumerate(rows)]


def test_all_links(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, cls int")
    for block in (1024, 16):
        monkeypatch.setattr(ed, "BLOCK", block)
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_vectors(frame).collect())
        want = linked_vectors(rows)
        missed = sum(a[1] != b[1] for a, b in zip(got, want, strict=True))
        assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and missed <= 5
    assert ed.near_vectors(frame.where("vec_id < 0")).count() == 0


def test_repeated_ids_and_nulls(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (2, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in ed.near_vectors(frame).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 0, 2, True), ("None", 2, 1, False)]


@pytest.mark.parametrize("dim", [64, 96])
def test_recall_of_planted_neighbours(spark, tmp_path, dim):
    """20 000 vectors in many cells: pairs at cosines just above the threshold and families far above it, against all
    pairs compared in blocks."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(dim)
    n = 20_000
    x = rng.normal(size=(n, dim))
    x[:4000] += 3 * rng.normal(size=(8, dim))[rng.integers(0, 8, 4000)]  # some directions are dense
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    for k in range(0, 3000, 2):
        away = rng.normal(size=dim)
        away -= (away @ x[k]) * x[k]
        away /= np.sqrt(away @ away)
        cosine = rng.uniform(0.931, 0.95) if k % 4 else rng.uniform(0.95, 0.999)
        x[k + 1 + 10_000] = cosine * x[k] + np.sqrt(1 - cosine**2) * away
    label = np.zeros(n, np.int64)
    label[19_000:] = 1
    want = np.zeros(n, np.int64)
    for s in range(0, n, 2000):
        links = (x[s : s + 2000] @ x.T >= 0.93) & (label[s : s + 2000, None] == label[None, :])
        want[s : s + 2000] = links.sum(axis=1) - 1
    assert want.sum() >= 3000 and ed.codes_for(n) > 4
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x), "label": label}), f"{tmp_path}/v.parquet")
    got = ed.near_vectors(spark.read.parquet(f"file://{tmp_path}/v.parquet")).orderBy("vec_id").toPandas()
    found = got["n_links"].to_numpy()
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()


def test_links_of_a_large_group_are_a_tree(spark, monkeypatch):
    """No vector of one group of near copies gets links in number of the group."""
    seen = []
    real = ed.components

    def counting(edges):
        both = edges.where("a <> b").selectExpr("a AS x").unionAll(edges.where("a <> b").selectExpr("b AS x"))
        seen.append(both.groupBy("x").count().agg({"count": "max"}).first()[0])
        return real(edges)

    monkeypatch.setattr(ed, "components", counting)
    monkeypatch.setattr(ed, "BLOCK", 512)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(k, [float(v) for v in centre + 0.02 * rng.normal(size=16)], 1) for k in range(1500)]
    got = ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 1500
    assert sum(r.n_links for r in got) >= 0.97 * 1500 * 1499  # the index finds most links
    assert seen[0] <= 100
