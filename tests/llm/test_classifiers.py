import zlib

import numpy as np
import pytest

from paperloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_trees_find_a_rule_and_survive_odd_input():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for xs, ys in ((x[:0], y[:0]), (x[:50], np.ones(50)), (np.zeros((100, 5)), y[:100])):
        scores = quality.fit(xs, ys).score(x[:3])
        assert np.isfinite(scores).all() and ((scores >= 0) & (scores <= 1)).all()
    assert (quality.fit(x[:2000], y[:2000]).score(x) == model.score(x)).all()


def test_flat_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    model = quality.fit(x, (x[:, 0] > 0).astype(float), trees=7, depth=3)
    for row, score in zip(x[:40], model.score(x[:40]), strict=True):
        logit = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            logit += leaf[k - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-logit)))


def test_statistics_of_odd_texts():
    stats = quality.statistics([b"", b" ", b"\n\n", b"a", "é🙂".encode(), b"x" * 1_000_000, b"\x00\x01"])
    assert np.isfinite(stats).all() and not stats[0].any()


def test_windows_equal_a_plain_convolution():
    rng = np.random.default_rng(3)
    ids, ends = toxicity.word_ids([b"a b c d e", b"", b"b a", b"c", b"e d c b a a a"])
    known = np.unique(ids)[:4]
    net = toxicity.Network(known, rng.normal(size=(4, toxicity.SIZE)).astype(np.float32), [rng.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                           [np.full(toxicity.FILTERS, -0.2, np.float32) for _ in toxicity.WIDTHS], np.ones(len(toxicity.WIDTHS) * toxicity.FILTERS, np.float32), 0.0, {"": 0.3})
    slot, table = net.tables()
    best, _ = net.pooled(slot[ids], ends, table)
    emb = np.zeros((toxicity.BUCKETS, toxicity.SIZE), np.float32)
    emb[known] = net.rows
    start = 0
    for d, end in enumerate(ends):
        words = np.concatenate([emb[ids[start:end]], np.zeros((2, toxicity.SIZE), np.float32)])
        want = [max([0.0, *[float((words[t : t + w] * net.kernels[k][:, :, f]).sum() + net.bias[k][f]) for t in range(end - start)]]) for k, w in enumerate(toxicity.WIDTHS) for f in range(toxicity.FILTERS)]
        assert best[d] == pytest.approx(want, abs=1e-4)
        start = end


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, kind):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    module, folds, held = (quality, 5, 0) if kind == "quality" else (toxicity, 4, 2)
    model = module.train(docs, labels)
    scores = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    rows = [(scores[r.doc_id], r[kind]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % folds == held]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > (0.99 if kind == "quality" else 0.93)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", 1.0), (1, "", None, 1.0), (None, "x", "xx", 1.0)], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for labels in (none, odd):
            got = module.score(docs, module.train(docs, labels)).collect()
            assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    empty = docs.where("doc_id > 5")
    assert quality.score(empty, quality.train(empty, odd)).count() == 0
    assert quality.keep_good(docs, quality.train(docs, none)).columns == docs.columns


def test_training_rows_are_bounded(spark, monkeypatch):
    """One id in thousands of rows is one row to learn from, and words have a bound of their own."""
    seen = {}
    for module, of in ((quality, lambda x, y: (len(x), 0)), (toxicity, lambda ids, ends, y: (len(ends), len(ids)))):
        monkeypatch.setattr(module, "fit", lambda *a, module=module, of=of, real=module.fit: seen.setdefault(module.__name__, []).append(of(*a)) or real(*a))
    texts = [(1, f"some words {k}") for k in range(3000)] + [(k, "one two three " * k) for k in range(2, 30)]
    docs = spark.createDataFrame(texts, "`doc id` long, text string").withColumnRenamed("doc id", "doc_id")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 30)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        module.train(docs, labels, folds=1, held=1, rows=10)
        module.train(docs, labels, folds=1, held=1)
    assert seen[quality.__name__] == [(10, 0), (29, 0)]
    few, many = seen[toxicity.__name__]
    assert few[0] <= 10 and 15 <= many[0] <= 29
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 100)
    toxicity.train(docs, labels, folds=1, held=1)
    assert seen[toxicity.__name__][-1][1] <= 100


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "some text", "en", 9)], "`doc id` long, text string, lang string, score int")
    labels = spark.createDataFrame([], "`doc id` long, quality int, toxic int")
    for module in (quality, toxicity):
        rows = module.score(docs, module.train(docs, labels, id_col="doc id"), id_col="doc id").collect()
        assert rows[0]["doc id"] == 1 and 0 <= rows[0].score <= 1


def test_trees_fitted_where_rows_lie_are_those_of_the_driver(spark):
    """However the rows are dealt, and with a table written anew between the trees."""
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 12, size=(900, 4)).astype(float)
    y = ((x[:, 1] > 3) ^ (x[:, 3] > 5) ^ (rng.random(900) < 0.1)).astype(float)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "y int, stats array<double>")
    want = quality.fit(x, y, trees=quality.TREES_A_TABLE + 2, depth=3)
    one, many = (quality.fit_rows(rows.repartition(n), trees=quality.TREES_A_TABLE + 2, depth=3) for n in (1, 7))
    assert (one.feature == many.feature).all() and (one.threshold == many.threshold).all() and (one.leaf == many.leaf).all()
    assert one.score(x) == pytest.approx(want.score(x), abs=1e-6)
    assert len(quality.fit_rows(rows.where("y = 1")).feature) == 0 and quality.fit_rows(rows.limit(0)).base == 0
    cells = quality._cells(np.array([-5.0, -1.0, -0.0, 0.0, 1e-9, 1.0, 1.001, 7.0]))
    assert (np.diff(cells) >= 0).all() and (quality._cell_end(cells) >= [-5.0, -1.0, 0.0, 0.0, 1e-9, 1.0, 1.001, 7.0]).all()


def test_trees_learn_from_all_labelled_rows(spark, monkeypatch):
    """Beyond TRAIN_ROWS nothing is left out: most of the labelled rows are bad, whichever a sample would have taken."""
    monkeypatch.setattr(quality, "TRAIN_ROWS", 30)
    monkeypatch.setattr(quality, "fit", lambda *a: pytest.fail("fitted on the driver"))
    monkeypatch.setattr(quality.fit_rows, "__defaults__", (3, *quality.fit_rows.__defaults__[1:]))
    docs = spark.createDataFrame([(k, "good words here. " * (k % 9 + 1) if k % 4 == 0 else "||##" * (k % 7 + 1)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int")
    model = quality.train(docs, labels, folds=1, held=1)
    assert model.base == pytest.approx(np.log(0.25 / 0.75))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(scores[k] for k in range(0, 400, 4)) > max(scores[k] for k in range(400) if k % 4)


def test_network_learns_from_all_labelled_rows(spark, monkeypatch):
    """Beyond TRAIN_ROWS nothing is left out: shards learn words that are rare in each of them, and reruns agree."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 150)
    monkeypatch.setattr(toxicity, "fit", lambda *a: pytest.fail("fitted on the driver"))
    rng = np.random.default_rng(4)
    words = ["blue", "house", "river", "stone", "walk", "green", "table"]
    texts = [(k, " ".join([*rng.choice(words, 12), *([f"vile{k % 40}"] if k % 4 == 0 else [])]), "en" if k % 3 else None) for k in range(1200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1200)], "doc_id long, toxic int")
    one, two = (toxicity.train(docs.repartition(n), labels, folds=1, held=1) for n in (2, 5))
    assert (one.rows == two.rows).all() and (one.weight == two.weight).all() and one.thresholds == two.thresholds
    assert len(one.known) >= 10 and set(one.thresholds) == {"", "en"}
    scores = {r.doc_id: r.score for r in toxicity.score(docs, one).collect()}
    good, bad = [scores[k] for k in range(1200) if k % 4], [scores[k] for k in range(0, 1200, 4)]
    assert np.mean([b > g for g in good for b in bad]) > 0.95


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy_where_rows_lie(spark, kind, monkeypatch):
    """All labelled rows of the tables, dealt as many rows would be, are learned from about as well."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    module, folds, held = (quality, 5, 0) if kind == "quality" else (toxicity, 4, 2)
    monkeypatch.setattr(module, "TRAIN_ROWS", 600)
    if kind == "quality":
        monkeypatch.setattr(quality.fit_rows, "__defaults__", (40, *quality.fit_rows.__defaults__[1:]))
    model = module.train(docs, labels)
    scores = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    rows = [(scores[r.doc_id], r[kind]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % folds == held]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print(kind, auc)
    assert auc > (0.99 if kind == "quality" else 0.93)


def test_counts_give_the_thresholds_of_rows():
    rng = np.random.default_rng(5)
    scores = np.rint(rng.random(500) * 50) / 50
    y = (scores + rng.normal(0, 0.3, 500) > 0.6).astype(float)
    cells, at = np.unique(scores, return_inverse=True)
    by_count = toxicity.calibrate(cells, np.bincount(at, y), ["en"] * len(cells), counts=np.bincount(at).astype(float))
    assert by_count == toxicity.calibrate(scores, y, ["en"] * 500)
