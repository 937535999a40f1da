"""The queries against their SQL, and operators on one text of several megabytes among small ones."""

import numpy as np
import pytest
from brute import near_components

from oracle import compare, duck
from paperloom.llm import minhash, queries, token_counts, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLE[name]) is None


def long_rows():
    words = " ".join(f"w{k * 7919 % 10007} x{k % 13}" for k in range(250_000))
    return [(1, words), (2, words + " and one more"), (3, "short text of some few words"), (4, None), (5, "")]


def test_long_texts(spark):
    rows = long_rows()
    assert len(rows[0][1]) > 2_000_000
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(frame).collect()} == near_components(rows)
    counts = {r.doc_id: r.n_tokens for r in token_counts.build_trees(frame).select("doc_id", "n_tokens").collect()}
    assert counts[2] > counts[1] > 500_000 and counts[4] == counts[5] == 0


def test_thresholds_by_language():
    """Each language's threshold parts its labels; small or one-sided languages take that of all rows."""
    rng = np.random.default_rng(3)
    y = np.tile([0, 1], 100)
    low, high = np.where(y == 1, 0.4, 0.1), np.where(y == 1, 0.9, 0.6)
    scores = np.concatenate([low, high, [0.5] * 10, rng.random(40)])
    labels = np.concatenate([y, y, [0, 1] * 5, np.ones(40)])
    langs = ["a"] * 200 + ["b"] * 200 + ["few"] * 10 + ["one"] * 40
    got = toxicity.calibrate(scores, labels, langs)
    assert 0.1 < got["a"] < 0.4 and 0.6 < got["b"] < 0.9 and got["few"] == got["one"] == got[""]
    assert toxicity.calibrate(np.zeros(0), np.zeros(0), []) == {"": toxicity.THRESHOLD}
    best = max(np.unique(scores), key=lambda t: 2 * labels[scores >= t].sum() / ((scores >= t).sum() + labels.sum()))
    assert abs(2 * labels[scores >= got[""]].sum() / ((scores >= got[""]).sum() + labels.sum()) - 2 * labels[scores >= best].sum() / ((scores >= best).sum() + labels.sum())) < 1e-12
