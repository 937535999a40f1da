"""A text's pooled values are the largest responses of all its windows, whatever stands beside it in the batch."""

import numpy as np
import pytest

from paperloom.llm import toxicity

TEXTS = [b"u v", b"a b u u", b"", b"u", b"a", b"u v w x", b"b a a", b"u u a", b"u"]


def network(bias):
    rng = np.random.default_rng(7)
    known = np.unique(toxicity.word_ids([b"a b"])[0])
    n = len(known)
    return toxicity.Network(known, rng.normal(size=(n, toxicity.SIZE)).astype(np.float32), [rng.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                            [np.full(toxicity.FILTERS, bias, np.float32) for _ in toxicity.WIDTHS], np.ones(len(toxicity.WIDTHS) * toxicity.FILTERS, np.float32), 0.0, {"": 0.3})


@pytest.mark.parametrize("bias", [0.2, -0.2])
def test_all_windows_of_each_text(bias):
    net = network(bias)
    slot, table = net.tables()
    ids, ends = toxicity.word_ids(TEXTS)
    best, where = net.pooled(slot[ids], ends, table)
    emb = np.zeros((toxicity.BUCKETS, toxicity.SIZE), np.float32)
    emb[net.known] = net.rows
    start = 0
    for d, end in enumerate(ends.tolist()):
        for k, w in enumerate(toxicity.WIDTHS):
            own = slice(k * toxicity.FILTERS, (k + 1) * toxicity.FILTERS)
            want = np.zeros(toxicity.FILTERS, np.float32)
            for s in range(start, end):
                want = np.maximum(want, net.bias[k] + sum(emb[ids[s + p]] @ net.kernels[k][p] for p in range(w) if s + p < end))
            assert best[d, own] == pytest.approx(want, abs=1e-5)
            at = where[d, own]
            assert ((at == -1) == (want == 0)).all() and ((at == -1) | ((at >= start) & (at < end))).all()
        start = end


@pytest.mark.parametrize("bias", [0.2, -0.2])
def test_scores_do_not_depend_on_neighbours(bias):
    net = network(bias)
    slot, table = net.tables()
    ids, ends = toxicity.word_ids(TEXTS)
    together = net.score(slot[ids], ends, table)
    for d, t in enumerate(TEXTS):
        ids, ends = toxicity.word_ids([t])
        assert net.score(slot[ids], ends, table)[0] == pytest.approx(together[d], abs=1e-6)
    assert together[3] == together[8]
