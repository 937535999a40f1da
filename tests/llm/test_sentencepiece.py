import math
from collections import Counter

import sentencepiece

from paperloom.llm import sentencepiece_sampling as sp

TEXTS = ["hello world", "", "a▁b  c\n\nd", "日本語 ñandú 🙂\x00x", "    lead", "x" * 500, " \n", "tab\there\r\n", "▁", "ﷺ ｱ", " end "]


def pieces():
    return sp.load()


def test_round_trip_and_reproducible():
    p = pieces()
    processor = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    ids, ends = sp.sample(p, TEXTS, [str(k) for k in range(len(TEXTS))])
    data, stops = sp.join_pieces(p, ids, ends)
    start = last = 0
    for k, text in enumerate(TEXTS):
        assert bytes(data[start : stops[k]]).decode() == text
        if "▁" not in text:
            assert processor.decode(ids[last : ends[k]].tolist()) == text
        alone, _ = sp.sample(p, [text], [str(k)])
        assert (alone == ids[last : ends[k]]).all()  # a row's pieces depend on no other row
        start, last = stops[k], ends[k]


def test_chances_are_those_of_the_lattice():
    p, alpha, word = pieces(), 2e-4, "other"
    names = {bytes(p.pool[s : s + n]).decode("utf-8", "replace"): k for k, (s, n) in enumerate(zip(p.pool_start, p.pool_size, strict=True)) if k > 258}

    def ways(text):
        if not text:
            yield (), 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in names:
                for rest, score in ways(text[k:]):
                    yield (names[text[:k]], *rest), score + alpha * p.score[names[text[:k]]]

    weights = {ids: math.exp(score) for ids, score in ways(" " + word)}
    n = 40_000
    ids, ends = sp.sample(p, [word] * n, [str(k) for k in range(n)], alpha)
    counts = Counter(tuple(x) for x in (ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)))
    assert set(counts) <= set(weights) and len(counts) > 2
    total = sum(weights.values())
    for way, weight in weights.items():
        want = n * weight / total
        assert abs(counts[way] - want) < 5 * math.sqrt(want + 1)


def test_tables(spark):
    frame = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "y"), (None, "one two", "z"), (2, None, "w")], "doc_id long, text string, ids string")
    out = sp.decode(sp.encode(frame)).collect()
    assert all(r.decoded == r.text for r in out) and len(out) == 4
    first, second = [r.ids for r in out if r.doc_id == 1]
    assert first == second
    assert [r.ids for r in out if r.doc_id == 2] == [[]]
    assert sp.decode(sp.encode(frame.where("doc_id > 5"))).count() == 0


def test_odd_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "`doc id` long, text string")
    encoded = sp.encode(docs, id_col="doc id").selectExpr("*", "7 AS decoded")
    back = sp.decode(encoded)
    assert back.columns == ["doc id", "text", "ids", "decoded"] and sorted(r.decoded for r in back.select("decoded").collect()) == ["", "some text"]
