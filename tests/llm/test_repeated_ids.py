"""Ids that are null or repeat: each group and each component leaves one row, whatever its id."""

from collections import Counter

from paperloom.llm import exact_dedup, minhash

SCHEMA = "doc_id long, text string, n int"


def left(spark, drop, rows):
    frame = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], SCHEMA)
    out = drop(frame)
    assert out.columns == frame.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_near_copies(spark):
    a = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A B C D E F"), (2, None), (None, None)]
    assert left(spark, minhash.drop_near_copies, a) == Counter([(1, "a b c d e f"), (2, None), (None, None)])
    b = [(1, "a b c d e f"), (None, "A B C D E F"), (None, None)]
    assert left(spark, minhash.drop_near_copies, b) == Counter([(1, "a b c d e f"), (None, None)])
    c = [(None, "one text of six other words"), (None, "quite another text with its words"), (None, "QUITE another text with its  words"), (3, "first text under the id three"), (3, "second long text under the same id"), (4, "second long text under the same ID")]
    want = [(None, "one text of six other words"), (None, "QUITE another text with its  words"), (3, "first text under the id three"), (3, "second long text under the same id")]
    assert left(spark, minhash.drop_near_copies, c) == Counter(want)


def test_exact_copies(spark):
    rows = [(None, "one"), (None, "o ne"), (None, "two"), (5, "two"), (5, "three"), (6, "th ree"), (5, "four"), (None, None), (None, " "), (7, "x"), (7, "x")]
    want = [(None, "o ne"), (5, "two"), (6, "th ree"), (5, "four"), (None, " "), (7, "x")]
    assert left(spark, exact_dedup.drop_exact_copies, rows) == Counter(want)
