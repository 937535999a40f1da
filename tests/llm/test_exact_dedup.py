import hashlib
import re

from paperloom.llm import exact_dedup


def brute(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for doc, text in rows:
        groups.setdefault(body(text), []).append((-len(text or ""), doc is None, doc))
    out = []
    for doc, text in rows:
        own = groups[body(text)]
        keep = min(own, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((doc, keep, len(own), doc == keep, hashlib.sha256(body(text).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb "), (4, "a\xa0b"), (5, None), (6, ""), (7, " \n"), (8, "x" * 200_000), (9, "x" * 200_000 + " "), (10, "🙂 é"), (11, "🙂é"), (None, "ab"), (12, "only"), (12, "only")]


def test_groups(spark):
    frame = spark.createDataFrame([(d, t, "h", 5) for d, t in ROWS], "doc_id long, text string, h string, points int")
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(frame).collect()), key=str)
    assert got == brute(ROWS)
    left = exact_dedup.drop_exact_copies(frame)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 7, 9, 10, 12]
    assert exact_dedup.exact_groups(frame.where("doc_id > 50")).count() == 0


def test_hash_clashes_are_split_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.md5
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: real(F.left(F.col(c) if isinstance(c, str) else c, F.lit(1))))
    rows = [(1, "ab"), (2, "a b"), (3, "ac"), (4, "b"), (5, "bb"), (6, "bb ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(frame).collect()), key=str)
    assert got == brute(rows)
