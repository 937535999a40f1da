import random

import pytest
from brute import near_components

from paperloom.llm import minhash


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(140)]
    rows = []
    for _ in range(260):  # a family whose members are near to some of the others only
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    for _ in range(200):  # one passage in documents that are not alike
        own = [word() for _ in range(rng.choice([10, 40, 90]))]
        rows.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    rows += [" ".join(word() for _ in range(80)) for _ in range(60)]
    rows += [None, "", " \n\t", "one", "ONE", "one two three", "x " * 3000, "X\t" * 3000, "a b c d e", "a b c d e f"]
    rows += rows[:20]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2048, 100])
def test_all_links_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "LIST_BLOCK", block)
    rows = corpus()
    frame = spark.createDataFrame([(k, t, "id", 1) for k, t in rows], "doc_id long, text string, cid string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(frame).collect()}
    assert got == near_components(rows)


def test_work_on_one_group_follows_its_size(spark, monkeypatch):
    """A group of near copies that grows tenfold goes through about ten times as many rows of pieces, with the same
    links as brute force."""
    monkeypatch.setattr(minhash, "LIST_BLOCK", 100)
    counts = {}

    def counting(name):
        real = getattr(minhash, name)

        def run(*args):
            out = real(*args)
            counts[name] = out.count() if out is not None else 0
            return out

        monkeypatch.setattr(minhash, name, run)

    counting("_first_pieces")
    counting("_second_pieces")
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    made = {}
    for size in (150, 1500):
        rows = []
        for k in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            rows.append((k, " ".join(copy)))
        counts.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == near_components(rows)
        made[size] = sum(counts.values())
    assert made[1500] <= 15 * made[150] and made[1500] <= 40 * 1500


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert minhash.near_groups(spark.createDataFrame([], schema)).count() == 0
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A B C D E F"), (2, None), (None, None)], schema)
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_groups(frame).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True)]
    left = minhash.drop_near_copies(frame.selectExpr("doc_id", "text", "1 AS kept", "2 AS rid"))
    assert {(r.doc_id, r.text) for r in left.collect()} >= {(1, "a b c d e f"), (2, None)}
