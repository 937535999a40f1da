import random

from paperloom.llm import token_counts as tc

WORDS = ["foo", "Bar's", " ", "  ", "\n", "\n\n  ", "x1", "12", "...", "日本", "🙂", "é", "　", "it's", "don't", "'s", " a"]


def test_trees_follow_edits_exactly():
    counter = tc.Counter(*tc.load_ranks())
    rng = random.Random(3)
    for size in (0, 1, 5, 300, 2500):
        text = "".join(rng.choice(WORDS) for _ in range(size))
        tree = tc.build(counter, text)
        assert tree.tokens[1] == len(counter.encoding.encode_ordinary(text))
        for _ in range(60):
            start = rng.randint(0, len(text) + 2)
            removed, inserted = rng.choice([0, 0, 1, 2, 7, 60, 700]), "".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 40])))
            want = text[:start] + inserted + text[start + removed :]
            tree, text, work = tc.edit(counter, tree, text, start, removed, inserted)
            assert text == want
            assert tree.tokens[1] == len(counter.encoding.encode_ordinary(text))
            assert tree.chars[1] == len(text)
            half = len(tree.chars) // 2
            assert all(tree.tokens[k] == tree.tokens[2 * k] + tree.tokens[2 * k + 1] for k in range(1, half))


def test_edits_reencode_only_near_the_edit():
    counter = tc.Counter(*tc.load_ranks())
    text = "some words of a text " * 5000
    tree, _, work = tc.edit(counter, tc.build(counter, text), text, 50_000, 3, "new")
    assert work < 1000


def test_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "one two three", "x"), (2, None, "y"), (2, "", "z"), (None, "four", "w")], "doc_id long, text string, n_tokens string")
    trees = tc.build_trees(docs)
    edits = spark.createDataFrame([(1, 2, 0, 0, "zero "), (1, 1, 3, 4, ""), (None, 1, 0, 4, "five six"), (9, 1, 0, 0, "none")], "doc_id long, seq int, start int, removed int, inserted string")
    got = {(r.doc_id, r.text, r.n_tokens_before): r.n_tokens for r in tc.apply_edits(tc.gather_edits(trees, edits)).collect()}
    counter = tc.Counter(*tc.load_ranks())
    assert set(got) == {(1, "zero one three", 3), (2, "", 0), (None, "five six", 1)}
    assert all(n == len(counter.encoding.encode_ordinary(k[1])) for k, n in got.items())
    assert tc.build_trees(docs.where(F.lit(False))).count() == 0
