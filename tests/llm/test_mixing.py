from collections import Counter, defaultdict

import pytest

from paperloom.llm import mixing


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing again and again what full sources cannot take."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        extra = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += extra[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


ROWS = [(k, " ".join(["w"] * (k * 7 % 23)), ["a", "b", "c", None, "hot", "hot", "hot"][k % 7]) for k in range(400)] + [(900, None, "a"), (901, "", "zero"), (901, "", "zero"), (5, "w w", "a"), (5, "w w", "a")]


@pytest.mark.parametrize("slice_rows", [5, 4096])
def test_plan(spark, slice_rows):
    frame = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, size int")
    plan = [r.asDict() for r in mixing.mix_plan(frame, rows_per_slice=slice_rows).collect()]
    assert len(plan) == len(ROWS)
    sizes = defaultdict(int)
    for _, text, source in ROWS:
        sizes[source] += len((text or "").split())
    want = water_fill(sizes)
    taken = defaultdict(int)
    for r in plan:
        source = None if r["sk"] == "1" else r["sk"][1:]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = Counter((r.id, r.size, r.taken) for r in mixing.mix_plan(frame.repartition(3), rows_per_slice=slice_rows).collect())
    assert again == Counter((r["id"], r["size"], r["taken"]) for r in plan)
    mixed = mixing.mix(frame, rows_per_slice=slice_rows)
    assert mixed.columns == frame.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(frame).count() == 0 and mixing.mix(frame).count() == 0
