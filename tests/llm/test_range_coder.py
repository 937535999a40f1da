import numpy as np
import pytest

from paperloom.llm import range_coder as rc


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 700, 5000, 60_000])
@pytest.mark.parametrize("kind", ["random", "same", "text"])
def test_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"random": lambda: rng.integers(0, 49408, n), "same": lambda: np.full(n, 49407), "text": lambda: np.minimum(49407, rng.zipf(1.3, n)) // 3}[kind]()
    block = rc.pack(ids, [5, None], np.array([n, 0]), 49408)
    got, names, counts = rc.unpack(block)
    assert (got == ids).all() and names == [5, None] and counts.tolist() == [n, 0]
    if kind == "same" and n > 5000:
        assert len(block) < n / 10


def test_damage_is_found():
    block = bytearray(rc.pack(np.arange(3000) % 7, [1], np.array([3000]), 50))
    block[len(block) // 2] ^= 4
    with pytest.raises(ValueError):
        rc.unpack(bytes(block))
    with pytest.raises(ValueError):
        rc.pack(np.array([50]), [1], np.array([1]), 50)
