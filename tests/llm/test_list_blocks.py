"""Probes of a list that skip blocks, against a look at every pair."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import set_join


@pytest.mark.parametrize("n, comps", [(1, 1), (2, 2), (63, 9), (400, 3), (1500, 1200)])
def test_skips_lose_no_pair(n, comps):
    rng = np.random.default_rng(n)
    sim = Fraction(85, 100)
    size = np.sort(rng.integers(5, 400, n))
    reach = size - rng.integers(0, np.maximum(size // 5, 1))
    comp = rng.integers(-comps, 0, n)
    shared = np.where(rng.random(n) < 0.5, -1, rng.integers(0, size + 1))
    key = rng.permutation(n) - n // 2
    table = pa.table({"key": key, "size": size, "reach": reach, "component": comp, "shared": shared})
    got = set_join._across(sim)(table).to_pylist()
    want = set()
    for i in range(n):
        for j in range(i):
            both = -(-int(size[i] + size[j]) * 85 // 185)
            most = min(reach[i], reach[j])
            if shared[i] >= 0 and shared[j] >= 0:
                most = min(most, min(shared[i], shared[j]) + min(size[i] - shared[i], size[j] - shared[j]))
            near = 100 * size[i] >= 85 * size[j] and 100 * size[j] >= 85 * size[i]
            if comp[i] != comp[j] and near and most >= both:
                want.add((int(min(key[i], key[j])), int(max(key[i], key[j]))))
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    blocks = set_join.Blocks(size, reach, comp, sim)
    read = sum(len(blocks.read(int(s), int(r), int(c))) for s, r, c in zip(size, reach, comp, strict=True))
    assert n < 1000 or read < n * n / 2
