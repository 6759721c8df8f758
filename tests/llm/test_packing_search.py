"""What the search for a plan holds in the driver, and that it finds the same plan whatever it keeps."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import pytest

from reachgrid.llm import packing


def test_search_holds_little_at_any_depth():
    """300 fillings looked at, most of them one below the other: steps far back keep their choice only."""
    r = random.Random(5)
    counts = Counter(r.randint(200, 1200) for _ in range(3000))
    tracemalloc.start()
    packing.plan(dict(counts), 2048, max_nodes=300)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10e6


@pytest.mark.parametrize("seed", range(40))
def test_options_are_found_again(monkeypatch, seed):
    r = random.Random(seed)
    room = r.choice([20, 50, 100, 300])
    counts = Counter(r.randint(room // r.choice([4, 5, 10]), room * r.choice([5, 8, 10]) // 10) for _ in range(r.choice([8, 14, 40])))
    monkeypatch.setattr(packing, "_ALIVE", 10**6)
    whole = packing.plan(dict(counts), room, 400)
    monkeypatch.setattr(packing, "_ALIVE", 1)
    assert packing.plan(dict(counts), room, 400) == whole
