"""Tables that nothing reads any more are deleted."""

from __future__ import annotations

import os

from reachgrid.functions.shared import shared_dir
from reachgrid.operators import contract


def test_rounds_of_ranks_leave_one_table(spark):
    folder = shared_dir(spark).removeprefix("file:")
    held = lambda: {d for d in os.listdir(folder) if d.startswith("chain-links")}
    before = held()
    rows = [(i - 1, i, i + 1, 1) for i in range(1, 5)] + [(i + 1, i, i - 1, 1) for i in range(1, 5)]
    ranks = contract.chain_ranks(spark.createDataFrame(rows, "u long, v long, w long, hop long"))
    assert ranks.count() == 8 and len(held() - before) == 1
