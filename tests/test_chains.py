"""Chains merged within blocks of edges, against one node at a time."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachgrid.jobs import road_queries
from reachgrid.operators import chains, contract
from tests.test_contraction import EDGES, one_by_one, street

NAMES = ["source_index", "target_index", "cost_seconds", "flags", "mode_mask", "maxspeed_kph", "road_class_id"]


def walked(rows, free, limit=65_535):
    edges = {c: np.array(v, dtype=np.int64) for c, v in zip(NAMES, zip(*rows))}
    left = chains.walked(edges, np.array(sorted(free)), limit)
    return sorted(zip(*[left[c].tolist() for c in NAMES]))


def test_a_block_merges_chains_and_leaves_the_rest():
    street_0_3 = [(0, 1, 5, 0, 7, 30, 3), (1, 0, 6, 1, 7, 0, 3), (1, 2, 5, 2, 3, 20, 3), (2, 1, 6, 0, 1, 0, 4), (2, 3, 5, 0, 7, 0, 3), (3, 2, 6, 0, 7, 0, 3)]
    assert walked(street_0_3, [1, 2]) == [(0, 3, 15, 2, 3, 20, 3), (3, 0, 18, 1, 1, 0, 0)]
    assert walked([*street_0_3, (1, 1, 1, 0, 7, 0, 3)], [1, 2]) == [(0, 3, 15, 2, 3, 20, 3), (3, 0, 18, 1, 1, 0, 0)]  # a loop goes with its node
    assert walked(street_0_3, [2]) == sorted([*street_0_3[:2], (1, 3, 10, 2, 3, 20, 3), (3, 1, 12, 0, 1, 0, 0)])
    assert walked(street_0_3, [1, 2], limit=17) == sorted(street_0_3)  # the dearer direction costs 18
    one_way = [r for r in street_0_3 if r[0] < r[1]]
    assert walked(one_way, [1, 2]) == [(0, 3, 15, 2, 3, 20, 3)]
    for rest in (
        [(0, 1, 5, 0, 7, 0, 3), (1, 0, 5, 0, 7, 0, 3)],  # a dead end
        [(0, 1, 5, 0, 7, 0, 3), (1, 2, 5, 0, 7, 0, 3), (2, 0, 5, 0, 7, 0, 3)],  # a ring
        [(0, 1, 5, 0, 1, 0, 3), (1, 2, 5, 0, 2, 0, 3)],  # no mode goes all along
        [(0, 1, 5, 0, 7, 0, 3), (1, 2, 5, 0, 7, 0, 3), (1, 2, 9, 1, 7, 0, 3)],  # parallel edges
        [(0, 1, 5, 0, 7, 0, 3), (2, 1, 5, 0, 7, 0, 3)],  # nothing goes out
    ):
        assert walked(rest, [1, 2] if len(rest) == 3 and rest[-1][1] == 0 else [1]) == sorted(rest)


@pytest.mark.parametrize("block", (5, 1_000))
def test_blocks_of_streets_give_what_single_merges_give(spark, monkeypatch, block):
    """Streets between six crossings, their edges in order, in several tasks and blocks that cut through them, and shuffled."""
    r, rows, free = random.Random(block), [], 6
    for a in range(6):
        for b in range(a + 1, 6):
            n = r.choice([0, 1, 2, 5, 17, 30])
            rows += street(r, [a, *range(free, free + n), b], r.random() < 0.7)
            free += n
    monkeypatch.setattr(chains, "BLOCK", block)
    protected = spark.createDataFrame([(i,) for i in range(6)], "node long")
    gone, want = one_by_one(rows, range(6))
    for given, free_of in ((rows, lambda c: F.col(c) >= 6), (r.sample(rows, len(rows)), None)):
        _, left = contract.merged_edges(protected, spark.createDataFrame(given, EDGES), blocks=True, free=free_of)
        assert sorted(tuple(e) for e in contract.least_edges(left).select(*NAMES).collect()) == want


def test_contracted_queries_merge_in_blocks(spark, tmp_path, monkeypatch):
    """All shape nodes go in their blocks: no table of hops, ranks or shape nodes, which took most of the disk."""
    seen = []
    for module in (contract, chains, road_queries):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name, *size, real=real: (seen.append(name), real(df, name, *size))[1])
    lines = [(o, n, (7 * o + n) % 100, o + n, 1.0) for o in range(0, 60, 2) for n in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, 3 * o + 1) for o in range(60)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p, p % 50) for p in range(100)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    one = road_queries.contracted_edges(spark, str(tmp_path))
    got = {(r["source_id"], r["target_id"]) for r in one.collect()}
    assert got and all(a >= 0 and b >= 0 for a, b in got) and sorted(seen) == ["candidates", "contracting", "edge-blocks", "kept-lists", "kept-nodes"]
    plain = road_queries._edges(spark, str(tmp_path)).select("source_index", "target_index").distinct().collect()
    assert got == {tuple(r) for r in plain}
