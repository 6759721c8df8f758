"""Rounds of contraction hand on what changed, not all edges."""

from __future__ import annotations

from reachgrid.operators import contract
from tests.test_contraction import EDGES, NODES, one_by_one


def test_rounds_write_no_edges_anew(spark, monkeypatch):
    """A street of parallel edges takes several rounds; all edges are written once."""
    seen = []
    real = contract.written
    monkeypatch.setattr(contract, "written", lambda df, name: (seen.append(name), real(df, name))[1])
    rows = [(a, b, 10 * a + c, c, 7, 0, 3) for i in range(9) for a, b in ((i, i + 1), (i + 1, i)) for c in (1, 2)]
    nodes = spark.createDataFrame([("r", i, 1000 + i, 0, 0, 16 if i in (0, 9) else 0) for i in range(10)], NODES)
    alive, edges = contract.merged_graph(nodes, spark.createDataFrame(rows, EDGES))
    gone, want = one_by_one(rows, (0, 9))
    got = contract.least_edges(edges).select("source_index", "target_index", "cost_seconds", "flags", "mode_mask", "maxspeed_kph", "road_class_id")
    assert {r["node_index"] for r in alive.collect()} == set(range(10)) - gone and sorted(tuple(r) for r in got.collect()) == want
    assert seen.count("plan") > 2 and seen.count("contracting") == 1
