"""Fields over cells against a plain search, whatever the cells."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reachgrid.operators import overlay, routing

SCHEMA = "edge_index long, source_index long, target_index long, cost_seconds long, mode_mask int, maxspeed_kph int, road_class_id int"
SIDE = 14


def grid(seed: int) -> list[tuple]:
    """Streets of a grid, some of one direction or closed to cars, with parallel edges, loops, shortcuts and an island."""
    r = random.Random(seed)
    rows = []
    for y in range(SIDE):
        for x in range(SIDE):
            at = y * SIDE + x
            for to in ([at + 1] if x + 1 < SIDE else []) + ([at + SIDE] if y + 1 < SIDE else []):
                for a, b in ((at, to), (to, at)):
                    if r.random() < 0.85:
                        rows.append((a, b, r.randint(1, 90), r.choice([1, 5, 7]), r.choice([0, 30, 50]), r.choice([5, 15])))
    rows += [(3, 3, 4, 1, 5, 5), (0, SIDE * SIDE - 1, 400, 4, 90, 15), (1, 2, 200, 7, 30, 5), (900, 901, 5, 1, 5, 5), (901, 900, 5, 1, 5, 5)]
    return [(i, *row) for i, row in enumerate(rows)]


def plain(edges: list[tuple], sources: list[int], limit: float | None) -> dict:
    """Least ticks by a search from each source over (source, target, ticks)."""
    out = defaultdict(list)
    for a, b, t in edges:
        out[a].append((b, t))
    times = {}
    for s in sources:
        held, heap = {s: 0}, [(0, s)]
        while heap:
            t, at = heapq.heappop(heap)
            for to, step in out[at] if t == held[at] else ():
                if (limit is None or t + step <= limit) and t + step < held.get(to, 1 << 60):
                    held[to] = t + step
                    heapq.heappush(heap, (t + step, to))
        times |= {(s, n): t for n, t in held.items()}
    return times


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(grid(3), SCHEMA).cache()


@pytest.fixture(scope="module")
def nodes(spark):
    at = [(i, 100 * (i % SIDE), 100 * (i // SIDE)) for i in range(SIDE * SIDE)] + [(900, 5000, 5000), (901, 5000, 5100), (950, 1, 1)]
    return spark.createDataFrame(at, "node_index long, x_m long, y_m long").cache()


@pytest.mark.parametrize(("per_cell", "limit"), [(9, None), (9, 150), (40, 400), (1000, None), (None, None)])
def test_fields_by_plain_search(spark, edges, nodes, per_cell, limit):
    cells = None if per_cell is None else overlay.ground_cells(nodes, per_cell)
    sources = [0, 77, 195, 900, 950]
    starts = spark.createDataFrame([(s,) for s in sources], "source_id long")
    got = defaultdict(dict)
    for r in routing.travel_time_fields(edges, starts, [1, 4], limit, cells=cells).collect():
        assert (r["source_id"], r["node_index"]) not in got[r["mode_mask"]]
        got[r["mode_mask"]][r["source_id"], r["node_index"]] = r["ticks"]
    for mask in (1, 4):
        own = [(r["source_index"], r["target_index"], r["ticks"]) for r in routing.mode_edges(edges, mask).collect()]
        assert got[mask] == plain(own, sources, None if limit is None else limit * 1000)


def test_reach_by_plain_search(spark, edges, nodes):
    own = [(r["source_index"], r["target_index"], 0) for r in edges.collect()]
    sources = [5, 901, 950]
    starts = spark.createDataFrame([(s,) for s in sources], "source_id long")
    for cells in (overlay.ground_cells(nodes, 12), None):
        got = [tuple(r) for r in routing.reachable_from(edges, starts, cells=cells).collect()]
        assert len(got) == len(set(got)) and set(got) == set(plain(own, sources, None))


def test_many_sources_are_dealt_into_buckets(spark, edges, nodes, monkeypatch):
    monkeypatch.setattr(overlay, "PER_BUCKET", 3)
    monkeypatch.setattr(overlay, "_BLOCK", 2)
    sources = list(range(0, 40))
    starts = spark.createDataFrame([(s,) for s in sources], "source_id long")
    rows = routing.travel_time_fields(edges, starts, [1], 300, cells=overlay.ground_cells(nodes, 30)).collect()
    own = [(r["source_index"], r["target_index"], r["ticks"]) for r in routing.mode_edges(edges, 1).collect()]
    assert {(r["source_id"], r["node_index"]): r["ticks"] for r in rows} == plain(own, sources, 300_000)


def test_rounds_go_with_cells_not_hops(spark, monkeypatch):
    """A street of 600 nodes in six cells takes as many rounds as cells are crossed."""
    rows = [(i, i, i + 1, 10, 1, 5, 5) for i in range(600)]
    nodes = spark.createDataFrame([(i, 10 * i, 0) for i in range(601)], "node_index long, x_m long, y_m long")
    starts = spark.createDataFrame([(0,)], "source_id long")
    field = routing.travel_time_fields(spark.createDataFrame(rows, SCHEMA), starts, [1], max_rounds=8, cells=overlay.ground_cells(nodes, 100))
    assert field.agg(F.max("ticks"), F.count("*")).first()[:] == (6_000_000, 601)


def test_empty_tables(spark, edges, nodes):
    none = spark.createDataFrame([], "source_id long")
    assert routing.travel_time_fields(edges, none, [1], cells=overlay.ground_cells(nodes, 50)).collect() == []
    one = spark.createDataFrame([(7,)], "source_id long")
    assert [r["node_index"] for r in routing.travel_time_fields(edges.limit(0), one, [1]).collect()] == [7]


def test_cells_lie_together(spark, nodes):
    rows = overlay.ground_cells(nodes.where("node_index < 900"), 49).join(nodes, "node_index").groupBy("cell").agg(F.count("*").alias("n"), (F.max("x_m") - F.min("x_m") + F.max("y_m") - F.min("y_m")).alias("span"))
    assert all(r["n"] <= 49 and r["span"] <= 2600 for r in rows.collect()) and rows.agg(F.avg("span")).first()[0] < 2000
