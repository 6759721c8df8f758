"""Nearest nodes by the pyramid against all distances."""

from __future__ import annotations

import random

import pytest

from reachgrid.operators import routing


def plain(points, nodes):
    return {p: min(((x - a) ** 2 + (y - b) ** 2, i) for i, a, b in nodes)[1] for p, x, y in points}


def clustered(r):
    """A town, a denser village, 300 nodes at one place, a long row, and lone ones far off."""
    at = [(r.gauss(0, 50), r.gauss(0, 50)) for _ in range(300)] + [(9000 + r.random(), 9000 + r.random()) for _ in range(400)] + [(700.0, 700.0)] * 300
    at += [(-5000.0 + 3 * i, 100.0) for i in range(200)] + [(1e5, -1e5), (-3e5, 2e5)]
    return [(i, x, y) for i, (x, y) in enumerate(at)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_and_far_points(spark, seed, monkeypatch):
    r = random.Random(seed)
    nodes = clustered(r)
    points = [(i, r.uniform(-4e5, 4e5), r.uniform(-4e5, 4e5)) for i in range(60)] + [(100 + i, r.gauss(0, 80), r.gauss(0, 80)) for i in range(60)]
    points += [(200 + i, 9000 + r.random(), 9000 + r.random()) for i in range(40)] + [(300, 700.0, 700.0), (301, 1e7, 1e7), (302, 4500.0, 4500.0)]
    frame = spark.createDataFrame(points, "point_id long, x double, y double")
    places = spark.createDataFrame(nodes, "node_index long, x double, y double")
    if seed == 2:
        monkeypatch.setattr(routing, "SMALL_FRONT", 3)  # levels are joined by shuffle
    rows = routing.nearest_nodes(frame, places).collect()
    assert len(rows) == len(points) and {r["point_id"]: r["node_index"] for r in rows} == plain(points, nodes)


def test_ties_and_whole_numbers(spark):
    nodes = [(i, x, y) for i, (x, y) in enumerate((a * 10, b * 10) for a in range(12) for b in range(12))]
    points = [(i, x, y) for i, (x, y) in enumerate((a * 5, b * 5) for a in range(-2, 27) for b in range(-2, 27))]
    rows = routing.nearest_nodes(spark.createDataFrame(points, "point_id long, x long, y long"), spark.createDataFrame(nodes[::-1], "node_index long, x long, y long")).collect()
    assert {r["point_id"]: r["node_index"] for r in rows} == plain(points, nodes)


def test_edge_cases(spark):
    one = spark.createDataFrame([(5, 3.0, 4.0), (4, None, 1.0)], "node_index long, x double, y double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 0.0), (3, 3.0, 4.0)], "point_id long, x double, y double")
    assert {(r["point_id"], r["node_index"], r["distance_m"]) for r in routing.nearest_nodes(points, one).collect()} == {(1, 5, 5.0), (3, 5, 0.0)}
    assert routing.nearest_nodes(points, one.limit(0)).collect() == [] and routing.nearest_nodes(points.limit(0), one).collect() == []
    some = spark.createDataFrame([(9,)], "node_index long")
    assert {r["node_index"] for r in routing.nearest_nodes(points, one, some).collect()} == {5}
