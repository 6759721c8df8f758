"""Work that must not grow faster than the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reachgrid.operators import adjacency, overlay, routing
from reachgrid.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_sorted_once(spark, tmp_path):
    """Places and nodes of a way's lines come from one window; a start without a part counts as 0 further on."""
    lines = [(1, 2, 9, 2, 1.0), (1, 1, 5, 1, 1.0), (1, 3, 9, 3, 1.0), (2, 1, None, 2, 1.0), (2, 2, 9, 2, 1.0), (2, 3, 9, None, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    refs = tables.grid_refs(spark, str(tmp_path))
    assert sorted(tuple(r) for r in refs.collect()) == [(1, 0, 5), (1, 1, 6), (1, 2, 16), (2, 0, None), (2, 1, 1), (2, 2, 11)]
    assert plan(refs).count("Window [") == 1


def test_tags_are_read_once_per_way(spark):
    """Speeds by direction replace the general one, and lists are matched part by part."""
    rows = [(1, {"maxspeed": "none;30 MPH ", "maxspeed:forward": "bad"}), (2, {"maxspeed": "50;70", "maxspeed:backward": "walk"}), (3, {"access": " No ", "bicycle": "yes"}), (4, {})]
    ways = spark.createDataFrame([(i, "service", c) for i, c in rows], "way_id long, highway string, constraints map<string,string>")
    made = adjacency.way_attributes(ways)
    got = {r["way_id"]: (r["mode_mask"], r["forward_kph"], r["backward_kph"], r["disallowed"]) for r in made.collect()}
    assert got == {1: (7, 20, 20, False), 2: (7, 50, 5, False), 3: (2, 16, 16, True), 4: (7, 20, 20, False)}
    # Each of the three speed tags is matched in one place of the plan.
    assert plan(made.select(F.col("forward_kph"), F.col("backward_kph"), F.col("mode_mask"))).count("regexp_extract") <= 6


def test_times_over_the_limit_go_no_further():
    """A street of eight places from two sources; what is over the limit is not worked out."""
    a = np.arange(7)
    known = np.full((8, 2), overlay._FAR, dtype=np.int64)
    known[0, 0] = known[4, 1] = 0
    times = overlay._settled(a, a + 1, np.full(7, 10), known, 30)
    assert times[:4, 0].tolist() == [0, 10, 20, 30] and times[4:, 1].tolist() == [0, 10, 20, 30]
    assert (times[4:, 0] == overlay._FAR).all() and (times[:4, 1] == overlay._FAR).all()


def test_only_cells_that_times_get_to_are_opened(spark, monkeypatch):
    """On a street of ten cells, a limit within the second has two opened, one bucket each, in two rounds and on the way down."""
    rows = [(1, i, i + 1, 10) for i in range(99)]
    nodes = spark.createDataFrame([(i, 10 * i, 0) for i in range(100)], "node_index long, x_m long, y_m long")
    opened, plain = [], overlay._opened

    def counted(seeds, *args, **kwargs):
        opened.append(sorted({r["cell"] for r in seeds.collect()}))
        return plain(seeds, *args, **kwargs)

    monkeypatch.setattr(overlay, "_opened", counted)
    edges = spark.createDataFrame(rows, "mode_mask int, source_index long, target_index long, ticks long")
    starts = spark.createDataFrame([(0, 1)], "source_id long, mode_mask int")
    field = routing._field(edges, starts, 150, 50, overlay.ground_cells(nodes, 10))
    assert field.agg(F.count("*"), F.max("ticks")).first()[:] == (16, 150)
    assert [len(cells) for cells in opened] == [1, 1, 2]


def test_a_known_field_serves_routes(spark):
    """A route follows a field that ends at its goal, and looks for no other."""
    edges = spark.createDataFrame([(0, 1, 5), (1, 2, 5), (0, 2, 11), (2, 3, 5), (1, 1, 1)], "source_index long, target_index long, cost_seconds long")
    nodes = spark.createDataFrame([(i, 100 + i) for i in range(4)], "node_index long, osm_id long")
    costs = routing.route_edges(edges)
    field = routing.route_field(costs, spark.createDataFrame([(0,)], "source_id long"), 10)
    assert sorted((r["node_index"], r["ticks"]) for r in field.collect()) == [(0, 0), (1, 5), (2, 10)]
    got = routing.route(nodes, edges, 100, 102, known=(costs, field)).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, 100, 0), (1, 101, 5), (2, 102, 10)]
