"""Operators of the road network on small fixtures."""

from __future__ import annotations

import gzip
import json
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from reachgrid.functions import costs, geo, tags
from reachgrid.operators import adjacency, boundary, checks, contract, extract, project, raster, routing, series, summary, survey
from reachgrid.sources import binary, elements as source, regions

NODE = "region_id string, seq long, type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>, geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>"
EDGE = "edge_index long, source_index long, target_index long, cost_seconds long, flags int, mode_mask int, maxspeed_kph int, road_class_id int"


def elements(spark, rows):
    full = [("r", i, *r, *[None] * (8 - len(r))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, NODE)


def node(i, lat=52.5, lon=13.4, **t):
    return ("node", i, lat, lon, None, t or None)


def way(i, refs, **t):
    return ("way", i, None, None, refs, {k.replace("__", ":"): v for k, v in t.items()})


def edges_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EDGE)


def built(spark, ways, places):
    rows = elements(spark, [*[node(i) for i in places], *ways])
    placed = spark.createDataFrame([("r", i, x, y) for i, (x, y) in places.items()], "region_id string, node_id long, x_m long, y_m long")
    return adjacency.build_graph(extract.extract(rows, tuple(tags.ROAD_CLASSES)), placed)


def test_extract_drops_incomplete_ways(spark):
    rows = elements(spark, [node(1), node(2), node(3), node(10, highway="crossing"), node(11, barrier="gate", entrance="yes"), way(100, [1, 2, 3], highway="footway", foot="yes", name="x"), way(101, [2, 4], highway="residential"), way(102, [1, 2], highway="motorway")])
    found = extract.extract(rows)
    assert [r["way_id"] for r in found["candidates"].orderBy("way_id").collect()] == [100, 101]
    assert [r["way_id"] for r in found["ways"].collect()] == [100] and found["ways"].first()["constraints"] == {"foot": "yes"}
    assert {r["node_id"] for r in found["nodes"].collect()} == {1, 2, 3}
    assert {r["node_id"]: r["connector_types"] for r in found["connectors"].collect()} == {10: ["crossing"], 11: ["barrier", "entrance"]}
    row = extract.extract_summary(rows).first()
    assert (row["candidate_ways"], row["ways"], row["dropped_ways"], row["nodes"], row["connectors"]) == (2, 1, 1, 3, 2)


def test_surveys(spark):
    rows = elements(spark, [node(1, 52.5, 13.4), node(2, 52.5, 13.405), node(3, 52.5, 13.41), way(1, [1, 2, 3], highway="footway"), way(2, [2, 3], highway="footway"), way(3, [2, 999], highway="residential")])
    assert [tuple(r) for r in survey.highway_counts(rows).collect()] == [("footway", 2), ("residential", 1)]
    d = survey.node_ref_density(rows).first()
    assert d["ways"] == 3 and d["missing_segments"] == 1 and 3.0 <= d["refs_per_km"] * 1.0 <= 7.1
    line = [{"lat": 52.5, "lon": 13.4 + i * 0.00295} for i in range(6)]
    g = survey.geometry_density(spark.createDataFrame([("r", "way", {"highway": "path"}, line), ("r", "way", {"highway": "path"}, line[:1])], "region_id string, type string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")).first()
    assert g["ways"] == 1 and 5.5 <= g["refs_per_km"] <= 6.5
    ways = spark.createDataFrame([({"foot": "yes", "maxspeed": "50"},), ({"foot": "no", "maxspeed:forward": "30"},)], "constraints map<string,string>")
    got = {r["tag"]: (r["presence"], r["ratio"]) for r in survey.tag_coverage(ways).collect()}
    assert got["foot"] == (2, 1.0) and got["maxspeed"] == (1, 0.5) and got["maxspeed:backward"] == (0, 0.0)
    assert {r["ratio"] for r in survey.tag_coverage(ways.limit(0)).collect()} == {0.0}


# Fixed values of the data model: tags and what follows from them.
@pytest.mark.parametrize(
    ("highway", "c", "mask", "speed", "disallowed"),
    [
        ("footway", {"maxspeed": "30 mph"}, 1, 48, False),
        ("footway", {"maxspeed": "walk"}, 1, 5, False),
        ("residential", {"maxspeed": "50;70"}, 7, 50, False),
        ("residential", {"maxspeed": "50 km/h"}, 7, 50, False),
        ("residential", {}, 7, 30, False),
        ("cycleway", {}, 3, 20, False),
        ("footway", {}, 1, 5, False),
        ("residential", {"foot": "yes", "bicycle": "no", "vehicle": "no", "motor_vehicle": "yes"}, 5, 30, False),
        ("residential", {"access": "no", "foot": "yes"}, 1, 5, False),
        ("residential", {"access": "no", "foot": "yes", "bicycle": "yes", "vehicle": "yes", "motor_vehicle": "no"}, 3, 18, False),
        ("motorway", {}, 4, 110, False),
        ("motorway", {"foot": " YES "}, 5, 110, False),
        ("residential", {"access": "private"}, 0, 0, True),
        ("residential", {"maxspeed": "50", "maxspeed:forward": "bad"}, 7, 30, False),
        ("residential", {"maxspeed": "signals;30"}, 7, 30, False),
    ],
)
def test_tag_rules(spark, highway, c, mask, speed, disallowed):
    row = adjacency.way_attributes(spark.createDataFrame([(highway, c)], "highway string, constraints map<string,string>")).first()
    assert (row["mode_mask"], row["forward_kph"], row["disallowed"]) == (mask, speed, disallowed)


def test_edge_flags_and_directions(spark):
    c = {"oneway": "yes", "oneway:bicycle": "no", "junction": "Roundabout", "maxspeed": "50", "maxspeed:forward": "30", "maxspeed:backward": "20", "sidewalk": "both"}
    row = adjacency.way_attributes(spark.createDataFrame([("primary", c)], "highway string, constraints map<string,string>")).first()
    assert row["flags"] == 1 | 256 | 512 | 1024 | 2048 and (row["forward_kph"], row["backward_kph"]) == (30, 20)


def test_graph_build(spark):
    g = built(spark, [way(1, [1, 2, 3], highway="footway"), way(2, [1, 2], highway="footway", access="private")], {1: (0, 0), 2: (10, 0), 3: (20, 0)})
    nodes = g["nodes"].orderBy("node_index").collect()
    assert [(r["osm_id"], r["first_edge_index"], r["edge_count"]) for r in nodes] == [(1, 0, 1), (2, 1, 2), (3, 3, 1)]
    assert g["edges"].count() == 4 and g["skipped"].first()["skipped"] == 1 and {r["cost_seconds"] for r in g["edges"].collect()} == {7}
    assert set(checks.layout_violations(g["nodes"], g["edges"]).first()) == {0}
    one = built(spark, [way(1, [1, 2], highway="footway", oneway__foot="yes")], {1: (0, 0), 2: (10, 0)})
    assert [(r["source_index"], r["target_index"]) for r in one["edges"].collect()] == [(0, 1)]


def test_long_edges_are_cut(spark):
    g = built(spark, [way(1, [1, 2], highway="footway")], {1: (0, 0), 2: (300_000, 0)})
    nodes, edges = g["nodes"].collect(), g["edges"].collect()
    assert len(nodes) == 8 and len(edges) == 8 and max(r["cost_seconds"] for r in edges) <= 65_535
    assert sorted(r["osm_id"] for r in nodes if r["osm_id"] < 0) == [-6, -5, -4, -3, -2, -1]
    assert routing.reachable_from(g["edges"], spark.createDataFrame([(0,)], "source_id long")).where("node_index = 1").count() == 1


def contracted(spark, rows, protect=()):
    edges = edges_of(spark, [(a, b, c, 0, 1, 5, 1) for a, b, c in rows])
    n = max(max(a, b) for a, b, _ in rows) + 1
    nodes = spark.createDataFrame([("r", i, 10 + i, 0, 0, 16 if 10 + i in protect else 0) for i in range(n)], "region_id string, node_index long, osm_id long, x_m int, y_m int, flags int")
    nodes, edges = contract.contract_chains(nodes, edges)
    return nodes.count(), sorted(r["cost_seconds"] for r in edges.collect())


def test_contraction(spark):
    chain = [(0, 1, 5), (1, 0, 5), (1, 2, 7), (2, 1, 7)]
    assert contracted(spark, chain) == (2, [12, 12])
    assert contracted(spark, chain, {11}) == (3, [5, 5, 7, 7])
    assert contracted(spark, [(0, 1, 6), (1, 2, 7)]) == (2, [13])
    assert contracted(spark, [(0, 1, 40_000), (1, 0, 40_000), (1, 2, 40_000), (2, 1, 40_000)])[0] == 3
    long = [(i, i + 1, 2) for i in range(20)] + [(i + 1, i, 2) for i in range(20)]
    assert contracted(spark, long) == (2, [40, 40])


def test_costs_and_fields(spark):
    edges = edges_of(spark, [(0, 1, 72, 0, 7, 60, 11), (1, 2, 72, 0, 7, 60, 11), (0, 2, 10, 0, 7, 0, 15)])
    of = lambda mask, at=0: edges.where(F.col("edge_index") == at).select(costs.edge_cost_seconds(mask)).first()[0]
    assert of(1) == 72 and of(4) < of(2) < of(1) and of(1, 2) is None and of(2, 2) is None
    assert math.isclose(of(4, 2), 13.9 / (30_000 / 3600))
    cars = routing.mode_edges(edges.where("road_class_id != 15"), 4)
    field = routing.travel_time_field(edges.where("road_class_id != 15"), spark.createDataFrame([(0,)], "source_id long"), 4)
    assert cars.count() == 2 and abs({r["node_index"]: r["seconds"] for r in field.collect()}[2] - 12) < 0.05
    walk = edges_of(spark, [(0, 1, 10, 0, 1, 5, 1), (0, 2, 25, 0, 1, 5, 1), (1, 2, 10, 0, 1, 5, 1)])
    starts = spark.createDataFrame([(0,), (1,)], "source_id long")
    want = {(0, 0, 0), (0, 1, 10_000), (0, 2, 20_000), (1, 1, 0), (1, 2, 10_000)}
    rows = routing.travel_time_fields(walk, starts, [1]).collect()
    assert {(r["source_id"], r["node_index"], r["ticks"]) for r in rows} == want
    cut = routing.travel_time_fields(walk, starts, [1], 10).collect()
    assert {(r["source_id"], r["node_index"]) for r in cut} == {(0, 0), (0, 1), (1, 1), (1, 2)}
    assert routing.travel_time_fields(walk, starts.limit(0), [1]).collect() == []


@pytest.mark.parametrize("small", [0, 100_000])
def test_fields_by_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(routing, "SMALL_FRONT", small)
    monkeypatch.setattr(routing, "MERGE_EVERY", 3)
    r = random.Random(4)
    n = 40
    rows = [(r.randrange(n), r.randrange(n), r.randint(1, 90), 0, r.choice((1, 3, 7)), r.choice((0, 5, 30)), 6) for _ in range(130)] + [(i, i + 1, 5, 0, 1, 5, 6) for i in range(12)]
    edges = edges_of(spark, rows)
    for mask in (1, 6):
        step = {}
        for e in routing.mode_edges(edges, mask).collect():
            key = e["source_index"], e["target_index"]
            step[key] = min(step.get(key, e["ticks"]), e["ticks"])
        want = {}
        for s in (0, 5):
            best = {s: 0}
            for _ in range(n):
                for (a, b), t in step.items():
                    if a in best and best[a] + t < best.get(b, math.inf):
                        best[b] = best[a] + t
            want |= {(s, k): t for k, t in best.items()}
        got = routing.travel_time_fields(edges, spark.createDataFrame([(0,), (5,)], "source_id long"), [mask]).collect()
        assert {(x["source_id"], x["node_index"]): x["ticks"] for x in got} == want and len(got) == len(want)


def test_route(spark):
    nodes = spark.createDataFrame([(i, 100 + i, 0, 0) for i in range(4)], "node_index long, osm_id long, x_m long, y_m long")
    edges = edges_of(spark, [(0, 1, 5, 0, 1, 5, 1), (0, 2, 3, 0, 1, 5, 1), (1, 3, 5, 0, 1, 5, 1), (2, 3, 20, 0, 1, 5, 1)])
    rows = routing.route(nodes, edges, 100, 103).orderBy("pos").collect()
    assert [r["osm_id"] for r in rows] == [100, 101, 103] and rows[-1]["cost_seconds"] == 10
    assert [tuple(r) for r in routing.route(nodes, edges, 100, 100).collect()] == [(0, 100, 0)]
    pairs = spark.createDataFrame([(1, 100, 103), (2, 101, 103), (3, 102, 102)], "pair_id int, start long, goal long")
    assert [(r["pair_id"], r["osm_id"], r["cost_seconds"]) for r in routing.routes(nodes, edges, pairs).orderBy("pair_id", "pos").collect()] == [(1, 100, 0), (1, 101, 5), (1, 103, 10), (2, 101, 0), (2, 103, 5), (3, 102, 0)]
    with pytest.raises(ValueError, match="unknown"):
        routing.route(nodes, edges, 100, 7)
    with pytest.raises(ValueError, match="no way"):
        routing.route(nodes, edges, 103, 100)


def test_nearest_and_landmarks(spark):
    nodes = spark.createDataFrame([(0, 0, 0), (1, 10, 0), (2, 5, 5)], "node_index long, x long, y long")
    points = spark.createDataFrame([(1, 6.0, 4.0), (2, 5000.0, -900.0)], "point_id long, x double, y double")
    got = {r["point_id"]: r for r in routing.nearest_nodes(points, nodes).collect()}
    assert got[1]["node_index"] == 2 and got[1]["distance_m"] < 2 and got[2]["node_index"] == 1
    some = spark.createDataFrame([(0,)], "node_index long")
    assert {r["node_index"] for r in routing.nearest_nodes(points, nodes, some).collect()} == {0}
    edges = edges_of(spark, [(0, 1, 5, 0, 1, 5, 1), (1, 0, 5, 0, 1, 5, 1)])
    marks = spark.createDataFrame([(0, "A", 0), (1, "B", 1), (2, "C", 2)], "rank int, name string, node_index long")
    rows = {r["name"]: r for r in routing.landmark_reachability(edges, marks).collect()}
    assert rows["A"]["unreachable"] == ["C"] and rows["C"]["unreachable"] == ["A", "B"] and not rows["B"]["all_reachable"]


def test_projection(spark):
    df = spark.createDataFrame([("r", 1, 52.52, 13.405), ("r", 2, 52.521, 13.407), ("r", 3, 52.519, 13.41)], "region_id string, node_id long, lat double, lon double")
    rows = project.projected(df, 25833)
    lat, lon = geo.unproject(F.col("easting"), F.col("northing"), 25833)
    for r in rows.select("lat", "lon", lat.alias("a"), lon.alias("b"), "easting").collect():
        assert abs(r["a"] - r["lat"]) < 1e-9 and abs(r["b"] - r["lon"]) < 1e-9 and 390_000 < r["easting"] < 393_000
    extent = project.grid_extent(rows)
    e = extent.first()
    assert e["grid_width_px"] == math.ceil((e["max_easting"] - e["origin_easting"]) / 10)
    assert all(r["x_m"] >= 0 and r["y_m"] >= 0 for r in project.offsets(rows, extent).collect())
    with pytest.raises(ValueError):
        project.grid_extent(rows.limit(0))
    x, y = project.pixel_to_metres(F.lit(0), F.lit(0), (1000.0, 2000.0), 256, 1.0)
    assert tuple(spark.range(1).select(x, y).first()) == (1000.0, 2255.0)
    for code, (lon0, lat0) in {2154: (3.0, 46.5), 32130: (-71.5, 41.0 + 5 / 60)}.items():
        east, north = geo.project(F.lit(lat0), F.lit(lon0), code)
        p = geo.projection(code)
        assert [round(v, 6) for v in spark.range(1).select(east, north).first()] == [p.east, p.north]


def test_raster(spark):
    segments = spark.createDataFrame([(i, 0, 0, 0.0, x, y, 10.0) for i, (x, y) in enumerate([(a, b) for a in range(-7, 8) for b in range(-7, 8)])], "edge_index long, x0 int, y0 int, t0 double, x1 int, y1 int, t1 double")
    got: dict = {}
    for r in raster.rasterize(segments).collect():
        got.setdefault(r["edge_index"], {})[r["step"]] = (r["x_px"], r["y_px"])
    # By definition: one pixel a step of the longer axis, and the whole number nearest to the line, halves away from the start.
    nearest = lambda part, n: math.floor(Fraction(part, max(n, 1)) + Fraction(1, 2))
    for r in segments.collect():
        n, sign = max(abs(r["x1"]), abs(r["y1"])), lambda v: (v > 0) - (v < 0)
        line = {k: tuple(sign(r[c]) * nearest(k * abs(r[c]), n) for c in ("x1", "y1")) for k in range(n + 1)}
        assert got[r["edge_index"]] == line
    shown = lambda s, cycle, theme="dark": tuple(spark.range(1).select(costs.band_rgb(costs.band(F.lit(float(s)), cycle), theme).alias("c")).first()["c"])
    assert shown(0, 60) == shown(3600, 60) == (0, 255, 255) and shown(780, 60) == (64, 255, 64) and shown(0, 60, "light") == (0, 110, 210)
    rows = raster.legend(spark.createDataFrame([(120.0,), (24.0,)], "cycle_minutes double")).orderBy("cycle_minutes", "band").collect()
    assert rows[0]["note"] == "Colours repeat every 24 min." and rows[5]["label"] == "0 min–24 min" and rows[7]["label"] == "48 min–1 h 12 min" and rows[5]["note"].endswith("2 h.")
    german = {"minutes": "{m} Min.", "hours": "{h} Std.", "both": "{h} Std. {m} Min."}
    assert spark.range(1).select(costs.duration_label(F.lit(72.0), german)).first()[0] == "1 Std. 12 Min."
    lines = raster.edge_line_markup(spark.createDataFrame([(0, 1.0, 2.0, -1.0, 3.0, 4.0, -1.0), (1, 1.0, 2.5, 0.0, 10.0, 4.256, 5.0)], "edge_index long, x0 double, y0 double, t0 double, x1 double, y1 double, t1 double"), 60, "light").collect()
    assert len(lines) == 1 and 'x1="1" y1="2.5" x2="10" y2="4.26" stroke="rgb(0, 110, 210)"' in lines[0]["markup"]


def test_visible_segments(spark):
    edges = routing.mode_edges(edges_of(spark, [(0, 1, 10, 0, 1, 5, 1), (1, 2, 10, 0, 1, 5, 1)]), 1)
    pixels = spark.createDataFrame([(0, 0, 0), (1, 5, 0), (2, 9, 0)], "node_index long, x_px int, y_px int")
    field = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 20.0)], "node_index long, seconds double")
    rows = raster.segment_template(field, edges, pixels).orderBy("edge_index").collect()
    assert [(r["t0"], r["t1"]) for r in rows] == [(0, 10), (10, 20)]
    rows = raster.segment_template(field.where("node_index != 1"), edges, pixels).collect()
    assert {(r["t0"], r["t1"]) for r in rows} == {(-1, -1)}


def test_boundaries(spark, tmp_path):
    line = [{"lat": 0.0, "lon": 0.0}, {"lat": 0.01, "lon": 0.5}, {"lat": 0.0, "lon": 1.0}]
    admin = {"boundary": "administrative", "admin_level": "9", "name": "Mitte"}
    member = lambda ref, geometry=None: {"type": "way", "ref": ref, "role": "outer", "geometry": geometry}
    rows = [
        node(1, 0.0, 0.0), node(2, 0.01, 0.5), node(3, 0.0, 1.0), ("way", 7, None, None, [1, 2, 3], None, None), ("way", 8, None, None, [1, 99], None, None),
        ("relation", 100, None, None, None, admin, None, [member(5, line)]), ("relation", 101, None, None, None, admin | {"name": " "}, None, [member(7), member(8)]),
        ("relation", 200, None, None, None, admin | {"admin_level": "10"}, None, [member(5, line)]),
    ]
    paths = boundary.boundary_features(elements(spark, rows), "9")
    got = [(r["relation_id"], r["name"], len(r["points"])) for r in paths.collect()]
    assert got == [(100, "Mitte", 3), (101, "relation_101", 3)] and paths.first()["points"][1]["x"] == 0.5
    assert {len(r["points"]) for r in boundary.simplify_paths(paths, 0.05).collect()} == {2}
    canvas = boundary.boundary_canvas(paths, 0.0, "degrees")
    assert {(r["in_points"], r["out_points"], r["width"]) for r in canvas.collect()} == {(3, 3, 1.0)}
    boundary.write_boundary_json(boundary.canvas_payload(canvas, "degrees"), str(tmp_path / "b"))
    back = boundary.read_boundary_json(spark, str(tmp_path / "b"))
    assert back.count() == 2 and not back.select(boundary.is_closed(F.col("points"))).first()[0]
    for call in (lambda: boundary.simplify_paths(paths, -1.0), lambda: boundary.boundary_canvas(paths.limit(0), 1.0, "degrees"), lambda: boundary.boundary_canvas(paths, 1.0, "feet")):
        with pytest.raises(ValueError):
            call()


def test_packed_graphs(spark, tmp_path):
    g = built(spark, [way(1, [1, 2, 3], highway="tertiary", maxspeed="80")], {1: (0, 0), 2: (10, 0), 3: (20, 0)})
    extent = spark.createDataFrame([("r", 25833, 392000.0, 5820000.0, 10.0, 3, 1)], "region_id string, epsg int, origin_easting double, origin_northing double, pixel_size_m double, grid_width_px int, grid_height_px int")
    made = binary.graph_chunks(g["nodes"], g["edges"], extent, 2)
    assert sorted((r["kind"], r["byte_offset"], len(r["content"])) for r in made.collect()) == [("edges", 112, 24), ("edges", 136, 24), ("head", 0, 64), ("nodes", 64, 32), ("nodes", 96, 16)]
    for name, compress in (("plain", False), ("packed", True)):
        (tmp_path / name).mkdir()
        binary.write_graph_files(made, f"file://{tmp_path}/{name}", ".bin.gz" if compress else ".bin", compress)
    assert gzip.decompress((tmp_path / "packed" / "r.bin.gz").read_bytes()) == (tmp_path / "plain" / "r.bin").read_bytes()
    with pytest.raises(Exception, match="compressed"):
        binary.read_graph_files(spark, f"{tmp_path}/packed/*.gz")
    (tmp_path / "again").mkdir()
    binary.unpack(spark, f"{tmp_path}/packed/*.gz", f"file://{tmp_path}/again")
    for tables in (binary.read_chunks(made), binary.read_graph_files(spark, f"{tmp_path}/plain/*.bin", 2), binary.read_graph_files(spark, f"{tmp_path}/again/*.bin")):
        header, nodes, edges = tables
        h = header.first()
        assert (h["version"], h["node_offset"], h["edge_offset"], h["stop_offset"]) == (2, 64, 64 + 48, 64 + 48 + 48)
        assert sorted(map(tuple, edges.drop("file").collect())) == sorted(map(tuple, g["edges"].drop("region_id").collect()))
        assert nodes.count() == 3
        assert set(checks.stored_graph_violations(header, nodes, edges).drop("file", "bad_header").first()) == {0}
    alone = binary.graph_chunks(g["nodes"].limit(0), g["edges"].limit(0), extent).collect()
    assert [(r["kind"], len(r["content"])) for r in alone] == [("head", 64)]
    assert spark.range(1).select(binary.pack_word(F.lit(7), F.lit(50), F.lit(11))).first()[0] == 3279623
    with pytest.raises(ValueError, match="do not fit"):
        binary.graph_chunks(g["nodes"], g["edges"].limit(3), extent)
    with pytest.raises(Exception, match="do not fit"):
        binary.graph_chunks(g["nodes"], g["edges"].withColumn("source_index", F.lit(0).cast("long")), extent).collect()
    with pytest.raises(Exception, match="numbered"):
        binary.graph_chunks(g["nodes"].withColumn("node_index", F.col("node_index") + 1), g["edges"].withColumn("source_index", F.col("source_index") + 1), extent).collect()
    bad = checks.graph_integrity(g["nodes"], edges_of(spark, [(0, 5, 0, 0, 1, 5, 1)])).first()
    assert tuple(bad) == (1, 1)
    with pytest.raises(ValueError):
        checks.graph_integrity(g["nodes"], edges_of(spark, [(0, 5, 0, 0, 1, 5, 1)]), strict=True)
    assert {r["mode"]: r["ratio"] for r in summary.mode_coverage(g["edges"]).collect()} == {"walk": 1.0, "bike": 1.0, "car": 1.0}


def test_series(spark):
    of = lambda *v: spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "series_id string, run long, value double")
    r = series.series_summary(of(5, 1, 4, 2, 3)).first()
    assert (r["mean"], r["p50"], r["p95"], r["p99"]) == (3, 3, 4, 4)
    assert series.series_stability(of(100, 101, 99, 100.5, 100), max_relative_mad=0.03).first()["is_stable"]
    assert not series.series_stability(of(100, 140, 70, 130, 60)).first()["is_stable"]
    kind = lambda a, b: series.paired_deltas(of(*a), of(*b)).first()["classification"]
    assert kind([100] * 5, [90] * 5) == "faster" and kind([100] * 5, [110] * 5) == "slower" and kind([100] * 4, [90, 110, 90, 110]) == "inconclusive"
    for call in (lambda: series.series_summary(of()), lambda: series.series_summary(of(1, float("nan"))), lambda: series.paired_deltas(of(1, 2), of(1))):
        with pytest.raises(ValueError):
            call()
    even = spark.createDataFrame([(i,) for i in range(0, 10, 2)], "node_index long")
    a, b = ([r["node_index"] for r in series.sample_sources(even, 10, 4, 99).orderBy("pos").collect()] for _ in range(2))
    assert a == b and len(set(a)) == 4 and all(x % 2 == 0 for x in a)
    assert series.sample_pixels(spark, 100, 50, 20).where("x_px between 0 and 99 and y_px between 0 and 49").count() == 20


def test_regions(spark, tmp_path):
    entry = {"id": "k", "name": "Cologne", "localizedNames": {"de": "Köln", "fr_FR": "Cologne"}, "graphFileName": "k-graph.bin.gz", "boundaryFileName": "k.json", "locationRelation": "1", "subdivisionAdminLevel": "9", "epsg": 25832}
    (tmp_path / "r.json").write_text(json.dumps({"regions": [entry, entry | {"id": "a", "name": "Athens", "localizedNames": None}]}))
    rows = regions.load_regions(spark, str(tmp_path / "r.json"))
    r = rows.where("id = 'k'").first()
    assert r["subdivision_discovery_modes"] == ["area", "subarea"] and r["boundary_resolution"] == 25.0 and r["graph_binary_file_name"] == "k-graph.bin" and "fr-fr" in r["localized_names"]
    assert [x["id"] for x in regions.select_regions(rows, ["a, a"]).collect()] == ["a"]
    with pytest.raises(ValueError):
        regions.select_regions(rows, ["x"])
    manifest = {x["id"]: json.loads(x["value"]) for x in regions.location_manifest(rows).collect()}
    assert "localizedNames" not in manifest["a"] and manifest["k"]["localizedNames"]["de"] == "Köln"
    assert [x["display_name"] for x in regions.localized_locations(rows, "de_DE").collect()] == ["Athens", "Köln"]
    names = ["Zone 10", "zone 2", "Zone 02b", "eclair", "Éclair", "Ecuador", "Zürich", "Zug", "a 7", "A 07", ""]
    many = spark.createDataFrame([(f"n{i}", x, None) for i, x in enumerate(names)], "id string, name string, localized_names map<string, string>").where("name != ''")
    order = [x["name"] for x in regions.localized_locations(many, "en").collect()]
    assert order == ["a 7", "A 07", "eclair", "Éclair", "Ecuador", "zone 2", "Zone 02b", "Zone 10", "Zug", "Zürich"]
    swedish = spark.createDataFrame([("1", "Öland", None), ("2", "Zeta", None), ("3", "Oslo", None)], many.schema)
    assert [x["id"] for x in regions.localized_locations(swedish, "sv_SE").collect()] == ["3", "2", "1"] and [x["id"] for x in regions.localized_locations(swedish, "xx").collect()] == ["1", "3", "2"]
    (tmp_path / "twice.json").write_text(json.dumps([entry, entry]))
    with pytest.raises(ValueError):
        regions.load_regions(spark, str(tmp_path / "twice.json"))


def test_reading_elements(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 2, "nodes": [1, "x", 3], "tags": {"highway": "path", "lanes": 5}}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    rows = {r["id"]: r for r in source.read_overpass(spark, str(tmp_path / "d.json"), "r", strict=True).collect()}
    assert rows[2]["nodes"] == [1, 3] and rows[2]["tags"] == {"highway": "path"} and rows[1]["seq"] == 0
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        source.read_overpass(spark, str(tmp_path / "bad.json"), "r").collect()


def test_streams_equal_batches(spark, tmp_path):
    from reachgrid.streaming import streams

    for i, highway in enumerate(("footway", "path", "footway")):
        elements(spark, [way(i, [1, 2], highway=highway)]).write.mode("append").parquet(str(tmp_path / "in"))
    found = streams.to_parquet(streams.running_highway_counts(streams.stream_elements(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {tuple(r) for r in found.collect()} == {("footway", 2), ("path", 1)}


def test_streams_write_changes_only(spark, tmp_path, monkeypatch):
    """Batches of one file, bases every two batches, a second run with more files, and none at all."""
    from reachgrid.streaming import streams

    monkeypatch.setattr(streams, "COMPACT_EVERY", 2)
    schema, folder, source_dir = "x_px int, y_px int, seconds double", str(tmp_path / "out"), tmp_path / "in"
    source_dir.mkdir()
    run = lambda: streams.to_parquet(streams.running_raster(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source_dir))), folder, str(tmp_path / "check"))
    assert run().collect() == [] and run().columns == ["x_px", "y_px", "seconds"]
    least: dict = {}
    for batches in ([[(0, 0, 5.0), (1, 0, 7.0)], [(0, 0, 4.0), (2, 2, -1.0)], [(3, 3, 1.0)]], [[(3, 3, 2.0), (1, 0, 6.5)], [(9, 9, float("inf"))]], []):
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source_dir))
            for x, y, t in batch:
                if 0 <= t < float("inf"):
                    least[x, y] = min(t, least.get((x, y), t))
        assert {(r["x_px"], r["y_px"]): r["seconds"] for r in run().collect()} == least
    written = [spark.read.parquet(f"{folder}/changes/{n}").count() for n in range(5)]
    assert sum(written) <= 6 and max(written) <= 2 and spark.read.parquet(f"{folder}/base/3").count() == 3


def test_draws_jump_ahead(spark):
    state, want = 99, []
    for _ in range(300):
        state = (1_664_525 * state + 1_013_904_223) % (1 << 32)
        want.append(state)
    rows = series.drawn_states(spark, 300, 99).orderBy("draw").collect()
    assert [r["state"] for r in rows] == want and [r["draw"] for r in rows] == list(range(300))
    assert series.drawn_states(spark, 0, 1).collect() == []


def test_registered_reach_takes_sources_from_the_nodes(spark, monkeypatch):
    from reachgrid.jobs import road_queries

    walk = [(0, 7, 407, 60, 0, 1, 0, 1), (1, 407, 42, 60, 0, 1, 0, 1), (2, 42, 7, 60, 0, 1, 0, 1)]
    monkeypatch.setattr(road_queries, "_edges", lambda spark, sf_dir: spark.createDataFrame(walk, EDGE))
    monkeypatch.setattr(road_queries, "_nodes", lambda spark, sf_dir: spark.range(1000).selectExpr("id AS node_index", "id AS x_m", "0L AS y_m"))
    rows = road_queries.reachable_counts_local(spark, "").collect()
    assert {r["source_id"]: r["settled"] for r in rows if r["mode_mask"] == 1} == {7: 3, 407: 3, 807: 1}
