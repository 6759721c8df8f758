"""Whole regions, landmarks, selections and spot checks on small fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reachgrid.jobs import build
from reachgrid.operators import checks, extract
from reachgrid.sources import regions
from tests.test_roads import elements, node, way


def test_regions_are_built(spark):
    line = [{"lat": 52.5, "lon": 13.4}, {"lat": 52.501, "lon": 13.41}, {"lat": 52.5, "lon": 13.42}]
    admin = {"boundary": "administrative", "admin_level": "9", "name": "Mitte"}
    rows = elements(spark, [node(1, 52.5, 13.4), node(2, 52.501, 13.401), node(3, 52.502, 13.402), way(7, [1, 2, 3], highway="footway"), ("relation", 100, None, None, None, admin, line), ("relation", 9, None, None, None, {"name": "x"}, None, [{"type": "relation", "ref": 100, "role": "subarea", "geometry": None}])])
    config = spark.createDataFrame([("r", 25833, "9", 0.0, "meters")], "id string, epsg int, subdivision_admin_level string, boundary_resolution double, boundary_units string")
    made = build.build_regions(rows, config, ("ways", "boundaries"))["r"]
    assert made["nodes"].count() == 2 and made["edges"].count() == 2 and made["canvas"].first()["out_points"] == 3
    marks = spark.createDataFrame([(1, "r", 52.5021, 13.4021)], "point_id long, region_id string, lat double, lon double")
    snapped = build.match_landmarks(marks, made["extent"], made["nodes"], 25833).first()
    assert snapped["node_index"] == 1 and snapped["distance_m"] < 20
    nodes = made["nodes"]
    assert {r["inside"] for r in checks.bbox_spot_check(nodes, made["extent"], 25833, (52.0, 13.0, 53.0, 14.0)).collect()} == {True}
    assert {r["inside"] for r in checks.bbox_spot_check(nodes, made["extent"], 25833, (0.0, 0.0, 1.0, 1.0)).collect()} == {False}
    for modes, place in ((("area",), None), (("subarea",), 9), (("area", "subarea"), 9)):
        assert [r["id"] for r in extract.select_boundary_elements(rows, "9", place, modes).collect()] == [100]
    for call in (lambda: build.build_regions(rows, config, ("tiles",)), lambda: build.build_regions(rows.where("region_id = 'q'"), config)):
        with pytest.raises(ValueError):
            call()


def town(region: str, lat: float, lon: float, seed: int) -> list[tuple]:
    """Streets with chains, a way for one mode, a long ferry and a dropped way, as elements of ``region``."""
    r = random.Random(seed)
    rows = [node(i, lat + 0.0007 * (i % 5) + r.random() / 9000, lon + 0.001 * (i // 5)) for i in range(20)] + [node(50, lat + 1.9, lon + 1.2)]
    for at, refs in enumerate([[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [0, 5, 10, 15], [2, 7, 12, 17], [4, 9, 14, 19], [10, 11, 12, 13, 14], [19, 50], [3, 99]]):
        rows.append(way(100 + at, refs, highway=r.choice(["footway", "residential"]), maxspeed="30"))
    admin = {"boundary": "administrative", "admin_level": "9", "name": f"of {region}"}
    line = [{"lat": lat + r.random() / 50, "lon": lon + r.random() / 50} for _ in range(30)]
    return [*rows, ("relation", 900, None, None, None, admin, line)]


def test_three_regions_together_as_one_by_one(spark):
    """Codes of three kinds, split edges with synthetic nodes, chains and canvases."""
    towns = {"a": (52.5, 13.4, 25833), "b": (51.5, -0.12, 27700), "c": (48.85, 2.35, 2154)}
    own = {k: elements(spark, town(k, lat, lon, i)).withColumn("region_id", F.lit(k)) for i, (k, (lat, lon, _)) in enumerate(towns.items())}
    every = own["b"].unionByName(own["a"]).unionByName(own["c"])
    given = spark.createDataFrame([(k, e, "9", 40.0, "meters") for k, (_, _, e) in towns.items()], "id string, epsg int, subdivision_admin_level string, boundary_resolution double, boundary_units string")
    together = build.build_regions(every, given)
    assert set(together) == set(towns)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for k in towns:
        alone = build.build_regions(own[k], given.where(F.col("id") == k))[k]
        for name in ("nodes", "edges", "extent", "skipped", "canvas"):
            assert rows(together[k][name]) == rows(alone[name]) != [], (k, name)
        assert set(checks.layout_violations(together[k]["nodes"], together[k]["edges"]).first()) == {0}
        assert together[k]["nodes"].where("osm_id < 0").count() > 0 and together[k]["edges"].agg(F.min("edge_index")).first()[0] == 0


def test_asked_locations(spark):
    places = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, id string")
    asks = spark.createDataFrame([(1, "b"), (2, "zz"), (3, None)], "ask_id int, asked string")
    got = lambda default: [r["id"] for r in regions.resolve_location(places, asks, default).orderBy("ask_id").collect()]
    assert got("b") == ["b", "b", "b"] and got("none") == ["b", "a", "a"] and got(None) == ["b", "a", "a"]
