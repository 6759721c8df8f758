"""Graphs and boundaries of several regions in one go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.shared import small_side, written
from reachgrid.operators import adjacency, boundary, contract, extract, project, routing

#: Fixed names that components go by.
COMPONENTS = {"graph": "graph", "graphs": "graph", "ways": "graph", "boundary": "boundary", "boundaries": "boundary"}


def build_graphs(elements: DataFrame, regions: DataFrame, simplify: bool = True) -> dict[str, DataFrame]:
    """nodes, edges, extent and skipped ways of all ``regions`` (id, epsg) in one set of jobs; indices count from 0 in each."""
    codes = regions.select(F.col("id").alias("region_id"), "epsg")
    found = extract.extract(elements.join(small_side(codes.select("region_id")), "region_id", "left_semi"))
    rows = written(project.projected_regions(found["nodes"], codes), "projected")
    extent = project.grid_extent(rows)
    placed = project.offsets(rows, extent).select("region_id", "node_id", "x_m", "y_m")
    graph = adjacency.build_graph(found, placed)
    if simplify:
        graph["nodes"], graph["edges"] = contract.contract_chains(written(graph["nodes"], "graph-nodes"), graph["edges"])
    graph["nodes"], graph["edges"] = adjacency.numbered_by_region(written(graph["nodes"], "nodes"), graph["edges"])
    return graph | {"extent": extent}


def build_canvases(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """Boundary canvases of all ``regions``, each with its level, resolution, units and code; regions that agree in them go together."""
    given = ["subdivision_admin_level", "boundary_resolution", "boundary_units", "epsg"]
    parts = []
    for level, resolution, units, epsg in regions.select(*given).distinct().orderBy(*given).collect():  # the configuration is short
        same = (F.col("subdivision_admin_level") == level) & (F.col("boundary_resolution") == resolution) & (F.col("boundary_units") == units) & (F.col("epsg") == epsg)
        own = elements.join(small_side(regions.where(same).select(F.col("id").alias("region_id"))), "region_id", "left_semi")
        parts.append(boundary.boundary_canvas(boundary.boundary_features(own, level), resolution, units, epsg))
    return reduce(DataFrame.unionByName, parts)


def build_regions(elements: DataFrame, regions: DataFrame, components: tuple[str, ...] = ("graph", "boundary")) -> dict[str, dict[str, DataFrame]]:
    """Per region id what was asked for: a graph's tables and/or a boundary ``canvas``.

    All regions are built together; the tables given for one are its rows. An unknown component, and a region without
    elements, are errors.
    """
    if unknown := [c for c in components if c not in COMPONENTS]:
        raise ValueError(f"unknown components {unknown}")
    wanted = {COMPONENTS[c] for c in components}
    without = regions.select(F.col("id").alias("region_id")).join(elements.select("region_id").distinct(), "region_id", "left_anti").limit(1).collect()
    if without:
        raise ValueError(f"no elements of region {without[0]['region_id']}")
    made: dict[str, DataFrame] = build_graphs(elements, regions) if "graph" in wanted else {}
    if "boundary" in wanted:
        made["canvas"] = build_canvases(elements, regions)
    ids = [r["id"] for r in regions.select("id").orderBy("id").collect()]  # names of the tables
    return {i: {name: df.where(F.col("region_id") == i) for name, df in made.items()} for i in ids}


def match_landmarks(points: DataFrame, extent: DataFrame, nodes: DataFrame, epsg: int) -> DataFrame:
    """Nearest graph node of each landmark (point_id, region_id, lat, lon)."""
    placed = project.offset_points(points, extent, epsg).select("point_id", "x", "y")
    grid = nodes.select("node_index", nodes["x_m"].cast("double").alias("x"), nodes["y_m"].cast("double").alias("y"))
    return routing.nearest_nodes(placed, grid)
