"""Routable ways, their nodes and connectors out of map elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.shared import once
from reachgrid.functions.tags import CONSTRAINT_TAGS, ROUTABLE_HIGHWAYS


def walkable_ways(elements: DataFrame, highways: tuple[str, ...] | None = None) -> DataFrame:
    """Ways with an allowed highway value and two references or more, with their constraint tags."""
    refs = F.filter("nodes", lambda x: x.isNotNull())
    ways = elements.where((F.col("type") == "way") & F.col("id").isNotNull() & F.col("tags")["highway"].isin(*(highways or ROUTABLE_HIGHWAYS)))
    rows = ways.select(
        "region_id", F.col("id").alias("way_id"), F.col("seq").alias("way_seq"),
        once(highway=F.col("tags")["highway"], node_ids=refs, constraints=F.map_filter("tags", lambda k, v: k.isin(*CONSTRAINT_TAGS) & v.isNotNull())),
    )
    return rows.where(F.size("node_ids") >= 2)


def way_refs(ways: DataFrame) -> DataFrame:
    return ways.select("region_id", "way_id", F.posexplode("node_ids").alias("pos", "node_id"))


def referenced_nodes(ways: DataFrame) -> DataFrame:
    """Distinct nodes that ways refer to."""
    return ways.select("region_id", F.explode("node_ids").alias("node_id")).distinct()


def _placed_nodes(elements: DataFrame) -> DataFrame:
    return elements.where((F.col("type") == "node") & F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def node_coords(elements: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Coordinates of referenced nodes, of all without ``refs``; of several the last in the file."""
    nodes = _placed_nodes(elements).select("region_id", F.col("id").alias("node_id"), "lat", "lon", "seq")
    if refs is not None:
        nodes = nodes.join(refs, ["region_id", "node_id"], "left_semi")
    last = nodes.groupBy("region_id", "node_id").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("_at"))
    return last.select("region_id", "node_id", "_at.lat", "_at.lon")


def connector_nodes(elements: DataFrame) -> DataFrame:
    """Nodes that are barriers, crossings, level crossings or entrances; types in that order."""
    tags = F.col("tags")
    kinds = F.array_compact(
        F.array(
            F.when(F.map_contains_key(tags, "barrier"), "barrier"), F.when(tags["highway"] == "crossing", "crossing"),
            F.when(tags["railway"] == "level_crossing", "level_crossing"), F.when(F.map_contains_key(tags, "entrance"), "entrance"),
        )
    )
    found = _placed_nodes(elements).where(tags.isNotNull()).select("region_id", F.col("id").alias("node_id"), "lat", "lon", "seq", kinds.alias("connector_types")).where(F.size("connector_types") > 0)
    last = found.groupBy("region_id", "node_id").agg(F.max_by(F.struct("lat", "lon", "connector_types"), "seq").alias("_at"))
    return last.select("region_id", "node_id", "_at.*")


def complete_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways all of whose nodes have coordinates."""
    missing = way_refs(ways).join(nodes, ["region_id", "node_id"], "left_anti").select("region_id", "way_id").distinct()
    return ways.join(missing, ["region_id", "way_id"], "left_anti")


def extract(elements: DataFrame, highways: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """ways (complete ones), nodes (of all candidates) and connectors."""
    candidates = walkable_ways(elements, highways)
    nodes = node_coords(elements, referenced_nodes(candidates))
    return {"candidates": candidates, "ways": complete_ways(candidates, nodes), "nodes": nodes, "connectors": connector_nodes(elements)}


def extract_summary(elements: DataFrame, highways: tuple[str, ...] | None = None) -> DataFrame:
    """Per region: candidate, kept and dropped ways, nodes and connectors."""
    found = extract(elements, highways)
    per = lambda df, name: df.groupBy("region_id").agg(F.count("*").alias(name))
    rows = per(found["candidates"], "candidate_ways")
    for name in ("ways", "nodes", "connectors"):
        rows = rows.join(per(found[name], name), "region_id", "left")
    rows = rows.fillna(0)
    return rows.withColumn("dropped_ways", F.col("candidate_ways") - F.col("ways"))


def select_routing_elements(elements: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Highway ways, connectors and ferries, then the nodes of all ways and members kept.

    ``bbox`` (south, west, north, east) tests a node's own place, and for a way any of its nodes.
    """
    tags = F.col("tags")
    ferry = F.coalesce(tags["route"] == "ferry", F.lit(False))
    way = (F.col("type") == "way") & (F.map_contains_key(tags, "highway") | ferry)
    connector = F.map_contains_key(tags, "barrier") | (tags["highway"] == "crossing") | (tags["railway"] == "level_crossing") | F.map_contains_key(tags, "entrance")
    node = (F.col("type") == "node") & (F.coalesce(connector, F.lit(False)) | ferry)
    wanted = elements.where(F.coalesce(way | node | ((F.col("type") == "relation") & ferry), F.lit(False)))
    if bbox:
        south, west, north, east = bbox
        inside = elements.where((F.col("type") == "node") & F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("region_id", F.col("id").alias("_ref"))
        touching = elements.where(F.col("type") == "way").select("region_id", "type", "id", F.explode("nodes").alias("_ref")).join(inside, ["region_id", "_ref"], "left_semi").select("region_id", "type", "id").distinct()
        keep = touching.unionByName(inside.select("region_id", F.lit("node").alias("type"), F.col("_ref").alias("id")))
        wanted = wanted.where("type = 'relation'").unionByName(wanted.where("type != 'relation'").join(keep, ["region_id", "type", "id"], "left_semi"))
    members = wanted.where("type = 'relation'").select("region_id", F.explode("members").alias("m")).select("region_id", F.col("m.type").alias("type"), F.col("m.ref").alias("id")).distinct()
    keys = wanted.select("region_id", "type", "id").unionByName(members).distinct()
    ways = elements.where("type = 'way'").join(keys, ["region_id", "type", "id"], "left_semi")
    nodes = ways.select("region_id", F.lit("node").alias("type"), F.explode("nodes").alias("id"))
    return elements.join(keys.unionByName(nodes).distinct(), ["region_id", "type", "id"], "left_semi")


def select_boundary_elements(elements: DataFrame, level: str, place_id: int | None = None, modes: tuple[str, ...] = ("area", "subarea"), bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Administrative relations of a level, with a member node in ``bbox`` and/or as subareas of the place."""
    tags = F.col("tags")
    found = elements.where((F.col("type") == "relation") & (tags["boundary"] == "administrative") & (tags["admin_level"] == level))
    keys = []
    if "area" in modes:
        if bbox:
            south, west, north, east = bbox
            inside = elements.where((F.col("type") == "node") & F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("region_id", F.col("id").alias("ref"))
            held = found.select("region_id", "id", F.explode("members").alias("m")).where("m.type = 'node'").select("region_id", "id", F.col("m.ref").alias("ref"))
            keys.append(held.join(inside, ["region_id", "ref"], "left_semi").select("region_id", "id"))
        else:
            keys.append(found.select("region_id", "id"))
    if "subarea" in modes and place_id is not None:
        place = elements.where((F.col("type") == "relation") & (F.col("id") == place_id))
        keys.append(place.select("region_id", F.explode("members").alias("m")).where("m.role = 'subarea'").select("region_id", F.col("m.ref").alias("id")))
    wanted = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
    return found.join(wanted.distinct(), ["region_id", "id"], "left_semi")
