"""Checks of graphs, each a pass of conditional counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.geo import unproject
from reachgrid.functions.numbering import dense_index, running_total
from reachgrid.functions.shared import small_side, written

#: Bounds that one task sums up.
_BLOCK = 100_000


def graph_integrity(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """out_of_range (each end counts) and bad_costs; ``strict`` makes either an error."""
    n = nodes.agg(F.count("*").alias("n"))
    outside = lambda c: F.when((F.col(c) < 0) | (F.col(c) >= F.col("n")), 1).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    row = edges.crossJoin(F.broadcast(n)).agg(total(outside("source_index") + outside("target_index")).alias("out_of_range"), F.count_if(F.col("cost_seconds") <= 0).alias("bad_costs"))
    if strict and row.where("out_of_range > 0 or bad_costs > 0").limit(1).count():
        raise ValueError("edges with ends out of range or costs that are not positive")
    return row


def layout_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """gaps, overlaps and out_of_bounds (edges) of the nodes' edge ranges, edges outside their owner's range, and bad_fields."""
    n = edges.agg(F.count("*").alias("_edges"))
    ranges = nodes.where("edge_count > 0").select(F.col("first_edge_index").alias("start"), (F.col("first_edge_index") + F.col("edge_count")).alias("end"))
    # Each bound turns the number of ranges that hold an edge up or down; where it stands at 0 is a gap, above 1 an overlap.
    turns = ranges.select(F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("turn")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("turn")))).alias("t")).select("t.*")
    ends = n.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("turn")), F.struct(F.col("_edges").alias("at"), F.lit(0).alias("turn")))).alias("t")).select("t.*")
    turns = turns.unionByName(ends).groupBy("at").agg(F.sum("turn").alias("turn"))
    turns = dense_index(turns, [F.col("at")], "_i").withColumn("_bucket", F.floor(F.col("_i") / _BLOCK)).withColumn("_all", F.lit(0))
    turns = written(running_total(turns, ["_all"], [F.col("at")], "turn", "open"), "turns")
    after = turns.select((F.col("_i") - 1).alias("_i"), F.col("at").alias("next"))
    stretches = turns.join(after, "_i").crossJoin(F.broadcast(n))  # one row
    inside = F.greatest(F.least("next", "_edges") - F.greatest("at", F.lit(0)), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    layout = stretches.agg(
        total(F.when(F.col("open") == 0, inside).otherwise(0)).alias("gaps"), total(F.when(F.col("open") > 1, F.col("next") - F.col("at")).otherwise(0)).alias("overlaps"),
        total(F.when(F.col("open") > 0, F.col("next") - F.col("at") - inside).otherwise(0)).alias("out_of_bounds"),
    )
    owner = nodes.select(F.col("node_index").alias("source_index"), F.col("first_edge_index").alias("_start"), (F.col("first_edge_index") + F.col("edge_count")).alias("_end"))
    bad = ~F.col("mode_mask").between(1, 255) | ~F.col("maxspeed_kph").between(0, 65535) | ~F.col("road_class_id").between(0, 255)
    own = F.coalesce((F.col("edge_index") >= F.col("_start")) & (F.col("edge_index") < F.col("_end")), F.lit(False))
    fields = edges.join(owner, "source_index", "left").agg(F.count_if(~own).alias("wrong_owner"), F.count_if(bad).alias("bad_fields"))
    return layout.crossJoin(fields).select("gaps", "overlaps", "wrong_owner", "out_of_bounds", "bad_fields")  # one row each


def stored_graph_violations(header: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: bad header, targets out of range, and (from version 2 on) masks of 0 or speeds outside 1 to 200."""
    head = header.select("file", "version", "n_nodes", "n_edges", (
        (F.col("magic") != 0x49534F43) | ~F.col("version").isin(1, 2, 3) | (F.col("node_offset") != 64) | (F.col("edge_offset") != 64 + 16 * F.col("n_nodes"))
    ).alias("bad_header"))
    rows = edges.join(head.select("file", "version", "n_nodes"), "file")
    sums = rows.groupBy("file").agg(
        F.count_if((F.col("target_index") < 0) | (F.col("target_index") >= F.col("n_nodes"))).alias("bad_targets"),
        F.count_if((F.col("version") >= 2) & (F.col("mode_mask") == 0)).alias("no_mode"),
        F.count_if((F.col("version") >= 2) & ~F.col("maxspeed_kph").between(1, 200)).alias("bad_speeds"),
    )
    return head.select("file", "bad_header").join(sums, "file", "left").fillna(0)


def bbox_spot_check(nodes: DataFrame, extent: DataFrame, epsg: int, bbox: tuple[float, float, float, float], n: int = 10, seed: int = 1) -> DataFrame:
    """Some nodes (by a seeded hash) un-projected: lat, lon and whether the box has them."""
    some = nodes.orderBy(F.xxhash64("node_index", F.lit(seed)), "node_index").limit(n)
    rows = some.join(small_side(extent.select("region_id", "origin_easting", "origin_northing")), "region_id")
    lat, lon = unproject(F.col("origin_easting") + F.col("x_m"), F.col("origin_northing") + F.col("y_m"), epsg)
    south, west, north, east = bbox
    return rows.select("node_index", lat.alias("lat"), lon.alias("lon")).withColumn("inside", F.col("lat").between(south, north) & F.col("lon").between(west, east))
