"""The given star-schema tables as a road network.

Parts are nodes of a street grid, every order is a way whose lines step along
the grid, and the keys of orders and customers decide the tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachgrid.functions.shared import once, written
from reachgrid.functions.tags import ROAD_CLASSES

REGION = "grid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(number of nodes, width of the grid)."""
    n = table(spark, sf_dir, "part").count()
    return n, int(n**0.5) + (int(n**0.5) ** 2 < n)


def grid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, node_id, lat, lon, x_m, y_m, p_size."""
    _, w = grid(spark, sf_dir)
    key = F.col("p_partkey")
    gx, gy = key % w, F.floor(key / w)
    return table(spark, sf_dir, "part").select(
        F.lit(REGION).alias("region_id"), key.alias("node_id"), (52.30 + 0.001 * gy).alias("lat"), (13.05 + 0.0015 * gx).alias("lon"),
        (120 * gx + F.col("p_size")).cast("long").alias("x_m"), (120 * gy + key % 7).cast("long").alias("y_m"), "p_size",
    )


def grid_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, node_id: a way starts at its first line's part and goes east or south."""
    _, w = grid(spark, sf_dir)
    # One order for all: places and sums come from a single sort.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(w)
    at, begin, steps = F.row_number().over(order), F.first("l_partkey").over(order), F.sum(step).over(order) - F.first(step).over(order)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), at.cast("long").alias("_at"), begin.alias("_begin"), steps.alias("_steps"))
    # A start without a part counts as 0 further on, as in a sum.
    node = F.when(F.col("_at") == 1, F.col("_begin")).otherwise(F.coalesce("_begin", F.lit(0)) + F.col("_steps"))
    return lines.select("way_id", (F.col("_at") - 1).alias("pos"), node.cast("long").alias("node_id"))


def _tags() -> Column:
    """Map of the tags whose rule matches."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    # A place in a constant array: chains of conditions make code too long to be compiled.
    pick = lambda key, n, values: F.get(F.array(*[F.lit(values.get(i)).cast("string") for i in range(n)]), (key % n).cast("int"))
    speeds = ["50", "30 mph", "walk", "none", "50;70", "signals;30", "abc", "80 km/h", "20kph", "7.5"]
    values = {
        "highway": F.get(F.array(*[F.lit(h) for h in ROAD_CLASSES]), (F.floor(o / 4) % 15).cast("int")),
        "access": pick(c, 11, {0: "private", 1: "yes", 2: "no", 3: " Permissive "}),
        "foot": pick(c, 7, {0: "yes", 1: "no", 2: "designated"}),
        "bicycle": pick(c, 5, {0: "no", 1: "yes"}),
        "vehicle": pick(c, 13, {0: "no"}),
        "motor_vehicle": pick(c, 17, {0: "yes", 1: "no"}),
        "cycleway": pick(o, 9, {0: "track"}),
        "oneway": pick(o, 6, {0: "yes"}),
        "oneway:foot": pick(o, 10, {0: "yes"}),
        "junction": pick(o, 14, {0: "Roundabout"}),
        "sidewalk": pick(c, 3, {0: "both", 1: "no"}),
        "surface": pick(c, 2, {0: "asphalt"}),
        "maxspeed": pick(c, 12, dict(enumerate(speeds))),
        "maxspeed:forward": pick(c, 8, {0: "30", 1: "bad"}),
        "maxspeed:backward": pick(c, 8, {0: "20"}),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def _none() -> list[Column]:
    points = "array<struct<lat:double,lon:double>>"
    return [F.lit(None).cast(t).alias(n) for n, t in (("geometry", points), ("members", f"array<struct<type:string,ref:bigint,role:string,geometry:{points}>>"))]


def way_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways among the elements, not written."""
    refs = grid_refs(spark, sf_dir).groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id")))["node_id"].alias("nodes"))
    ways = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(refs, F.col("o_orderkey") == F.col("way_id"), "left")
    return ways.select(F.lit(REGION).alias("region_id"), (F.col("o_orderkey") + 10_000_000).alias("seq"), F.lit("way").alias("type"), F.col("o_orderkey").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "nodes", once(tags=_tags()), *_none())


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network as map elements: nodes with coordinates and connector tags, ways with references and tags.

    Written once, as what is made of it reads it several times.
    """
    size = F.col("p_size") % 10
    some = lambda test, k, v: F.when(test, F.map_from_arrays(F.array(F.lit(k)), F.array(F.lit(v)))).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(
        some(size.isin(0, 4), "barrier", "gate"), some(size == 1, "highway", "crossing"), some(size == 2, "railway", "level_crossing"), some(size.isin(3, 4), "entrance", "yes")
    )
    nodes = grid_nodes(spark, sf_dir).select("region_id", F.col("node_id").alias("seq"), F.lit("node").alias("type"), F.col("node_id").alias("id"), "lat", "lon", F.lit(None).cast("array<bigint>").alias("nodes"), tags.alias("tags"), *_none())
    return written(nodes.unionByName(way_elements(spark, sf_dir)), "elements")
