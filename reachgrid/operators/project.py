"""Projected nodes, grids and pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.geo import project
from reachgrid.functions.numbers import half_even
from reachgrid.functions.shared import small_side, written

PIXEL_M = 10.0


def projected(nodes: DataFrame, epsg: int) -> DataFrame:
    """``nodes`` (lat, lon) with easting and northing."""
    east, north = project(F.col("lat"), F.col("lon"), epsg)
    return nodes.withColumn("easting", east).withColumn("northing", north)


def projected_regions(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """``nodes`` (region_id, lat, lon) with easting and northing by the code of their region (``regions``: region_id, epsg)."""
    held = written(nodes.join(small_side(regions.select("region_id", "epsg")), "region_id"), "region-nodes")
    # As many codes as there are projections at most.
    codes = [r["epsg"] for r in regions.select("epsg").distinct().orderBy("epsg").collect()]
    parts = [projected(held.where(F.col("epsg") == code), code) for code in codes]
    return reduce(DataFrame.unionByName, parts) if parts else held.withColumn("easting", F.lit(None).cast("double")).withColumn("northing", F.lit(None).cast("double"))


def grid_extent(nodes: DataFrame, pixel: float = PIXEL_M) -> DataFrame:
    """Origin, far corner and grid size per region; no node is an error."""
    span = lambda a, b: F.ceil((F.col(a) - F.col(b)) / pixel).cast("int")
    rows = nodes.groupBy("region_id").agg(
        F.min("easting").alias("origin_easting"), F.min("northing").alias("origin_northing"), F.max("easting").alias("max_easting"), F.max("northing").alias("max_northing")
    )
    if not rows.limit(1).count():
        raise ValueError("no nodes to project")
    return rows.select("*", F.lit(pixel).alias("pixel_size_m"), span("max_easting", "origin_easting").alias("grid_width_px"), span("max_northing", "origin_northing").alias("grid_height_px"))


def offsets(nodes: DataFrame, extent: DataFrame) -> DataFrame:
    """Whole metres from the region's origin. ``extent`` has a row per region."""
    rows = nodes.join(small_side(extent.select("region_id", "origin_easting", "origin_northing")), "region_id")
    at = lambda c, o: half_even(F.col(c) - F.col(o))
    return rows.withColumn("x_m", at("easting", "origin_easting")).withColumn("y_m", at("northing", "origin_northing")).drop("origin_easting", "origin_northing")


def offset_points(points: DataFrame, extent: DataFrame, epsg: int) -> DataFrame:
    """Points (lat, lon) as offsets from their region's origin, not rounded."""
    rows = projected(points, epsg).join(small_side(extent.select("region_id", "origin_easting", "origin_northing")), "region_id")
    return rows.withColumn("x", F.col("easting") - F.col("origin_easting")).withColumn("y", F.col("northing") - F.col("origin_northing")).drop("origin_easting", "origin_northing")


def node_pixels(nodes: DataFrame, width: int, height: int, pixel: float = PIXEL_M) -> DataFrame:
    """x_px, y_px of each node; y counts from the north, both held to the grid."""
    held = lambda c, top: F.greatest(F.lit(0), F.least(c, F.lit(top - 1))).cast("int")
    x, y = F.floor(F.col("x_m") / pixel), (height - 1) - F.floor(F.col("y_m") / pixel)
    return nodes.withColumn("x_px", held(x, width)).withColumn("y_px", held(y, height))


def pixel_to_metres(x: Column, y: Column, origin: tuple[float, float], height: int, pixel: float = PIXEL_M) -> tuple[Column, Column]:
    return origin[0] + x * pixel, origin[1] + (height - 1 - y) * pixel
