"""Administrative boundaries as simplified paths on a canvas."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.geo import project
from reachgrid.functions.shared import join_by_size, small_side, stored, written


def _inline(geometry: Column) -> Column:
    """Points (x = lon, y = lat) of an inline geometry, those without a coordinate left out."""
    good = F.filter(geometry, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return F.transform(good, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))


def way_geometry(elements: DataFrame) -> DataFrame:
    """region_id, way_id, points: inline points if there are two, else the node references if all resolve."""
    ways = elements.where("type = 'way' and id is not null").select("region_id", F.col("id").alias("way_id"), _inline(F.col("geometry")).alias("own"), F.filter("nodes", lambda x: x.isNotNull()).alias("refs"))
    own = ways.where(F.size("own") >= 2).select("region_id", "way_id", F.col("own").alias("points"))
    nodes = elements.where("type = 'node'").groupBy("region_id", F.col("id").alias("node_id")).agg(F.max_by(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), "seq").alias("at"))
    refs = ways.where((F.size("own") < 2) | F.col("own").isNull()).where(F.size("refs") >= 2).select("region_id", "way_id", F.posexplode("refs").alias("pos", "node_id"))
    held = refs.join(nodes, ["region_id", "node_id"], "left").groupBy("region_id", "way_id").agg(F.bool_and(F.col("at.x").isNotNull() & F.col("at.y").isNotNull()).alias("all"), F.array_sort(F.collect_list(F.struct("pos", "at"))).alias("list"))
    return own.unionByName(held.where("all").select("region_id", "way_id", F.transform("list", lambda x: x["at"]).alias("points")))


def boundary_features(elements: DataFrame, level: str) -> DataFrame:
    """relation_id, name, admin_level, path_pos, points of the administrative relations of a level.

    A relation's own geometry comes first, then each way member's: inline, else the
    way it refers to. Ordered by name and id.
    """
    tags = F.col("tags")
    found = elements.where((F.col("type") == "relation") & (tags["boundary"] == "administrative") & (tags["admin_level"] == level))
    name = F.coalesce(F.when(F.trim(tags["name"]) != "", tags["name"]), F.concat(F.lit("relation_"), F.col("id").cast("string")))
    found = found.select("region_id", F.col("id").alias("relation_id"), name.alias("name"), tags["admin_level"].alias("admin_level"), _inline(F.col("geometry")).alias("own"), "members")
    keys = ["region_id", "relation_id", "name", "admin_level"]
    own = found.where(F.size("own") >= 2).select(*keys, F.lit(-1).alias("pos"), F.col("own").alias("points"))
    members = found.select(*keys, F.posexplode("members").alias("pos", "m")).where("m.type = 'way'").select(*keys, "pos", F.col("m.ref").alias("way_id"), _inline(F.col("m.geometry")).alias("inline"))
    held = members.join(way_geometry(elements), ["region_id", "way_id"], "left")
    held = held.select(*keys, "pos", F.when(F.size("inline") >= 2, F.col("inline")).otherwise(F.col("points")).alias("points")).where(F.size("points") >= 2)
    both = own.unionByName(held)
    paths = both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "points"))).alias("paths"))
    return paths.select(*keys, F.posexplode(F.transform("paths", lambda x: x["points"])).alias("path_pos", "points")).orderBy("name", "relation_id", "path_pos")


def _generations(x: np.ndarray, y: np.ndarray, ends: np.ndarray, tolerance: float) -> np.ndarray:
    """Positions kept of lines that lie one behind the other; ``ends`` are their first and last positions.

    All stretches between kept points are measured at once; each that has points further than ``tolerance`` from its chord
    keeps the first of the furthest ones, until none has. Between two lines lies a stretch without a point inside.
    """
    found = np.array([0])
    while len(found):
        at = np.repeat(ends[:-1], np.diff(ends))
        to = np.repeat(ends[1:], np.diff(ends))
        last = len(at)
        px, py, dx, dy = x[:last] - x[at], y[:last] - y[at], x[to] - x[at], y[to] - y[at]
        square = dx * dx + dy * dy
        share = np.clip((px * dx + py * dy) / np.where(square > 0, square, 1), 0, 1)
        ex, ey = px - share * dx, py - share * dy
        far = ex * ex + ey * ey
        most = np.repeat(np.maximum.reduceat(far, ends[:-1]), np.diff(ends))
        found = np.flatnonzero((far == most) & (most > tolerance * tolerance))
        found = found[np.unique(at[found], return_index=True)[1]]
        ends = np.union1d(ends, found)
    return ends


def kept_positions(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Positions of a line's points that are kept. A ring's closing point is left out before and put back after."""
    n = len(x)
    ring = n >= 4 and x[0] == x[-1] and y[0] == y[-1]
    last = n - 2 if ring else n - 1
    if tolerance <= 0 or last < 2:
        return np.arange(n)
    ends = _generations(x, y, np.array([0, last]), tolerance)
    return np.append(ends, n - 1) if ring else ends


#: Points of a stretch that a task finishes alone, and of all stretches that are dealt to one.
PIECE = 50_000
_DEAL = 200_000


def path_points(paths: DataFrame) -> DataFrame:
    """Paths with ``points`` as rows: their other columns, pos, x and y."""
    rest = [c for c in paths.columns if c != "points"]
    return paths.select(*rest, F.posexplode("points").alias("pos", "_p")).select(*rest, F.col("pos").cast("long").alias("pos"), "_p.x", "_p.y")


def _finished(pool: DataFrame, keys: list[str], tolerance: float, total: int) -> DataFrame:
    """Kept inner points of stretches of at most a piece each, many of them to a group."""
    by = [*keys, "_from"]

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*by, "pos"], ignore_index=True)
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[by].iloc[1:].to_numpy() != rows[by].iloc[:-1].to_numpy()).any(axis=1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
        line = 2 * np.arange(len(first))
        # The two ends of each stretch lie around its inner points.
        place = np.arange(len(rows)) + 2 * np.cumsum(new) - 1
        at, to = first + line, last + line + 2
        held = []
        for c in ("x", "y"):
            v = np.empty(len(rows) + 2 * len(first))
            v[place], v[at], v[to] = rows[c], rows[f"_a{c}"].to_numpy()[first], rows[f"_b{c}"].to_numpy()[first]
            held.append(v)
        kept = _generations(*held, np.sort(np.concatenate([at, to])), tolerance)
        return rows.loc[np.isin(place, kept), [*keys, "pos", "x", "y"]]

    schema = pool.select(*keys, "pos", "x", "y").schema
    flat = pool.select(*keys, "_from", "pos", "x", "y", *[F.col(f"_{e}.{c}").alias(f"_{e}{c}") for e in "ab" for c in "xy"])
    group = F.pmod(F.xxhash64(*by), F.lit(-(-total // _DEAL) or 1))
    return flat.groupBy(group.alias("_g")).applyInPandas(finish, schema)


def simplify_points(points: DataFrame, keys: list[str], tolerance: float, piece: int = PIECE) -> DataFrame:
    """keys, pos, x, y: the points that simplification keeps of paths given as rows; a path may be of any length.

    A generation measures all open stretches in one aggregation: a stretch over ``piece`` points is cut at the first of its
    furthest points if that lies further than ``tolerance`` from the chord, and closed if not. Shorter ones are finished in
    tasks that get many of them. So no path, and no long stretch, meets in one task or row; generations go with the
    depth to which long stretches are cut, and each writes the points of open stretches only.

    Defined results as for ``kept_positions``: both ends stay; a ring (four points or more, first equal to last) is measured
    without its closing point, which stays; no tolerance keeps all. ``pos`` is distinct in a path. Points without a key,
    pos, x or y are left out. Columns other than these are not read.
    """
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    columns = [*keys, "pos", "x", "y"]
    rows = points.select(*columns).dropna()
    if tolerance == 0:
        return rows
    spark = points.sparkSession
    rows = written(rows, "path-points")
    total = rows.count()
    point = F.struct("pos", "x", "y")
    ends = written(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(point).alias("_a"), F.max(point).alias("_z")), "path-ends")
    ring = (F.col("_n") >= 4) & (F.col("_a.x") == F.col("_z.x")) & (F.col("_a.y") == F.col("_z.y"))
    rings = join_by_size(rows, ends.where(ring), keys, "_n", total).where("pos < _z.pos")
    before = rings.groupBy(*keys).agg(F.max(point).alias("_y"))
    ends = written(ends.join(before, keys, "left").withColumn("_b", F.coalesce("_y", "_z")), "path-stretches")
    flat = lambda df, c: df.select(*keys, f"{c}.*")
    # A ring has three ends; a path of one point has one.
    kept = [stored(ends.select(*keys, F.explode(F.array_distinct(F.array("_a", "_b", "_z"))).alias("_p")).select(*keys, "_p.*"), "kept")]
    open_rows = join_by_size(rows, ends.select(*keys, "_a", "_b", "_n"), keys, "_n", total).where("pos > _a.pos and pos < _b.pos")
    open_rows = written(open_rows.select(*columns, F.col("_a.pos").alias("_from"), "_a", "_b"), "open")
    pools = []
    by = [*keys, "_from"]
    px, py, dx, dy = F.col("x") - F.col("_a.x"), F.col("y") - F.col("_a.y"), F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    square = dx * dx + dy * dy
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.when(square > 0, square).otherwise(1.0)))
    ex, ey = px - share * dx, py - share * dy
    far = ex * ex + ey * ey
    while True:
        most = F.max(F.struct(far.alias("far"), (-F.col("pos")).alias("rank"), "x", "y"))
        found = written(open_rows.groupBy(*by).agg(F.count("*").alias("_n"), most.alias("_most")), "stretches")
        found = found.withColumn("_small", F.col("_n") <= piece).where(F.col("_small") | (F.col("_most.far") > tolerance * tolerance))
        found = found.withColumn("_m", F.struct((-F.col("_most.rank")).alias("pos"), "_most.x", "_most.y")).drop("_most")
        if not found.limit(1).count():
            break
        large = found.where("not _small")
        went = join_by_size(open_rows, found, by, "_n", total).where("_small or pos != _m.pos")
        left, right = ~F.col("_small") & (F.col("pos") < F.col("_m.pos")), ~F.col("_small") & (F.col("pos") > F.col("_m.pos"))
        went = went.select(*columns, "_small", F.when(right, F.col("_m")).otherwise(F.col("_a")).alias("_a"), F.when(left, F.col("_m")).otherwise(F.col("_b")).alias("_b"))
        went = written(went.withColumn("_from", F.col("_a.pos")), "open")
        pools.append(went.where("_small").drop("_small"))
        if not large.limit(1).count():
            break
        kept.append(stored(flat(large, "_m"), "kept"))
        open_rows = went.where("not _small").drop("_small")
    if pools:
        kept.append(stored(_finished(reduce(DataFrame.unionByName, pools), keys, tolerance, total), "kept"))
    return spark.read.schema(rows.schema).parquet(*kept)


def canvas_points(points: DataFrame, keys: list[str], tolerance: float, region: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """Paths given as rows (keys, pos, x, y) on a canvas whose y runs down: keys, pos, x, y, width, height, min_x, max_y.

    One canvas for each value of the ``region`` columns (some of the keys), or one for all. Paths of one point are left out;
    no path left is an error. All stays rows, so a canvas and its paths may be of any size.
    """
    region = region or []
    kept = written(simplify_points(points, keys, tolerance, piece), "simplified")
    sizes = written(kept.groupBy(*keys).agg(F.count("*").alias("_n")), "path-sizes")
    drawn = join_by_size(kept, sizes.where("_n >= 2"), keys, "_n", kept.count()).drop("_n")
    extent = written(drawn.groupBy(*region).agg(F.count("*").alias("_n"), F.min("x").alias("min_x"), F.max("x").alias("_e"), F.min("y").alias("_s"), F.max("y").alias("max_y")).where("_n > 0"), "canvas-extent")
    if not extent.limit(1).count():
        raise ValueError("no boundary has a path")
    drawn = join_by_size(drawn, extent, region, "_n", kept.count()) if region else drawn.crossJoin(F.broadcast(extent))  # one row without regions
    return drawn.select(*keys, "pos", (F.col("x") - F.col("min_x")).alias("x"), (F.col("max_y") - F.col("y")).alias("y"), (F.col("_e") - F.col("min_x")).alias("width"), (F.col("max_y") - F.col("_s")).alias("height"), "min_x", "max_y")


def simplify_paths(paths: DataFrame, tolerance: float) -> DataFrame:
    """``paths`` with simplified ``points``, each path in one row (long ones: ``simplify_points``); coordinates go to the helper as plain arrays and positions come back."""
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")

    @F.pandas_udf("array<int>")
    def kept(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([kept_positions(np.asarray(a), np.asarray(b), tolerance).astype(np.int32) for a, b in zip(x, y)])

    axis = lambda c: F.transform("points", lambda p: p[c])
    positions = kept(axis("x"), axis("y"))
    return paths.withColumn("_kept", positions).withColumn("points", F.transform("_kept", lambda i: F.get("points", i))).drop("_kept")


def boundary_canvas(paths: DataFrame, tolerance: float, units: str = "meters", epsg: int | None = None) -> DataFrame:
    """relation_id, name, admin_level, path_pos, points on a canvas whose y runs down, with its width, height and origin.

    Points in degrees are projected for ``meters``. No path left, and a wrong unit, are errors.
    """
    if units not in ("meters", "degrees"):
        raise ValueError("units are meters or degrees")
    rows = paths
    if units == "meters" and epsg is not None:
        def placed(p: Column) -> Column:
            east, north = project(p["y"], p["x"], epsg)
            return F.struct(east.alias("x"), north.alias("y"))
        rows = rows.withColumn("points", F.transform("points", placed))
    rows = simplify_paths(rows.withColumn("in_points", F.size("points")), tolerance).where(F.size("points") >= 2)
    low = lambda c: F.array_min(F.transform("points", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("points", lambda p: p[c]))
    # A canvas for each region, or one for all without regions.
    keys = [c for c in ("region_id",) if c in paths.columns]
    extent = written(rows.groupBy(*keys).agg(F.min(low("x")).alias("min_x"), F.max(high("x")).alias("max_x"), F.min(low("y")).alias("min_y"), F.max(high("y")).alias("max_y")), "canvas-extent")
    if not extent.where("min_x is not null").limit(1).count():
        raise ValueError("no boundary has a path")
    rows = rows.join(small_side(extent), keys) if keys else rows.crossJoin(F.broadcast(extent))  # one row without regions
    moved = F.transform("points", lambda p: F.struct((p["x"] - F.col("min_x")).alias("x"), (F.col("max_y") - p["y"]).alias("y")))
    return rows.select(*[c for c in ("region_id", "relation_id", "name", "admin_level", "path_pos") if c in paths.columns], moved.alias("points"), "in_points", F.size("points").alias("out_points"), (F.col("max_x") - F.col("min_x")).alias("width"), (F.col("max_y") - F.col("min_y")).alias("height"), "min_x", "max_y")


def canvas_payload(canvas: DataFrame, units: str = "meters") -> DataFrame:
    """One row: the canvas as JSON, features by name and id. A canvas is one map's picture."""
    pairs = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    paths = canvas.groupBy("relation_id", "name", "admin_level").agg(F.transform(F.array_sort(F.collect_list(F.struct("path_pos", pairs.alias("p")))), lambda x: x["p"]).alias("paths"), F.sum("in_points").alias("i"), F.sum("out_points").alias("o"), *[F.first(c).alias(c) for c in ("width", "height", "min_x", "max_y")])
    feature = F.struct("name", F.col("relation_id").alias("relationId"), F.col("admin_level").alias("adminLevel"), "paths")
    one = paths.agg(
        *[F.first(c).alias(c) for c in ("width", "height", "min_x", "max_y")], F.array_sort(F.collect_list(feature)).alias("features"),
        F.struct(F.count("*").alias("featureCount"), F.sum(F.size("paths")).alias("pathCount"), F.sum("i").alias("inputPointCount"), F.sum("o").alias("outputPointCount")).alias("stats"),
    )
    space = F.struct("width", "height", F.col("min_x").alias("x_origin"), F.col("max_y").alias("y_origin"), F.lit(units).alias("units"), F.lit("y-down").alias("axis"))
    return one.select(F.to_json(F.struct(space.alias("coordinate_space"), "features", "stats")).alias("value"))


def write_boundary_json(payload: DataFrame, path: str) -> None:
    payload.write.mode("overwrite").text(path)


def read_boundary_json(spark, path: str) -> DataFrame:
    """name, path_pos, points of a stored canvas; one without a positive size or a drawable path is an error."""
    schema = "coordinate_space struct<width: double, height: double, x_origin: double, y_origin: double, units: string, axis: string>, features array<struct<name: string, relationId: bigint, adminLevel: string, paths: array<array<array<double>>>>>"
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("d")).select("d.*")
    if doc.where("coordinate_space.width > 0 and coordinate_space.height > 0 and coordinate_space.axis is not null").limit(1).count() == 0:
        raise ValueError("a canvas needs a positive size and an axis")
    rows = doc.select("coordinate_space.*", F.explode("features").alias("f")).select("width", "height", F.col("x_origin").alias("min_x"), F.col("y_origin").alias("max_y"), "f.name", F.col("f.relationId").alias("relation_id"), F.posexplode("f.paths").alias("path_pos", "p"))
    rows = rows.withColumn("points", F.transform("p", lambda x: F.struct(x[0].alias("x"), x[1].alias("y")))).drop("p").where(F.size("points") >= 2)
    if not rows.limit(1).count():
        raise ValueError("no path can be drawn")
    return rows


def boundary_pixels(canvas: DataFrame, origin: tuple[float, float], height_px: int, pixel: float = 10.0) -> DataFrame:
    """Canvas points (with min_x and max_y of their canvas) in pixels of a graph's grid, y from the north."""
    east, north = origin
    x = lambda p: (F.col("min_x") + p["x"] - east) / pixel
    y = lambda p: (height_px - 1) - (F.col("max_y") - p["y"] - north) / pixel
    return canvas.withColumn("points", F.transform("points", lambda p: F.struct(x(p).alias("x"), y(p).alias("y"))))


def is_closed(points: Column) -> Column:
    return (F.size(points) >= 2) & (F.element_at(points, 1) == F.element_at(points, -1))
