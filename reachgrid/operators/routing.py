"""Travel times, reachability, routes and nearest nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachgrid.functions.costs import edge_cost_seconds, edge_ticks
from reachgrid.functions.numbering import dense_index
from reachgrid.functions.shared import once, stored, written
from reachgrid.operators.overlay import ground_cells, overlay_field

#: Rows up to which a side is broadcast; rounds after which deltas are merged.
SMALL_FRONT, MERGE_EVERY = 100_000, 8
#: Places of nodes in a cell, at most, when nearest nodes are looked for.
CROWD = 64


def mode_edges(edges: DataFrame, mask: int) -> DataFrame:
    """Edges that the modes of ``mask`` may use, with ticks and seconds."""
    rows = edges.select("edge_index", "source_index", "target_index", once(seconds=edge_cost_seconds(mask))).where(F.col("seconds").isNotNull())
    return rows.select("edge_index", "source_index", "target_index", edge_ticks(F.col("seconds")).alias("ticks"), "seconds")


def compact_offsets(edges: DataFrame) -> DataFrame:
    """source_index, first position and number of its edges among ``edges``, in their order."""
    placed = dense_index(edges.select("edge_index", "source_index"), [F.col("source_index"), F.col("edge_index")], "position")
    return placed.groupBy("source_index").agg(F.min("position").alias("first_edge"), F.count("*").alias("edge_count"))


def node_mode_mask(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_index").agg(F.bit_or(F.col("mode_mask").bitwiseAND(7)).alias("mode_mask"))


def eligible_sources(edges: DataFrame, mask: int) -> DataFrame:
    """Nodes with an outgoing edge that ``mask`` may use."""
    return mode_edges(edges, mask).where("ticks > 0").select(F.col("source_index").alias("node_index")).distinct()


def travel_time_fields(edges: DataFrame, sources: DataFrame, masks: list[int], limit_seconds: float | None = None, max_rounds: int = 10_000, cells: DataFrame | None = None) -> DataFrame:
    """source_id, mode_mask, node_index, ticks, seconds: least times from each source for each mask.

    ``sources`` has source_id (a node index). Times are relaxed by joins over an overlay of cells, keyed by source
    and mask, and the graph is never held in one place. ``cells`` (node_index, cell) puts nodes that
    lie together in one cell, as ``overlay.ground_cells`` does; without it runs of indices are cells, which
    gives the same times in more rounds. Unreached nodes have no row.
    """
    limit = None if limit_seconds is None else int(limit_seconds * 1000)
    # One pass over the edges for all masks; seconds are columns first, so that ticks do not work them out again.
    own = edges.select("source_index", "target_index", *[edge_cost_seconds(m).alias(f"_s{m}") for m in masks])
    each = F.array(*[F.struct(F.lit(m).alias("mode_mask"), edge_ticks(F.col(f"_s{m}")).alias("ticks")) for m in masks])
    own = own.select("source_index", "target_index", F.inline(each)).where("ticks > 0")
    own = written(own.groupBy("mode_mask", "source_index", "target_index").agg(F.min("ticks").alias("ticks")), "mode-edges")
    starts = sources.select("source_id").distinct().withColumn("mode_mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    field = _field(own, starts, limit, max_rounds, cells)
    return field.select("source_id", "mode_mask", "node_index", "ticks", (F.col("ticks") / 1000).alias("seconds"))


def travel_time_field(edges: DataFrame, sources: DataFrame, mask: int = 1, limit_seconds: float | None = None, cells: DataFrame | None = None) -> DataFrame:
    return travel_time_fields(edges, sources, [mask], limit_seconds, cells=cells)


def _field(edges: DataFrame, starts: DataFrame, limit: int | None, max_rounds: int, cells: DataFrame | None) -> DataFrame:
    """Least ticks per source, mask and node, by way of cells."""
    return overlay_field(edges, starts, limit, cells, lambda onward, begin, most: _relaxed(onward, begin, most, max_rounds))


def _relaxed(onward: Callable[[DataFrame], DataFrame], starts: DataFrame, limit: int | None, max_rounds: int) -> DataFrame:
    """Least ticks per source, mask, node and cell, from ``starts`` (all but ticks) on.

    ``onward`` gives the times that come of a round's. A round writes improvements only; they are merged every few rounds.
    """
    keys = ["source_id", "mode_mask", "node_index", "cell"]
    front = starts.select(*keys, F.lit(0).cast("long").alias("ticks"))
    # All deltas are read as one table, so that the plan of each round is the same.
    table = lambda paths: front.sparkSession.read.schema(schema).parquet(*paths)
    least = lambda paths: table(paths).groupBy(*keys).agg(F.min("ticks").alias("ticks"))
    schema, known = front.schema, [stored(front, "front")]
    front = table(known)
    size = front.count()
    for turn in range(1, max_rounds + 1):
        if not size:
            return least(known)
        arrived = onward(front)
        if limit is not None:
            arrived = arrived.where(F.col("ticks") <= limit)
        # Known times and arrivals meet in one aggregation.
        none = F.lit(None).cast("long")
        every = table(known).select(*keys, none.alias("ticks"), F.col("ticks").alias("old")).unionByName(arrived.select(*keys, "ticks", none.alias("old")))
        step = every.groupBy(*keys).agg(F.min("ticks").alias("ticks"), F.min("old").alias("old"))
        better = F.col("ticks").isNotNull() & (F.col("old").isNull() | (F.col("ticks") < F.col("old")))
        known.append(stored(step.where(better).select(*keys, "ticks"), "front"))
        front = table(known[-1:])
        size = front.count()
        if turn % MERGE_EVERY == 0:
            known = [stored(least(known), "field")]
    raise RuntimeError(f"times did not settle in {max_rounds} rounds")


def reachable_counts(field: DataFrame) -> DataFrame:
    return field.groupBy("source_id", "mode_mask").agg(F.count("*").alias("settled"))


def reachable_from(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000, cells: DataFrame | None = None) -> DataFrame:
    """source_id, node_index: nodes that each source can get to over any edges, in rounds of cells crossed."""
    steps = edges.select(F.lit(1).alias("mode_mask"), "source_index", "target_index", F.lit(0).cast("long").alias("ticks")).distinct()
    starts = sources.select("source_id", F.lit(1).alias("mode_mask")).distinct()
    return _field(steps, starts, None, max_rounds, cells).select("source_id", "node_index")


def landmark_reachability(edges: DataFrame, landmarks: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """name, unreachable (names in landmark order), all_reachable; ``landmarks``: rank, name, node_index.

    Landmarks are a list that fits a row: each source holds it against the landmarks that it reaches.
    """
    reached = reachable_from(edges, landmarks.select(F.col("node_index").alias("source_id")), cells=cells)
    hits = reached.join(landmarks.select("node_index").distinct(), "node_index", "left_semi").groupBy("source_id").agg(F.collect_set("node_index").alias("_hits"))
    every = landmarks.agg(F.array_sort(F.collect_list(F.struct("rank", "name", "node_index"))).alias("_every"))
    rows = landmarks.join(hits, F.col("node_index") == F.col("source_id"), "left").crossJoin(F.broadcast(every))  # one row
    gone = F.filter("_every", lambda x: (x["node_index"] != F.col("node_index")) & ~F.array_contains("_hits", x["node_index"]))
    rows = rows.select("rank", "name", F.transform(gone, lambda x: x["name"]).alias("unreachable"))
    return rows.withColumn("all_reachable", F.size("unreachable") == 0)


def nearest_nodes(points: DataFrame, nodes: DataFrame, eligible: DataFrame | None = None, cell: float | None = None) -> DataFrame:
    """point_id, node_index, distance_m: nearest node, ties to the lowest index.

    ``points``: point_id, x, y; ``nodes``: node_index, x, y. With ``eligible`` (node_index)
    the nearest of those counts, else the nearest of any. Points go down a pyramid of
    occupied cells: at each level they keep the cells that may hold their nearest node and open those alone,
    so that a far point costs levels, not the empty cells on the way. Points or nodes without coordinates count for nothing.
    """
    if eligible is not None:
        near = written(nearest_nodes(points, nodes.join(eligible, "node_index", "left_semi"), cell=cell), "near-eligible")
        rest = points.join(near, "point_id", "left_anti")
        return near.unionByName(nearest_nodes(rest, nodes, cell=cell)) if rest.limit(1).count() else near
    where = ["point_id", "x", "y"]
    points = points.select(*where).where("x is not null and y is not null")
    # Of nodes at one place only the lowest index can be nearest.
    spots = written(nodes.where("x is not null and y is not null").groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min("node_index").alias("node_index")), "spots")
    box = spots.agg(F.count("*").alias("n"), F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")).first()
    if not box["n"]:
        return points.sparkSession.createDataFrame([], "point_id long, node_index long, distance_m double")
    width, height = float(box["x1"] - box["x0"]), float(box["y1"] - box["y0"])
    # About four nodes to a cell on average; smaller cells where nodes crowd.
    size = float(cell or max(1e-6, (4 * (width + 1) * (height + 1) / box["n"]) ** 0.5))
    at = lambda c, low: F.floor((F.col(c) - F.lit(box[low])) / F.lit(size))
    while True:
        cells = spots.withColumn("_cx", at("_x", "x0")).withColumn("_cy", at("_y", "y0"))
        most = cells.groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0]
        if most <= CROWD or size < 1e-6:
            break
        size /= 16
    levels = int(max(width, height) / size).bit_length()
    tower = written(_pyramid(cells, levels), "pyramid")
    counts = {r["level"]: r["count"] for r in tower.groupBy("level").count().collect()}  # a row a level
    own = Window.partitionBy(*where)
    found = points.withColumn("_px", F.lit(0).cast("long")).withColumn("_py", F.lit(0).cast("long"))
    for level in range(levels, -1, -1):
        side = tower.where(F.col("level") == level).drop("level")
        side = F.broadcast(side) if counts[level] <= SMALL_FRONT else side
        near, sure = _box_bounds()
        held = found.join(side, ["_px", "_py"]).withColumn("_near", near).withColumn("_least", F.min(sure).over(own))
        held = held.where("_near <= _least")
        found = held.select(*where, F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
        if (levels - level) % 4 == 3:
            found = written(found, "nearing")
    d2 = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    last = found.join(cells.withColumnRenamed("_cx", "_px").withColumnRenamed("_cy", "_py"), ["_px", "_py"])
    best = last.groupBy(*where).agg(F.min(F.struct(d2.alias("d2"), "node_index")).alias("_best"))
    return best.select("point_id", "_best.node_index", F.sqrt("_best.d2").alias("distance_m"))


def _pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """Occupied cells of each level (a quarter as many as below, or more), with the box around their nodes and their parent."""
    boxes = cells.groupBy("_cx", "_cy").agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"))
    up = boxes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    lift = lambda c: F.expr(f"shiftright({c}, level)").alias(c)
    up = up.groupBy("level", lift("_cx"), lift("_cy")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    # The top level is one cell, whose parent is itself.
    return up.withColumn("_px", F.shiftright("_cx", 1)).withColumn("_py", F.shiftright("_cy", 1))


def _box_bounds() -> tuple[Column, Column]:
    """Squares of (least distance to a box, distance within which it surely has a node: each side of the box touches one)."""
    x, y, x0, x1, y0, y1 = (F.col(c).cast("double") for c in ("x", "y", "x0", "x1", "y0", "y1"))
    out = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0))
    nearer = lambda v, low, high: F.least(F.abs(v - low), F.abs(v - high))
    farther = lambda v, low, high: F.greatest(F.abs(v - low), F.abs(v - high))
    square = lambda c: c * c
    across = square(nearer(x, x0, x1)) + square(farther(y, y0, y1))
    along = square(farther(x, x0, x1)) + square(nearer(y, y0, y1))
    return square(out(x, x0, x1)) + square(out(y, y0, y1)), F.least(across, along)


def min_cost_per_metre(nodes: DataFrame, edges: DataFrame) -> Column | DataFrame:
    """Least cost per metre over edges of some length; 0 without any."""
    at = lambda end: nodes.select(F.col("node_index").alias(f"{end}_index"), F.col("x_m").alias(f"_{end}x"), F.col("y_m").alias(f"_{end}y"))
    rows = edges.join(at("source"), "source_index").join(at("target"), "target_index")
    metres = F.sqrt(F.pow(F.col("_sourcex") - F.col("_targetx"), 2) + F.pow(F.col("_sourcey") - F.col("_targety"), 2))
    return rows.agg(F.coalesce(F.min(F.when(metres > 0, F.col("cost_seconds") / metres)), F.lit(0.0)).alias("min_cost_per_metre"))


def route_edges(edges: DataFrame) -> DataFrame:
    """source_index, target_index, ticks: least whole seconds between two nodes, without loops."""
    costs = edges.where("source_index != target_index").groupBy("source_index", "target_index").agg(F.min("cost_seconds").cast("long").alias("ticks"))
    return written(costs, "route-edges")


def route_field(costs: DataFrame, starts: DataFrame, limit: int | None = None, max_rounds: int = 10_000, cells: DataFrame | None = None) -> DataFrame:
    """source_id, node_index, ticks over ``route_edges`` from ``starts`` (source_id), as far as ``limit`` whole seconds."""
    field = _field(costs.withColumn("mode_mask", F.lit(1)), starts.select("source_id", F.lit(1).alias("mode_mask")).distinct(), limit, max_rounds, cells)
    return written(field.select("source_id", "node_index", "ticks"), "route-field")


def routes(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_rounds: int = 10_000, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """pair_id, pos, osm_id, cost_seconds of the cheapest walk of each pair; ties take the lowest index before.

    ``pairs``: pair_id, start, goal (osm ids). An unknown id and no way through are errors. ``known``: ``route_edges`` and
    the starts' ``route_field`` where they have been worked out, as far as the goals at least.
    """
    held = pairs
    for end in ("start", "goal"):
        held = held.join(nodes.select(F.col("osm_id").alias(end), F.col("node_index").alias(f"_{end}")), end, "left")
    held = written(held, "route-pairs")
    if unknown := held.where("_start is null or _goal is null").limit(1).collect():
        raise ValueError(f"unknown node in pair {unknown[0]['pair_id']}: {unknown[0]['start']}, {unknown[0]['goal']}")
    if known is None:
        costs = route_edges(edges)
        cells = written(ground_cells(nodes), "cells") if {"x_m", "y_m"} <= set(nodes.columns) else None
        known = costs, route_field(costs, held.select(F.col("_start").alias("source_id")), None, max_rounds, cells)
    costs, field = known
    goals = held.select("pair_id", "start", "goal", F.col("_start").alias("source_id"), F.col("_goal").alias("node_index"))
    if lost := goals.join(field, ["source_id", "node_index"], "left_anti").limit(1).collect():
        raise ValueError(f"no way from {lost[0]['start']} to {lost[0]['goal']}")
    # Edges that lie on a cheapest way, one before each node and source; followed back from the goals.
    into = costs.join(field.select("source_id", F.col("node_index").alias("source_index"), F.col("ticks").alias("_from")), "source_index")
    into = into.join(field.select("source_id", F.col("node_index").alias("target_index"), F.col("ticks").alias("_to")), ["source_id", "target_index"])
    before = written(into.where("_from + ticks = _to").groupBy("source_id", "target_index").agg(F.min("source_index").alias("source_index")), "route-before")
    # Doubling: who is 2^k steps before; a goal's ancestors of all steps come from those.
    keys = ["source_id", "node_index"]
    back = written(goals.select("pair_id", *keys, F.lit(0).alias("back")), "route")
    jump, reach = before.select("source_id", F.col("target_index").alias("node_index"), F.col("source_index").alias("_up")), 1
    while True:
        more = back.join(jump, keys).select("pair_id", "source_id", F.col("_up").alias("node_index"), (F.col("back") + reach).alias("back"))
        more = written(more, "route")
        if not more.limit(1).count():
            break
        back = written(back.unionByName(more), "route")
        upper = jump.select("source_id", F.col("node_index").alias("_up"), F.col("_up").alias("_upper"))
        jump, reach = written(jump.join(upper, ["source_id", "_up"]).select(*keys, F.col("_upper").alias("_up")), "route-jump"), reach * 2
    rows = back.join(field, keys).join(nodes.select("node_index", "osm_id"), "node_index")
    pos = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("back"))) - 1  # the nodes of one route
    return rows.select("pair_id", pos.alias("pos"), "osm_id", F.col("ticks").alias("cost_seconds"))


def route(nodes: DataFrame, edges: DataFrame, start: int, goal: int, max_rounds: int = 10_000, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """pos, osm_id, cost_seconds of the cheapest walk between two osm ids, as ``routes`` finds it."""
    pair = nodes.sparkSession.createDataFrame([(0, start, goal)], "pair_id int, start long, goal long")
    return routes(nodes, edges, pair, max_rounds, known).drop("pair_id")
