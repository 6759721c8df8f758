"""Times over large graphs by cells.

Nodes are dealt to cells of bounded size that lie together on the ground. Times enter a cell at
entries (nodes that an edge from another cell leads to, and sources). A round opens only the cells
in which entries have become earlier: one task a cell takes those times to the cell's exits, and
a join over the edges between cells takes them on to the next entries. Rounds go with cells
crossed, not hops, and cells that no time gets to cost nothing but a scan. One grouping by cell then
takes the times of entries down to all nodes within.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.numbering import dense_index
from reachgrid.functions.shared import small_side, written

#: Nodes of a cell, and sources that one task takes down into a cell, about.
PER_CELL, PER_BUCKET = 8192, 128
#: Sources whose times are held at once.
_BLOCK = 256
_FAR = np.iinfo(np.int64).max // 4
NODE = ["source_id", "mode_mask", "node_index", "ticks"]


def z_order(x: Column, y: Column) -> Column:
    """Bits of two whole numbers from 0 to 2^31 in turns, so that near points have near values."""

    def spread(c: Column) -> Column:
        for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, step)).bitwiseAND(F.lit(mask))
        return c

    whole = lambda c: F.greatest(F.lit(0), F.least(F.lit(2**31 - 1), c)).cast("long")
    return spread(whole(x)).bitwiseOR(F.shiftleft(spread(whole(y)), 1))


def ground_cells(nodes: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """node_index and cell: runs of ``per_cell`` nodes (x_m, y_m) in the order of a space-filling curve."""
    placed = dense_index(nodes.select("node_index", z_order(F.col("x_m"), F.col("y_m")).alias("_z")), [F.col("_z"), F.col("node_index")], "_place")
    return placed.select("node_index", F.floor(F.col("_place") / per_cell).alias("cell"))


def _with_cell(rows: DataFrame, node: str, cells: DataFrame | None, name: str) -> DataFrame:
    """``rows`` with the cell of ``node``; without ``cells``, and for nodes not in it, a run of indices is a cell."""
    run = -1 - F.floor(F.col(node) / PER_CELL)
    if cells is None:
        return rows.withColumn(name, run)
    held = rows.join(cells.select(F.col("node_index").alias(node), F.col("cell").alias("_cell")), node, "left")
    return held.withColumn(name, F.coalesce("_cell", run)).drop("_cell")


def _settled(sources: np.ndarray, targets: np.ndarray, ticks: np.ndarray, known: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Least times per column of ``known`` (nodes by columns) over edges between places.

    Edges out of the places whose time fell in the last turn are taken, until none falls; times over ``limit`` go no further.
    """
    order = np.argsort(sources, kind="stable")
    sources, targets, ticks = sources[order], targets[order].astype(np.int64), ticks[order]
    first = np.searchsorted(sources, np.arange(len(known) + 1))
    often, most = np.diff(first), _FAR - 1 if limit is None else limit
    for at in range(0, known.shape[1], _BLOCK):
        some = np.ascontiguousarray(known[:, at : at + _BLOCK])
        width, flat = some.shape[1], some.reshape(-1)
        front = np.flatnonzero(flat <= most)
        while len(front):
            node, column = np.divmod(front, width)
            n = often[node]
            edge = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            to, time = targets[edge] * width + np.repeat(column, n), np.repeat(flat[front], n) + ticks[edge]
            better = (time < flat[to]) & (time <= most)
            to = to[better]
            np.minimum.at(flat, to, time[better])
            front = np.unique(to)
        known[:, at : at + _BLOCK] = some
    return known


# Rows of a cell's task: an edge (from a to b), a seed (at a), an exit (at a).
_EDGE, _ENTRY, _EXIT = 0, 1, 2


def _places(frame: pd.DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes of the cell, its edges by their places)."""
    kind = frame["kind"].to_numpy()
    a, b = frame["a"].to_numpy(), frame["b"].to_numpy()
    nodes = np.unique(np.concatenate([a, b[kind == _EDGE]]))
    inner = kind == _EDGE
    return nodes, (np.searchsorted(nodes, a[inner]), np.searchsorted(nodes, b[inner]), frame["ticks"].to_numpy()[inner])


def _down(limit: int | None, exits: bool = False) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Times of a cell's nodes, or of its ``exits`` alone, from its seeds."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, edges = _places(frame)
        seeds = frame[frame["kind"] == _ENTRY]
        who = seeds["source_id"].to_numpy(np.int64)
        every, row = np.unique(who, return_inverse=True)
        known = np.full((len(nodes), len(every)), _FAR, dtype=np.int64)
        np.minimum.at(known, (np.searchsorted(nodes, seeds["a"].to_numpy()), row), seeds["ticks"].to_numpy())
        times = _settled(*edges, known, limit)
        if exits:
            out = np.unique(frame["a"].to_numpy()[frame["kind"].to_numpy() == _EXIT])
            nodes, times = out, times[np.searchsorted(nodes, out)]
        times = times.T
        row, column = np.nonzero(times <= (_FAR - 1 if limit is None else limit))
        mask = frame["mode_mask"].iat[0]
        return pd.DataFrame({"source_id": every[row], "mode_mask": np.full(len(row), mask, np.int32), "node_index": nodes[column], "ticks": times[row, column]})

    return run


_CELL = ["mode_mask", "cell"]


def _opened(seeds: DataFrame, ways: DataFrame, limit: int | None, exits: bool = False) -> DataFrame:
    """source_id, mode_mask, node_index, ticks in the cells of written ``seeds`` (the same and cell), by tasks of one cell each.

    ``ways``: mode_mask, cell, kind, a, b, ticks of all cells. Sources are dealt into buckets by how many
    come to the cell, so that no task holds more than some sources, and few sources open a cell once.
    """
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A sketch of the number is enough: it only sets how many buckets there are.
    come = seeds.groupBy(*_CELL).agg(F.ceil(F.approx_count_distinct("source_id") / PER_BUCKET).cast("int").alias("_buckets"))
    come = small_side(written(come, "opened"))
    held = seeds.join(come, _CELL).withColumn("_bucket", F.pmod(F.xxhash64("source_id"), F.col("_buckets")))
    columns = ["mode_mask", "cell", "kind", "a", "b", "ticks"]
    down = held.select("mode_mask", "cell", F.lit(_ENTRY).alias("kind"), F.col("node_index").alias("a"), F.col("node_index").alias("b"), "ticks", "source_id", "_bucket")
    each = ways.join(come, _CELL).select(*columns, F.lit(None).cast("long").alias("source_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_buckets").cast("long") - 1)).alias("_bucket"))
    # A cell is much work for few bytes: cells stay dealt over all tasks.
    return each.unionByName(down).repartition(parts, *_CELL, "_bucket").groupBy(*_CELL, "_bucket").applyInPandas(_down(limit, exits), "source_id long, mode_mask int, node_index long, ticks long")


def overlay_field(edges: DataFrame, starts: DataFrame, limit: int | None, cells: DataFrame | None, relaxed: Callable[[Callable[[DataFrame], DataFrame], DataFrame, int | None], DataFrame]) -> DataFrame:
    """source_id, mode_mask, node_index, ticks: least times from ``starts`` (source_id, mode_mask).

    ``edges``: mode_mask, source_index, target_index, ticks. ``relaxed`` takes times from entries to entries in rounds,
    by a function from a round's times to those that come of them. Starts count as entries of their cells.
    """
    held = _with_cell(_with_cell(edges.withColumn("mode_mask", F.col("mode_mask").cast("int")), "source_index", cells, "_from"), "target_index", cells, "_to")
    held = written(held, "cell-edges")
    inner, cross = held.where("_from = _to"), held.where("_from != _to")
    starts = written(_with_cell(starts.select("source_id", F.col("mode_mask").cast("int").alias("mode_mask"), F.col("source_id").alias("node_index")), "node_index", cells, "cell"), "starts")
    row = lambda kind, b, ticks: ["mode_mask", F.col("_from").alias("cell"), F.lit(kind).alias("kind"), F.col("source_index").cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.lit(ticks).cast("long").alias("ticks") if ticks is not None else F.col("ticks").cast("long").alias("ticks")]
    within = inner.select(*row(_EDGE, "target_index", None))
    crossing = within.unionByName(cross.select(*row(_EXIT, "source_index", 0)).distinct())
    steps = written(cross.select("mode_mask", F.col("source_index").alias("node_index"), F.col("target_index").alias("_next"), F.col("_to").alias("_cell"), F.col("ticks").alias("_step")), "cell-steps")

    def onward(front: DataFrame) -> DataFrame:
        """Times of entries that come of ``front`` (NODE and cell), through its cells and over one edge out of them."""
        out = _opened(front, crossing, limit, exits=True)
        return out.join(steps, ["mode_mask", "node_index"]).select("source_id", "mode_mask", F.col("_next").alias("node_index"), (F.col("ticks") + F.col("_step")).alias("ticks"), F.col("_cell").alias("cell"))

    entries = relaxed(onward, starts.select("source_id", "mode_mask", "node_index", "cell"), limit)
    return _opened(written(entries, "seeds"), within, limit).select(*NODE)
