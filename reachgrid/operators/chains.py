"""Chains of pass-through nodes merged where their edges lie.

Edges of a way mostly lie side by side. They are taken in blocks, each of which is a row of packed columns. One exchange of node ids tells
the nodes that more than one block meets; chains of the others are walked within their block, from both ends.

What a block cannot settle is left as it is: nodes that several blocks meet, rings, chains that come back to where they
began, parallel edges on the way, chains over the cost limit and those that no mode can go all along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.shared import small_side, written

#: Edges of a block, about, and megabytes of a row group of blocks.
BLOCK, GROUP_MB = 50_000, 16
COLUMNS = ["source_index", "target_index", "flags", "mode_mask", "maxspeed_kph", "road_class_id", "cost_seconds"]
FREE = ["source_free", "target_free"]


def _cut(source: np.ndarray, target: np.ndarray) -> int:
    """Last place where an edge has no end in common with the one before it; all of them, if there is none."""
    apart = np.ones(max(0, len(source) - 1), dtype=bool)
    for a in (source, target):
        for b in (source, target):
            apart &= a[1:] != b[:-1]
    found = np.flatnonzero(apart)
    return int(found[-1]) + 1 if len(found) else len(source)


def edge_blocks(edges: DataFrame, free: Callable[[str], Column] | None = None) -> DataFrame:
    """Written rows of ``block`` and its edges, with whether each end may go at all (``free``, a condition on its index).

    A column of a block is the bytes of its values, longs but for the two flags: arrays would be taken apart value by value.
    """
    test = free or (lambda _: F.lit(True))
    rows = edges.select(*[F.col(c).cast("long") for c in COLUMNS], test("source_index").alias("source_free"), test("target_index").alias("target_free"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def row(table: pa.Table) -> pa.RecordBatch:
            packed = [pa.array([c.to_numpy().tobytes()], pa.binary()) for c in table.columns]
            return pa.RecordBatch.from_arrays([pa.array([first + done], pa.int64()), *packed], names=["block", *table.column_names])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                table = pa.Table.from_batches(held)
                at = _cut(table.column(0).to_numpy(), table.column(1).to_numpy())
                yield row(table.slice(0, at))
                done, held, n = done + 1, table.slice(at).to_batches(), n - at
        if n:
            yield row(pa.Table.from_batches(held))

    return written(rows.mapInArrow(gather, "block long, " + ", ".join(f"{c} binary" for c in rows.columns)), "edge-blocks", GROUP_MB)


def _unpacked(batch: pa.RecordBatch, row: int, columns: list[str]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(batch.column(c)[row].as_buffer(), dtype=bool if c in FREE else np.int64) for c in columns}


def _free(block: dict[str, np.ndarray]) -> np.ndarray:
    """The nodes of an unpacked block that may go, sorted."""
    return np.unique(np.concatenate([block["source_index"][block["source_free"]], block["target_index"][block["target_free"]]]))


def _open_nodes(blocks: DataFrame) -> DataFrame:
    """node, block: the nodes that may go and the blocks that meet them."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                node = _free(_unpacked(batch, row, [*COLUMNS[:2], *FREE]))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(len(node), batch.column(0)[row].as_py()))], names=["node", "block"])

    return blocks.select("block", *COLUMNS[:2], *FREE).mapInArrow(nodes, "node long, block long")


def walked(edges: dict[str, np.ndarray], free: np.ndarray, limit: int) -> dict[str, np.ndarray]:
    """The edges of a block once its chains are merged; ``free``: the nodes, sorted, that may go and that no other block meets."""
    m = len(edges["source_index"])
    names, at = np.unique(np.concatenate([edges["source_index"], edges["target_index"]]), return_inverse=True)
    u, v, n = at[:m], at[m:], len(names)
    real = np.flatnonzero(u != v)
    pair, p = np.unique(np.minimum(u, v)[real] * n + np.maximum(u, v)[real], return_inverse=True)
    # Each pair of neighbours has two sides, from the lesser node and from the greater one; turned round, a side's last bit changes.
    side = 2 * p + (u > v)[real]
    tail = np.stack([pair // n, pair % n], axis=1).ravel()
    head = np.stack([pair % n, pair // n], axis=1).ravel()
    edge = np.full(len(tail), -1)
    edge[side] = real
    goes, comes, many = (np.zeros(n, dtype=bool) for _ in range(3))
    goes[u[real]] = comes[v[real]] = True
    twice = np.bincount(side, minlength=len(tail)) > 1
    many[tail[twice]] = many[head[twice]] = True
    may = np.isin(names, free, assume_unique=True) & (np.bincount(tail, minlength=n) == 2) & goes & comes & ~many
    # Of the two sides out of a node that may go, the other one goes on.
    both = np.bincount(tail, weights=np.arange(len(tail)), minlength=n).astype(np.int64)
    start = np.flatnonzero(~may[tail] & may[head])
    chains = len(start)
    hops, there, cost, dear, flags = (np.zeros(chains, dtype=np.int64) for _ in range(5))
    mask, speed, last = np.full(chains, -1), np.full(chains, np.iinfo(np.int64).max), start.copy()
    low, high = np.full(chains, np.iinfo(np.int64).max), np.full(chains, -1)
    price = np.append(edges["cost_seconds"].astype(np.int64), 0)
    inner, owner = [], []
    chain, on = np.arange(chains), start
    while len(chain):
        has = edge[on] >= 0
        c, e = chain[has], edge[on][has]
        there[c] += 1
        cost[c] += price[e]
        flags[c] |= edges["flags"][e]
        mask[c] &= edges["mode_mask"][e]
        kph = edges["maxspeed_kph"][e]
        speed[c] = np.minimum(speed[c], np.where(kph > 0, kph, speed[c]))
        low[c], high[c] = np.minimum(low[c], edges["road_class_id"][e]), np.maximum(high[c], edges["road_class_id"][e])
        hops[chain] += 1
        dear[chain] += np.maximum(price[edge[on]], price[edge[on ^ 1]])
        last[chain] = on
        further = may[head[on]]
        chain, on = chain[further], on[further]
        inner.append(head[on])
        owner.append(chain)
        on = both[head[on]] - (on ^ 1)
    first = np.full(len(tail), -1)
    first[start] = np.arange(chains)
    made = (there == hops) & (mask != 0)
    merged = (made | made[first[last ^ 1]]) & (dear <= limit) & (tail[start] != head[last])
    gone = np.zeros(n, dtype=bool)
    if chains:
        gone[np.concatenate(inner)[merged[np.concatenate(owner)]]] = True
    left, new = ~(gone[u] | gone[v]), made & merged
    made_of = {
        "source_index": names[tail[start]], "target_index": names[head[last]], "flags": flags, "mode_mask": mask,
        "maxspeed_kph": np.where(speed == np.iinfo(np.int64).max, 0, speed), "road_class_id": np.where(low == high, low, 0), "cost_seconds": cost,
    }
    return {c: np.concatenate([edges[c][left], made_of[c][new].astype(edges[c].dtype)]) for c in COLUMNS}


def merged_in_blocks(blocks: DataFrame, protected: DataFrame, limit: int, free: Callable[[str], Column] | None = None) -> DataFrame:
    """Edges of written ``blocks`` once the chains within each are merged; ``protected``: the nodes (node) that stay. Merged nodes have no edge left."""
    test = free or (lambda _: F.lit(True))
    own = _open_nodes(blocks)
    met = own.unionByName(protected.where(test("node")).select("node", F.lit(-1).cast("long").alias("block")))
    kept = written(met.groupBy("node").agg(F.min("block").alias("_low"), F.max("block").alias("_high")).where("_low < _high").select("node"), "kept-nodes")
    # Each block gets the nodes of its own that must stay.
    lists = written(own.join(small_side(kept), "node", "left_semi").groupBy("block").agg(F.collect_list("node").alias("kept")), "kept-lists")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                edges = _unpacked(batch, row, [*COLUMNS, *FREE])
                may, stay = _free(edges), batch.column("kept")[row].values
                left = walked(edges, may if stay is None else np.setdiff1d(may, stay.to_numpy(), assume_unique=True), limit)
                yield pa.RecordBatch.from_arrays([pa.array(left[c]) for c in COLUMNS], names=COLUMNS)

    return blocks.join(lists, "block", "left").select(*COLUMNS, *FREE, "kept").mapInArrow(walk, ", ".join(f"{c} long" for c in COLUMNS))
