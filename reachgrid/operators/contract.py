"""Contraction of pass-through nodes.

Chains of nodes with one edge per neighbour and direction, which is nearly all there are, are
merged at once: pointer doubling gives every node its distance to both ends of its chain in as
many rounds as its length has bits, and the edges along a chain are folded in one aggregation.
A chain that costs more than an edge may is cut into pieces by the running cost.

What is left over (parallel edges, rings, pieces that may not be merged whole) goes by rounds, each of which
takes an independent set of the nodes that may be merged: those whose hash is least among neighbouring ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.costs import MAX_COST
from reachgrid.functions.numbering import dense_index
from reachgrid.functions.shared import released, small_side, written
from reachgrid.functions.tags import PROTECTED_FLAG
from reachgrid.operators import chains
from reachgrid.operators.adjacency import EDGE_KEY


def protect_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``nodes`` with the protected flag on those whose osm_id is in ``ids``."""
    held = nodes.join(ids.select("osm_id", F.lit(True).alias("_held")).distinct(), "osm_id", "left")
    return held.withColumn("flags", F.when(F.col("_held"), F.col("flags").bitwiseOR(PROTECTED_FLAG)).otherwise(F.col("flags"))).select(*nodes.columns)


def merge_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, low, high: unprotected nodes with exactly two neighbours, an edge in and an edge out."""
    return _candidates_of(protected_nodes(nodes), neighbour_pairs(edges))


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """node, near, o, i: each node's neighbours, and whether an edge goes out to them and comes in; far fewer than edges."""
    ends = edges.where("source_index != target_index")
    out = ends.select(F.col("source_index").alias("node"), F.col("target_index").alias("near"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = ends.select(F.col("target_index").alias("node"), F.col("source_index").alias("near"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("node", "near").agg(F.max("o").alias("o"), F.max("i").alias("i"))


def protected_nodes(nodes: DataFrame) -> DataFrame:
    """node: those that must stay."""
    return nodes.where(F.col("flags").bitwiseAND(PROTECTED_FLAG) != 0).select(F.col("node_index").alias("node"))


def _candidates_of(protected: DataFrame, pairs: DataFrame) -> DataFrame:
    """``merge_candidates`` from neighbour pairs, each there once."""
    found = pairs.groupBy("node").agg(F.count("*").alias("n"), F.min("near").alias("low"), F.max("near").alias("high"), F.max("o").alias("o"), F.max("i").alias("i"))
    return found.where("n = 2 and o = 1 and i = 1").select("node", "low", "high").join(protected, "node", "left_anti")


def merge_plan(candidates: DataFrame, edges: DataFrame, limit: int = MAX_COST) -> DataFrame:
    """node and the edges that take its place; a pair over ``limit``, or no edge, keeps the node."""
    data = ["cost_seconds", "flags", "mode_mask", "maxspeed_kph", "road_class_id"]
    loops = edges.where("source_index != target_index")
    into = loops.select(F.col("target_index").alias("node"), F.col("source_index").alias("source"), *[F.col(c).alias(f"i_{c}") for c in data])
    out = loops.select(F.col("source_index").alias("node"), F.col("target_index").alias("target"), *[F.col(c).alias(f"o_{c}") for c in data])
    keys = candidates.select("node")
    pairs = into.join(keys, "node", "left_semi").join(out.join(keys, "node", "left_semi"), "node").where("source != target")
    cost = F.col("i_cost_seconds") + F.col("o_cost_seconds")
    slow = F.least(*[F.when(F.col(c) > 0, F.col(c)) for c in ("i_maxspeed_kph", "o_maxspeed_kph")])
    rows = pairs.select(
        "node", F.col("source").alias("source_index"), F.col("target").alias("target_index"), cost.alias("cost_seconds"),
        F.col("i_flags").bitwiseOR(F.col("o_flags")).alias("flags"), F.col("i_mode_mask").bitwiseAND(F.col("o_mode_mask")).alias("mode_mask"),
        F.coalesce(slow, F.lit(0)).alias("maxspeed_kph"), F.when(F.col("i_road_class_id") == F.col("o_road_class_id"), F.col("i_road_class_id")).otherwise(0).alias("road_class_id"),
    )
    per = rows.groupBy("node", *EDGE_KEY).agg(F.min("cost_seconds").alias("cost_seconds"), F.max("cost_seconds").alias("_most"))
    vetoed = per.where(F.col("_most") > limit).select("node").distinct()
    return per.where("mode_mask != 0").drop("_most").join(vetoed, "node", "left_anti")


def chain_ranks(links: DataFrame) -> DataFrame:
    """From links (u, v, w: from u through the chain's node v on to w; hop: cost of v to w) to the far ends.

    u, v, hop, last and end (the chain's last node that way and the node that ends it), steps and cost from v to the end.
    Each round a link looks as far ahead as it and the link that it sees do together. Rings have no end and no row.
    """
    ends = links.select(F.col("v").alias("w")).distinct().withColumn("_on", F.lit(True))
    rows = links.join(ends, "w", "left").select("u", "v", "hop", F.col("v").alias("last"), F.col("w").alias("end"), F.lit(1).cast("long").alias("steps"), F.col("hop").alias("cost"), F.col("_on").isNull().alias("done"))
    rows = written(rows, "chain-links")
    left = n = rows.where("not done").count()
    for _ in range(n.bit_length() + 1):
        if not left:
            break
        ahead = rows.select(F.col("u").alias("last"), F.col("v").alias("end"), F.col("last").alias("_last"), F.col("end").alias("_end"), F.col("steps").alias("_steps"), F.col("cost").alias("_cost"), F.col("done").alias("_done"))
        more = rows.where("not done").join(ahead, ["last", "end"])
        more = more.select("u", "v", "hop", F.col("_last").alias("last"), F.col("_end").alias("end"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("cost") + F.col("_cost")).alias("cost"), F.col("_done").alias("done"))
        longer = written(rows.where("done").unionByName(more), "chain-links")
        released(rows)
        rows = longer
        left = rows.where("not done").count()
    return rows.where("done").drop("done")


def merge_chains(candidates: DataFrame, edges: DataFrame, limit: int = MAX_COST) -> tuple[DataFrame, DataFrame]:
    """(node: those merged away, the edges that take their place) of chains with one edge per neighbour and direction.

    A piece is merged if the costs along it, dearer directions taken, stay within ``limit`` and some mode can go along it
    in some direction; then the order in which its nodes are merged makes no difference.
    """
    pairs = edges.where("source_index != target_index").groupBy("source_index", "target_index")
    pairs = written(pairs.agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("cost_seconds", "flags", "mode_mask", "maxspeed_kph", "road_class_id")]), "hops")
    many = pairs.where("n > 1").select(F.explode(F.array("source_index", "target_index")).alias("node")).distinct()
    plain = candidates.join(many, "node", "left_anti")
    way = lambda a, b: F.struct(F.col(a).alias("u"), F.col("node").alias("v"), F.col(b).alias("w"))
    links = plain.select(F.explode(F.array(way("low", "high"), way("high", "low"))).alias("l")).select("l.*")
    dearer = pairs.select(F.least("source_index", "target_index").alias("_a"), F.greatest("source_index", "target_index").alias("_b"), "cost_seconds").groupBy("_a", "_b").agg(F.max("cost_seconds").alias("hop"))
    links = links.withColumn("_a", F.least("v", "w")).withColumn("_b", F.greatest("v", "w")).join(dearer, ["_a", "_b"]).select("u", "v", "w", "hop")
    ranks = chain_ranks(links)
    # The chain is named by its lesser end; each node knows the way to both.
    sides = ranks.select("v", F.struct("last", "end", "u", "hop", "steps", "cost").alias("side")).groupBy("v").agg(F.min("side").alias("head"), F.max("side").alias("tail"))
    half = limit // 2
    whole = F.col("head.cost") + F.col("tail.cost") <= limit
    piece = lambda cost: F.when(whole, 0).otherwise(F.floor(cost / half))
    # A chain that comes back to where it began keeps its last node.
    keeps = (F.col("tail.steps") == 1) & (F.col("head.end") == F.col("tail.end"))
    on = sides.select(
        F.struct("head.last", "head.end").alias("chain"), "v", F.col("head.steps").alias("pos"), F.col("tail.u").alias("before"), piece(F.col("head.cost")).alias("piece"), "tail", keeps.alias("keeps"),
        F.when(keeps, -1).otherwise(piece(F.col("head.cost") + F.col("tail.hop"))).alias("next_piece"),
    )
    on = written(on.withColumn("stays", F.col("piece") != F.col("next_piece")), "chain-nodes")
    released(ranks)
    hops = on.select("chain", "piece", "pos", F.col("before").alias("a"), F.col("v").alias("b"))
    hops = hops.unionByName(on.where("tail.steps = 1").select("chain", F.col("next_piece").alias("piece"), (F.col("pos") + 1).alias("pos"), F.col("v").alias("a"), F.col("tail.end").alias("b")))
    turned = lambda back, a, b: F.struct(F.lit(back).alias("back"), F.col(a).alias("source_index"), F.col(b).alias("target_index"))
    both = F.array(turned(0, "a", "b"), turned(1, "b", "a"))
    steps = hops.withColumn("d", F.explode(both)).select("chain", "piece", "pos", "a", "b", "d.*").join(pairs, ["source_index", "target_index"], "left")
    same = F.when((F.min("road_class_id") == F.max("road_class_id")) & (F.count("*") == F.count("n")), F.min("road_class_id")).otherwise(0)
    fold = [
        F.count("*").alias("hops"), F.count("n").alias("open"), F.sum("cost_seconds").alias("cost_seconds"), F.bit_or("flags").alias("flags"), F.bit_and("mode_mask").alias("mode_mask"),
        F.coalesce(F.min(F.when(F.col("maxspeed_kph") > 0, F.col("maxspeed_kph"))), F.lit(0)).alias("maxspeed_kph"), same.alias("road_class_id"), F.min_by("a", "pos").alias("a"), F.max_by("b", "pos").alias("b"),
    ]
    folded = written(steps.groupBy("chain", "piece", "back").agg(*fold), "chain-folds")
    made = folded.where("hops > 1 and open = hops and mode_mask != 0")
    dear = steps.groupBy("chain", "piece", "pos").agg(F.max("cost_seconds").alias("c")).groupBy("chain", "piece").agg(F.sum("c").alias("c")).where(F.col("c") > limit)
    made = made.join(dear, ["chain", "piece"], "left_anti")
    merged = on.where("not stays").join(made.select("chain", "piece").distinct(), ["chain", "piece"], "left_semi").select(F.col("v").alias("node"))
    ends = lambda x, y, name: F.when(F.col("back") == 0, F.col(x)).otherwise(F.col(y)).alias(name)
    return merged, made.select(ends("a", "b", "source_index"), ends("b", "a", "target_index"), "flags", "mode_mask", "maxspeed_kph", "road_class_id", "cost_seconds")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for end in ("source_index", "target_index"):
        edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return edges


def _touching(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges with a candidate at an end; few candidates are broadcast, so that edges are read in place."""
    on = small_side(candidates.select("node"))
    for end in ("source_index", "target_index"):
        edges = edges.join(on.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    return edges.where("_source_index or _target_index").drop("_source_index", "_target_index").select(*EDGE_KEY, "cost_seconds")


def contract_chains(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200, limit: int = MAX_COST) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without pass-through nodes, dense indices anew. Regions go together: their graphs do not touch."""
    return _reindexed(*merged_graph(nodes, edges, max_rounds, limit), limit)


def merged_graph(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200, limit: int = MAX_COST) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without pass-through nodes under the indices that they had; of equal edges all may be there."""
    removed, edges = merged_edges(protected_nodes(nodes), edges, max_rounds, limit)
    return nodes.join(removed, nodes["node_index"] == removed["node"], "left_anti"), edges


def merged_edges(
    protected: DataFrame, edges: DataFrame, max_rounds: int = 200, limit: int = MAX_COST, blocks: bool = False, free: Callable[[str], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(node: those merged away, edges) where the nodes ``protected`` (node) stay.

    With ``blocks`` chains of which all edges lie side by side are merged there first; their nodes are not among those
    returned, as no edge is left to tell of them. ``free``: a condition on an index that all nodes that may go meet.
    """
    columns = [*EDGE_KEY, "cost_seconds"]
    if blocks:
        parts = chains.edge_blocks(edges, free)
        edges = written(chains.merged_in_blocks(parts, protected, limit, free).select(*[F.col(c).cast(edges.schema[c].dataType) for c in columns]), "contracting")
        released(parts)
    else:
        edges = written(edges.select(*columns), "contracting")
    of_free = lambda pairs: pairs if free is None else pairs.where(free("node"))
    candidates = written(_candidates_of(protected, of_free(neighbour_pairs(edges))), "candidates")
    if not candidates.limit(1).count():
        return candidates.select("node"), edges
    removed, new = merge_chains(candidates, _touching(edges, candidates), limit)
    removed = written(removed, "removed")
    if removed.limit(1).count():
        left = written(_without(edges, removed).select(*columns).unionByName(new.select(*columns)), "contracting")
        released(edges, new, candidates)
        edges = left
    # Rounds change little: edges are written once, and only neighbour pairs, nodes gone and edges made since go from round to round.
    pairs, gone, made = written(of_free(neighbour_pairs(edges)), "neighbours"), removed.limit(0), edges.limit(0)
    for turn in range(max_rounds):
        candidates = written(_candidates_of(protected, pairs), "candidates")
        if not candidates.limit(1).count():
            return removed, _without(edges, gone).select(*columns).unionByName(made) if turn else edges
        touching = written(_without(_touching(edges, candidates), gone).select(*columns).unionByName(_touching(made, candidates)), "touching")
        plan = written(merge_plan(candidates, touching, limit), "plan")
        ready = candidates.join(plan.select("node").distinct(), "node", "left_semi")
        # A hash that changes each turn, told apart by the index.
        rank = F.struct(F.xxhash64("node", F.lit(turn)), "node")
        ranked = written(ready.withColumn("rank", rank), "ready")
        if not ranked.limit(1).count():
            return removed, _without(edges, gone).select(*columns).unionByName(made) if turn else edges
        near = ranked.select(F.col("node").alias("near"), F.col("rank").alias("near_rank"))
        sides = ranked.select("node", "rank", F.explode(F.array("low", "high")).alias("near")).join(near, "near", "left")
        beaten = sides.where(F.col("near_rank") < F.col("rank")).select("node").distinct()
        chosen = written(ranked.select("node").join(beaten, "node", "left_anti"), "chosen")
        new = written(plan.join(chosen, "node", "left_semi").select(*columns), "new-edges")
        made = written(_without(made, chosen).select(*columns).unionByName(new), "made-edges")
        kept = pairs.join(chosen, "node", "left_anti").join(chosen.select(F.col("node").alias("near")), "near", "left_anti").select("node", "near", "o", "i")
        kept = kept.unionByName(of_free(neighbour_pairs(new))).groupBy("node", "near").agg(F.max("o").alias("o"), F.max("i").alias("i"))
        left = written(kept, "neighbours")
        released(pairs, touching)
        pairs = left
        gone = written(gone.unionByName(chosen), "gone")
        removed = written(removed.unionByName(chosen), "removed")
    raise RuntimeError(f"contraction did not end in {max_rounds} rounds")


def least_edges(edges: DataFrame, limit: int = MAX_COST) -> DataFrame:
    """One edge per key with the least cost, at most ``limit``."""
    return edges.groupBy(*EDGE_KEY).agg(F.least(F.min("cost_seconds"), F.lit(limit)).alias("cost_seconds"))


def _reindexed(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Dense indices of what is left; one edge per key with the least cost."""
    kept = dense_index(nodes.drop("first_edge_index", "edge_count"), [F.col("node_index")], "_new")
    ids = kept.select("node_index", "_new", "region_id")
    rows = least_edges(edges, limit)
    rows = rows.join(ids.select(F.col("node_index").alias("source_index"), F.col("_new").alias("_source"), "region_id"), "source_index")
    rows = rows.join(ids.select(F.col("node_index").alias("target_index"), F.col("_new").alias("_target")), "target_index")
    rows = rows.drop("source_index", "target_index").withColumnsRenamed({"_source": "source_index", "_target": "target_index"})
    rows = dense_index(rows, [F.col(c) for c in EDGE_KEY], "edge_index")
    out = rows.groupBy("source_index").agg(F.min("edge_index").alias("first_edge_index"), F.count("*").alias("edge_count"))
    kept = kept.drop("node_index").withColumnRenamed("_new", "node_index")
    kept = kept.join(out, kept["node_index"] == out["source_index"], "left").drop("source_index").fillna(0, ["first_edge_index", "edge_count"])
    return kept, rows.select("region_id", "edge_index", "source_index", "target_index", "cost_seconds", "flags", "mode_mask", "maxspeed_kph", "road_class_id")


def simplify_summary(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    row = count(before[0], "nodes_before")
    for df, name in ((before[1], "edges_before"), (after[0], "nodes_after"), (after[1], "edges_after")):
        row = row.crossJoin(count(df, name))  # one row each
    return row.withColumn("merged", F.col("nodes_before") - F.col("nodes_after"))
