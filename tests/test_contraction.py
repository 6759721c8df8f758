"""Contraction of chains against what it must keep, and against one node at a time."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reachgrid.operators import contract

NODES = "region_id string, node_index long, osm_id long, x_m int, y_m int, flags int"
EDGES = "source_index long, target_index long, cost_seconds long, flags int, mode_mask int, maxspeed_kph int, road_class_id int"


def contracted(spark, rows, protect=(), limit=None):
    n = max(max(r[0], r[1]) for r in rows) + 1
    nodes = spark.createDataFrame([("r", i, 1000 + i, 0, 0, 16 if i in protect else 0) for i in range(n)], NODES)
    nodes, edges = contract.contract_chains(nodes, spark.createDataFrame(rows, EDGES))
    name = {r["node_index"]: r["osm_id"] - 1000 for r in nodes.collect()}
    out = [(name[r["source_index"]], name[r["target_index"]], r["cost_seconds"], r["flags"], r["mode_mask"], r["maxspeed_kph"], r["road_class_id"]) for r in edges.collect()]
    # Nothing is left that may be merged.
    left = contract.merge_plan(contract.merge_candidates(nodes, edges), edges)
    assert left.count() == 0
    return set(name.values()), sorted(out)


def one_by_one(rows, protect=()):
    """Nodes merged in any order, each by all pairs of an edge in and an edge out."""
    edges, gone = set(rows), set()
    while True:
        near = defaultdict(set)
        for a, b, *_ in edges:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        for v in sorted(near):
            into, out = [e for e in edges if e[1] == v != e[0]], [e for e in edges if e[0] == v != e[1]]
            pairs = [(i, o) for i in into for o in out if i[0] != o[1]]
            if v in protect or len(near[v]) != 2 or not into or not out or any(i[2] + o[2] > 65_535 for i, o in pairs):
                continue
            new = {(i[0], o[1], i[2] + o[2], i[3] | o[3], i[4] & o[4], min([s for s in (i[5], o[5]) if s] or [0]), i[6] if i[6] == o[6] else 0) for i, o in pairs if i[4] & o[4]}
            if new:
                edges = {e for e in edges if v not in e[:2]} | new
                gone.add(v)
                break
        else:
            least = defaultdict(lambda: 1 << 60)
            for e in edges:
                key = (e[0], e[1], *e[3:])
                least[key] = min(least[key], e[2])
            return gone, sorted((k[0], k[1], c, *k[2:]) for k, c in least.items())


def street(r, nodes, both=True):
    rows = []
    for a, b in zip(nodes, nodes[1:]):
        rows.append((a, b, r.randint(1, 50), r.choice([0, 1, 256]), r.choice([3, 5, 7]), r.choice([0, 30, 50]), r.choice([3, 3, 5])))
        if both:
            rows.append((b, a, r.randint(1, 50), r.choice([0, 1, 512]), r.choice([1, 7]), r.choice([0, 20, 50]), 3))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_streets_between_crossings(spark, seed):
    """Crossings 0 to 5 are protected, streets of up to 30 nodes between them, some of one direction: one result whatever the order."""
    r, rows, free = random.Random(seed), [], 6
    for a in range(6):
        for b in range(a + 1, 6):
            n = r.choice([0, 1, 2, 5, 17, 30])
            rows += street(r, [a, *range(free, free + n), b], r.random() < 0.7)
            free += n
    kept, edges = contracted(spark, rows, range(6))
    gone, want = one_by_one(rows, range(6))
    assert edges == want and kept == set(range(free)) - gone == set(range(6))


def times(rows, bit):
    out, found = defaultdict(list), {}
    for e in rows:
        if e[4] & bit:
            out[e[0]].append((e[1], e[2]))
    for s in {x for e in rows for x in e[:2]}:
        held, heap = {s: 0}, [(0, s)]
        while heap:
            t, at = heapq.heappop(heap)
            for to, step in out[at] if t == held[at] else ():
                if t + step < held.get(to, 1 << 60):
                    held[to] = t + step
                    heapq.heappush(heap, (t + step, to))
        found |= {(s, x): t for x, t in held.items()}
    return found


def test_rings_parallel_edges_and_dear_chains_keep_times(spark):
    """Cases whose result depends on the order: times between the nodes left are as before."""
    r = random.Random(9)
    rows = street(r, [0, 1, 2, 3, 4, 0]) + street(r, [10, 11, 12, 13, 10])  # a ring, and one from and to a crossing
    rows += street(r, [10, 20, 21, 22, 23]) + [(21, 22, 3, 0, 7, 0, 3), (22, 21, 4, 1, 1, 0, 3)]  # parallel edges on the way
    rows += [(a, b, 20_000, 0, 7, 5, 3) for i in range(30, 45) for a, b in ((i, i + 1), (i + 1, i))] + street(r, [23, 30])
    rows += [(50, 51, 5, 0, 1, 0, 3), (51, 52, 5, 0, 2, 0, 3), (52, 53, 5, 0, 2, 0, 3), (53, 10, 9, 0, 7, 0, 3), (10, 50, 2, 0, 7, 0, 3)]  # no mode goes all along
    rows += street(r, [60, 61, 62, 60]) + street(r, [45, 60], both=False)
    kept, edges = contracted(spark, rows)
    gone, want = one_by_one(rows)
    assert len(kept & {x for e in rows for x in e[:2]}) <= len({x for e in rows for x in e[:2]} - gone) + 2
    assert all(c <= 65_535 for _, _, c, *_ in edges)
    for bit in (1, 2, 4):
        before, after = times(rows, bit), times([*edges, *[(k, k, 0, 0, bit, 0, 0) for k in kept]], bit)
        ends = kept & {x for e in rows for x in e[:2]}
        assert {k: v for k, v in before.items() if k[0] in ends and k[1] in ends} == {k: v for k, v in after.items() if k[0] in ends and k[1] in ends}


def test_rounds_go_with_the_bits_of_a_chain(spark, monkeypatch):
    """A chain of 500 nodes is merged by some ten looks ahead and no round of single merges."""
    seen = []
    real = contract.written
    monkeypatch.setattr(contract, "written", lambda df, name: (seen.append(name), real(df, name))[1])
    rows = [e for i in range(501) for e in ((i, i + 1, 1, 0, 7, 0, 3), (i + 1, i, 2, 0, 7, 0, 3))]
    kept, edges = contracted(spark, rows, (0, 501))
    assert kept == {0, 501} and [e[2] for e in edges] == [501, 1002]
    assert seen.count("chain-links") <= 11 and "chosen" not in seen


def test_ranks(spark):
    links = spark.createDataFrame([(0, 1, 2, 5), (1, 2, 3, 6), (2, 3, 4, 7), (9, 8, 7, 1), (8, 7, 9, 1), (7, 9, 8, 1)], "u long, v long, w long, hop long")
    rows = {(r["u"], r["v"]): (r["last"], r["end"], r["steps"], r["cost"]) for r in contract.chain_ranks(links).collect()}
    assert rows == {(0, 1): (3, 4, 3, 18), (1, 2): (3, 4, 2, 13), (2, 3): (3, 4, 1, 7)}
    assert contract.chain_ranks(links.limit(0)).count() == 0


def test_nothing_to_merge(spark):
    rows = [(0, 1, 5, 0, 7, 0, 3), (1, 0, 5, 0, 7, 0, 3), (2, 2, 1, 0, 7, 0, 3)]
    kept, edges = contracted(spark, rows)
    assert kept == {0, 1, 2} and len(edges) == 3
    nodes = spark.createDataFrame([("r", 0, 1, 0, 0, 0)], NODES)
    assert contract.contract_chains(nodes, spark.createDataFrame([], EDGES))[0].count() == 1
    assert nodes.where(F.col("flags") == 0).count() == 1
