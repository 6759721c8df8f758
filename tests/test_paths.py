"""Long paths as rows against the same rules on whole arrays."""

from __future__ import annotations

import numpy as np
import pytest

from reachgrid.operators import boundary


def _lines() -> dict:
    rng = np.random.default_rng(3)
    walk = lambda n: np.cumsum(rng.normal(size=(n, 2)), axis=0)
    ring = walk(40)
    return {
        "long": walk(900), "ring": np.vstack([ring, ring[:1]]), "short": walk(3), "two": walk(2), "one": walk(1), "flat": np.array([[i, 0.0] for i in range(300)]),
        "ties": np.array([[0, 0], [1, 5], [2, 0], [3, 5], [4, 0.0]]), "spot": np.zeros((50, 2)), "triangle": np.array([[0, 0], [9, 9], [0, 0.0]]),
    }


def _brute(line: np.ndarray, tolerance: float) -> set[int]:
    """Plain recursion over one line."""
    n = len(line)
    last = n - 2 if n >= 4 and (line[0] == line[-1]).all() else n - 1
    kept, todo = {0, last, n - 1}, [(0, last)]
    while todo:
        a, b = todo.pop()
        best, at = tolerance * tolerance, None
        for i in range(a + 1, b):
            d, p = line[b] - line[a], line[i] - line[a]
            square = d[0] * d[0] + d[1] * d[1]
            t = min(1.0, max(0.0, (p[0] * d[0] + p[1] * d[1]) / (square if square > 0 else 1.0)))
            e = p - t * d
            if e[0] * e[0] + e[1] * e[1] > best:
                best, at = e[0] * e[0] + e[1] * e[1], i
        if at is not None:
            kept.add(at)
            todo += [(a, at), (at, b)]
    return kept


@pytest.mark.parametrize("piece", [50_000, 20, 1])
def test_simplified_rows(spark, piece):
    lines = _lines()
    # Positions need not be dense, keys may be several, other columns are not read.
    rows = [(name, 1, 10 * i, float(x), float(y), "extra") for name, line in lines.items() for i, (x, y) in enumerate(line)]
    rows += [(None, 1, 0, 1.0, 1.0, ""), ("long", 1, 5, None, 1.0, "")]
    points = spark.createDataFrame(rows, "name string, part int, pos long, x double, y double, _a string")
    got = boundary.simplify_points(points, ["name", "part"], 1.5, piece)
    assert got.columns == ["name", "part", "pos", "x", "y"]
    kept = [(r["name"], r["pos"] // 10) for r in got.collect()]
    want = {(name, i) for name, line in lines.items() for i in _brute(line, 1.5)}
    assert len(kept) == len(set(kept)) and set(kept) == want
    for name, line in lines.items():
        assert set(boundary.kept_positions(line[:, 0], line[:, 1], 1.5).tolist()) == {i for n, i in want if n == name}, name


def test_canvas_of_rows(spark):
    points = spark.createDataFrame([("r", 1, i, float(i), float(y)) for i, y in enumerate([0, 3, 0])] + [("s", 1, 0, 5.0, 5.0), ("s", 1, 1, 7.0, 9.0), ("s", 2, 0, 99.0, 99.0)], "region_id string, id int, pos long, x double, y double")
    rows = boundary.canvas_points(points, ["region_id", "id"], 1.0, ["region_id"]).collect()
    assert {(r["region_id"], r["pos"], r["x"], r["y"], r["width"], r["height"]) for r in rows} == {("r", 0, 0, 3, 2, 3), ("r", 1, 1, 0, 2, 3), ("r", 2, 2, 3, 2, 3), ("s", 0, 0, 4, 2, 4), ("s", 1, 2, 0, 2, 4)}
    assert boundary.simplify_points(points.limit(0), ["id"], 1.0).count() == 0 and boundary.simplify_points(points, ["region_id", "id"], 0.0).count() == 6
    with pytest.raises(ValueError):
        boundary.canvas_points(points.where("id = 2"), ["region_id", "id"], 1.0)
    with pytest.raises(ValueError):
        boundary.simplify_points(points, ["id"], -1.0)
