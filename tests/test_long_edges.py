"""Edges of over 65,535 seconds: whole in queries, as SQL has them, and in packed files."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from reachgrid.sources import binary

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Parts enough that a step past the east of the grid, back to its west, is over 91 km; a few ways there."""
    import duckdb

    folder = tmp_path_factory.mktemp("wide")
    n = 600_000
    base = duckdb.sql(f"SELECT count(*) FROM '{FOLDER}/part.parquet'").fetchall()[0][0]
    w = int(n**0.5) + 1
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(p_partkey + i * {base} AS BIGINT) AS p_partkey) FROM '{FOLDER}/part.parquet', range({n // base}) r(i)) TO '{folder}/part.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{FOLDER}/orders.parquet' WHERE o_orderkey < 400) TO '{folder}/orders.parquet'")
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST((l_orderkey + 2) * {w} - 1 - l_orderkey % 3 AS BIGINT) AS l_partkey) FROM '{FOLDER}/lineitem.parquet' WHERE l_orderkey < 400) TO '{folder}/lineitem.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["graph_edges", "packed_graph", "region_edges", "contracted_edges", "chained_edges"])
def test_long_edges_stay_whole(spark, wide, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(wide):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{wide}/{file}'")
    con.execute(f"CREATE TABLE want AS {__spark_entry__.oracle_sql()[name]}")
    columns = [r[0] for r in con.execute("DESCRIBE want").fetchall()]
    want = sorted(con.execute("SELECT * FROM want").fetchall())
    assert max(r[columns.index("cost_seconds")] for r in want) > 65_535
    assert sorted(map(tuple, __spark_entry__.queries()[name](spark, wide).select(*columns).collect())) == want


def test_wide_edges_in_packed_files(spark, tmp_path):
    nodes = spark.createDataFrame([("r", 0, 0, 0, 0, 1, 0), ("r", 1, 300_000, 0, 1, 1, 0)], "region_id string, node_index long, x_m long, y_m long, first_edge_index long, edge_count long, flags int")
    rows = [("r", 0, 0, 1, 215_827, 0, 1, 5, 1), ("r", 1, 1, 0, 65_535, 0, 7, 50, 3)]
    edges = spark.createDataFrame(rows, "region_id string, edge_index long, source_index long, target_index long, cost_seconds long, flags int, mode_mask int, maxspeed_kph int, road_class_id int")
    extent = spark.createDataFrame([("r", 25833, 0.0, 0.0, 10.0, 3, 1)], "region_id string, epsg int, origin_easting double, origin_northing double, pixel_size_m double, grid_width_px int, grid_height_px int")
    made = binary.graph_chunks(nodes, edges, extent, 1)
    binary.write_graph_files(made, f"file://{tmp_path}", ".bin")
    for header, _, found in (binary.read_chunks(made), binary.read_graph_files(spark, f"{tmp_path}/*.bin", 1)):
        assert header.first()["version"] == 3
        assert sorted(tuple(r)[1:] for r in found.collect()) == [r[1:] for r in rows]
