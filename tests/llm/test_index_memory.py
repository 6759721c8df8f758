"""What a task holds of the search index does not grow with the rows that it makes or reads."""

from __future__ import annotations

import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from reachgrid.functions.shared import stored, written
from reachgrid.llm import lexical


def groups(path: str) -> list[int]:
    """Rows of each row group."""
    folder = path.removeprefix("file:")
    found = [pq.ParquetFile(f"{folder}/{f}").metadata for f in os.listdir(folder) if f.endswith(".parquet")]
    return [m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)]


def test_long_rows_make_small_row_groups(spark):
    """Twenty rows of 2.4 MB in one task: under a hundred, which were one row group before."""
    long = F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.xxhash64(i, F.col("id")))
    rows = spark.range(0, 20, 1, 1).select("id", long.alias("a"))
    assert max(groups(stored(rows, "long-rows", 8))) <= 4
    assert len(groups(stored(spark.range(0, 100_000, 1, 1), "short-rows", 8))) == 1


def test_the_index_asks_for_small_row_groups(spark, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(lexical, "written", lambda df, name, group_mb=128: (seen.update({name: group_mb}), written(df, name, group_mb))[1])
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["doc_id"] for r in lexical.op13_block_max_search(spark, str(tmp_path)).collect()] == [1]
    assert seen["lexical-index"] <= 16
