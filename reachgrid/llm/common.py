"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"

#: Rows up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted at ``rows`` or fewer, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Keys with more than this share of all rows are few enough to broadcast.
HOT_SHARE, HOT_ROWS = 100_000, 1_000


def hot_rows(total: int) -> int:
    """Rows over which a key is hot among ``total`` rows."""
    return max(HOT_ROWS, total // HOT_SHARE)


def left_join_hot(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` (stored) left-joined with ``side``, which has one row a key and that key's number of rows in ``n``.

    Rows of keys with over a 100,000th of all rows never meet in one task: there are fewer than 100,000 such
    keys, which are broadcast. All others are joined by shuffle.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > hot_rows(total)
    few, rest = F.broadcast(side.where(hot)), side.where(~hot)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key, "left"))
