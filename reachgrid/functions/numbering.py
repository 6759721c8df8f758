"""Global numbering and running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachgrid.functions.shared import written

_ROW_BITS = 33


def dense_index(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0-based position of each row in the global ``order``.

    Rows are dealt by range and sorted per partition; a row's position is its
    place in its partition plus the sizes of the partitions before it. Only one
    row per partition meets in one task. Ties in ``order`` may land in any order.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "indexed")
    part = F.shiftrightunsigned("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: its size is bounded by the number of partitions.
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_part", "_start", "_at")
    )


def bucketed(df: DataFrame, keys: list[str], unit: Column, count: Column) -> DataFrame:
    """Add ``_bucket``: ``unit`` (31-bit, uniform, keeps the order) cut into about sqrt(count) parts.

    ``count`` is the number of rows of the row's key, so that neither the number
    of parts of a key nor the rows of a part exceed a root of the key's rows.
    """
    parts = F.ceil(F.least(count / 128, F.greatest(F.lit(32.0), F.sqrt(count.cast("double"))))).cast("long")
    return df.withColumn("_bucket", F.shiftright(unit * F.greatest(parts, F.lit(1)), 31))


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, inclusive: bool = True) -> DataFrame:
    """Add ``name``: running total of ``value`` per ``keys`` in ``order``; ``df`` needs ``_bucket``.

    ``_bucket`` must not fall as ``order`` rises. Totals per part are summed
    first, each part is then swept alone, so a hot key spreads over many tasks.
    """
    at = [*keys, "_bucket"]
    sums = df.groupBy(*at).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*at, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    swept = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return swept.join(starts, at).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")
