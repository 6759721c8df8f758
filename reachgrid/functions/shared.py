"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
SMALL = 100_000


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary
    folder of its own. On a cluster a machine-local folder would lose data, so
    a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, group_mb: int = 128) -> str:
    """Path in the shared folder where ``df`` has been written as Parquet, with row groups of about ``group_mb``.

    The size of a row group is looked at from the first row on, by default only after 100: rows may be megabytes long.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.page.size.row.check.min", 1).option("parquet.block.size", group_mb << 20).parquet(path)
    return path


def written(df: DataFrame, name: str, group_mb: int = 128) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one task's rerun, and lets
    several later branches read the rows without computing them again. Tasks hold a row group of arrays at once, unpacked:
    tables of long rows take small ones.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name, group_mb))


def once(**columns: Column) -> Column:
    """``columns`` through a generator, so that what several later expressions read is not worked out at each use."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def released(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it is counted at ``rows`` or fewer, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_by_size(rows: DataFrame, side: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join with a written ``side`` of one row per key, whose ``size`` is about the key's rows out of ``total``.

    A side of few rows is broadcast. Of a larger one the keys of over a ``SMALL``-th of all rows are, at most ``SMALL`` of
    them, so that no hot key's rows meet in one task; the rest is joined by a shuffle.
    """
    if side.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(side), keys)
    hot = side.where(F.col(size) * SMALL > total)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(size) * SMALL <= total), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)
