"""Results that stay current as data arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reachgrid.sources.elements import ELEMENTS


def stream_elements(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Element files (Parquet) as they arrive in a folder."""
    return spark.readStream.schema(ELEMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_highway_counts(elements: DataFrame) -> DataFrame:
    """Ways per highway value so far; for complete or update mode."""
    return elements.where("type = 'way'").select(F.col("tags")["highway"].alias("highway")).where("highway is not null").groupBy("highway").agg(F.count("*").alias("n"))


def running_raster(settled: DataFrame) -> DataFrame:
    """Least time per pixel so far out of batches of x_px, y_px, seconds; the order of batches does not matter."""
    good = (F.col("seconds") >= 0) & (F.col("seconds") < float("inf"))
    return settled.where(good).groupBy("x_px", "y_px").agg(F.min("seconds").alias("seconds"))


#: Batches after which changes are merged into a new base.
COMPACT_EVERY = 8


def _there(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)


def current(spark: SparkSession, folder: str, schema: StructType, keys: list[str], upto: int | None = None) -> DataFrame:
    """The state that ``to_parquet`` keeps in ``folder``: of each key the values of its last change; no rows before the first batch."""
    if upto is None:
        if not _there(spark, f"{folder}/commits"):
            return spark.createDataFrame([], schema)
        upto = spark.read.schema("batch long, every int").parquet(f"{folder}/commits").agg(F.max(F.struct("batch", "every")).alias("c")).select("c.*").first()
        upto, every = upto["batch"], upto["every"]
        base = (upto + 1) // every * every - 1
    else:
        base = upto - COMPACT_EVERY
    values = [c for c in schema.names if c not in keys]
    held = StructType([*schema.fields, StructField("_batch", LongType())])
    paths = [f"{folder}/base/{base}"] * (base >= 0) + [f"{folder}/changes/{n}" for n in range(max(base, -1) + 1, upto + 1)]
    rows = spark.read.schema(held).parquet(*paths)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in schema.names])


def to_parquet(df: DataFrame, folder: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Run until the input at hand is used up; the state so far, kept as Parquet in a shared ``folder``.

    A batch writes the rows of ``keys`` (all columns but the last) that it changes, so what it writes goes with the changes; every
    few batches changes are merged into a new base. A repeated attempt of a batch overwrites its files, and a
    batch counts once its number is in the commits, so a run that was stopped goes on where it was. Nothing passes the driver.
    Input without rows or files gives no rows.
    """
    keys = keys or df.columns[:-1]
    spark, schema, every = df.sparkSession, df.schema, COMPACT_EVERY

    def save(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/changes/{number}")
        if (number + 1) % every == 0:
            state = current(own, folder, schema, keys, number).withColumn("_batch", F.lit(number).cast("long"))
            state.write.mode("overwrite").parquet(f"{folder}/base/{number}")
        own.createDataFrame([(number, every)], "batch long, every int").write.mode("append").parquet(f"{folder}/commits")

    query = df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark, folder, schema, keys)
