"""Map elements: reading, and the schema that all operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<struct<lat: double, lon: double>>"
ELEMENT = (
    "type string, id long, lat double, lon double, nodes array<long>, tags map<string, string>, "
    f"geometry {POINTS}, members array<struct<type: string, ref: long, role: string, geometry: {POINTS}>>"
)
ELEMENTS = f"region_id string, seq long, {ELEMENT}"


def read_overpass(spark: SparkSession, path: str, region_id: str, strict: bool = False) -> DataFrame:
    """Elements of a JSON document with an ``elements`` array, in order.

    ``strict`` drops single references and tag values of a wrong type; without it
    such a value is cast, or empties its array. A document without the array, or one
    that is not JSON, is an error; entries that are no objects are skipped.
    """
    kind = ELEMENT.replace("nodes array<long>", "nodes array<variant>").replace("map<string, string>", "map<string, variant>") if strict else ELEMENT
    fields = ", ".join(f"{name}: {rest}" for name, rest in (f.split(" ", 1) for f in _fields(kind)))
    document = spark.read.schema(f"elements array<struct<{fields}>>, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    if document.where(F.col("elements").isNull()).limit(1).count():
        raise ValueError(f"{path} has no array of elements")
    rows = document.select(F.posexplode("elements").alias("seq", "e")).where(F.col("e").isNotNull())
    if strict:
        whole = F.filter("e.nodes", lambda v: F.schema_of_variant(v) == "BIGINT")
        text = F.map_filter("e.tags", lambda _, v: F.schema_of_variant(v) == "STRING")
        e = F.col("e").withField("nodes", F.transform(whole, lambda v: F.variant_get(v, "$", "bigint"))).withField("tags", F.transform_values(text, lambda _, v: F.variant_get(v, "$", "string")))
        rows = rows.select("seq", e.alias("e"))
    return rows.select(F.lit(region_id).alias("region_id"), F.col("seq").cast("long").alias("seq"), "e.*")


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def read_elements(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Elements as a splittable table: Parquet, or JSON with one element a line."""
    return spark.read.schema(ELEMENTS).format(format).load(path)


def write_tables(df: DataFrame, path: str) -> None:
    """Parquet by region."""
    df.write.mode("overwrite").partitionBy("region_id").parquet(path)
