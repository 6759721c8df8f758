"""Region configuration, manifests and localized names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("id", "name", "graphFileName", "boundaryFileName", "locationRelation", "subdivisionAdminLevel", "epsg")
_ENTRY = (
    "id string, name string, localizedNames map<string, string>, graphFileName string, boundaryFileName string, locationRelation string, subdivisionAdminLevel string, "
    "subdivisionDiscoveryModes array<string>, epsg int, graphBinaryFileName string, graphSummaryFileName string, boundaryResolution double, boundaryUnits string"
)


def load_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a JSON document (an array, or ``{"regions": [...]}``), with defaults; gaps and repeated ids are errors."""
    raw = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    array = f"array<struct<{', '.join(': '.join(f.split(' ', 1)) for f in _split(_ENTRY))}>>"
    rows = F.when(F.col("v").startswith("["), F.from_json("v", array)).otherwise(F.from_json("v", f"struct<regions: {array}>")["regions"])
    rows = raw.select(F.explode(rows).alias("r")).select("r.*")
    gap = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in REQUIRED]
    if rows.where(F.exists(F.array(*gap), lambda x: x)).limit(1).count():
        raise ValueError(f"a region needs {', '.join(REQUIRED)}")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a region id occurs twice")
    names = F.transform_keys("localizedNames", lambda k, _: F.lower(F.replace(k, F.lit("_"), F.lit("-"))))
    return rows.select(
        "id", "name", F.when(F.size("localizedNames") > 0, names).alias("localized_names"), F.col("graphFileName").alias("graph_file_name"), F.col("boundaryFileName").alias("boundary_file_name"),
        F.col("locationRelation").alias("location_relation"), F.col("subdivisionAdminLevel").alias("subdivision_admin_level"),
        F.array_distinct(F.coalesce("subdivisionDiscoveryModes", F.array(F.lit("area"), F.lit("subarea")))).alias("subdivision_discovery_modes"), "epsg",
        F.coalesce("graphBinaryFileName", F.regexp_replace("graphFileName", r"\.gz$", "")).alias("graph_binary_file_name"), F.col("graphSummaryFileName").alias("graph_summary_file_name"),
        F.coalesce("boundaryResolution", F.lit(25.0)).alias("boundary_resolution"), F.coalesce("boundaryUnits", F.lit("meters")).alias("boundary_units"),
    )


def _split(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def select_regions(regions: DataFrame, only: list[str]) -> DataFrame:
    """Regions named in ``only`` (ids, or several with commas); an unknown id is an error; none means all."""
    asked = regions.sparkSession.createDataFrame([(x,) for x in only], "text string").select(F.explode(F.split("text", ",")).alias("id")).select(F.trim("id").alias("id")).where("id != ''").distinct()
    if unknown := [r["id"] for r in asked.join(regions, "id", "left_anti").limit(10).collect()]:
        raise ValueError(f"unknown regions {sorted(unknown)}")
    return regions.join(asked, "id", "left_semi") if asked.limit(1).count() else regions


def location_manifest(regions: DataFrame) -> DataFrame:
    """value: JSON of each region for the map's menu; names in other languages only where there are some."""
    row = F.struct("id", "name", F.col("graph_file_name").alias("graphFileName"), F.col("boundary_file_name").alias("boundaryFileName"), F.col("localized_names").alias("localizedNames"))
    return regions.select("id", F.to_json(row).alias("value"))


def collation(spark: SparkSession, locale: str) -> str:
    """Name of the collation of a locale's language without case and accents, the root's if it has none."""
    asked = f"{locale.replace('_', '-').split('-')[0].lower()}_CI_AI"
    has = spark.sql("SELECT name FROM collations()").where(F.col("name") == asked).limit(1).count()
    return asked if has else "UNICODE_CI_AI"


def natural_order(name: Column, collation: str = "UNICODE_CI_AI") -> Column:
    """Key by which names sort: letters by collation, runs of digits by the numbers they make ("Zone 2" before "Zone 10").

    A number is led by how many digits it has, in six places, without zeros before it; null stays null.
    """
    def part(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(x)

    return F.collate(F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), 0), part), ""), collation)


def localized_locations(regions: DataFrame, locale: str) -> DataFrame:
    """id, name, display_name in a locale: its own name, else that of its language, else the canonical one.

    In the natural order of the locale's language: neither case nor accents count, numbers by value; then by id likewise.
    """
    if regions.where("coalesce(trim(id), '') = '' or coalesce(trim(name), '') = ''").limit(1).count():
        raise ValueError("a location needs an id and a name")
    if regions.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a location id occurs twice")
    key = locale.lower().replace("_", "-")
    names = F.col("localized_names")
    shown = F.coalesce(names[key], names[key.split("-")[0]], F.col("name"))
    return regions.select("id", "name", shown.alias("display_name")).orderBy(*[natural_order(F.col(c), collation(regions.sparkSession, locale)) for c in ("display_name", "id")])


def resolve_location(locations: DataFrame, asks: DataFrame, default: str | None = None) -> DataFrame:
    """ask_id, id: the asked location, else the default, else the first by order of ``locations`` (pos)."""
    first = locations.agg(F.min_by("id", "pos").alias("_first"), F.max(F.when(F.col("id") == F.lit(default), F.col("id"))).alias("_default"))
    found = asks.join(locations.select(F.col("id").alias("asked"), F.col("id").alias("_found")), "asked", "left").crossJoin(F.broadcast(first))  # one row
    return found.select("ask_id", F.coalesce("_found", "_default", "_first").alias("id"))
