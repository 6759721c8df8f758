"""Counts, shares and densities of map elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachgrid.functions.geo import haversine_m
from reachgrid.functions.tags import CONSTRAINT_TAGS, ROUTABLE_HIGHWAYS, ROUTING_TAGS


def highway_counts(elements: DataFrame, k: int | None = None, types: tuple[str, ...] = ("way",)) -> DataFrame:
    """Elements per highway value, most frequent first, ties by name; ``k`` keeps the first."""
    found = elements.where(F.col("type").isin(*types)).select(F.col("tags")["highway"].alias("highway")).where(F.col("highway").isNotNull())
    counts = found.groupBy("highway").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "highway")
    return counts.limit(k) if k else counts


def _unpivoted(row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias(key), F.col(f"`{n}`").alias(value)) for n in names])
    return row.select("_all", F.inline(pairs))


def presence(rows: DataFrame, c: Column, tags: tuple[str, ...]) -> DataFrame:
    """tag, presence, ratio over ``rows`` in one pass."""
    counts = rows.agg(F.count("*").alias("_all"), *[F.count_if(F.map_contains_key(c, t)).alias(t) for t in tags])
    ratio = F.when(F.col("_all") > 0, F.col("presence") / F.col("_all")).otherwise(0.0)
    return _unpivoted(counts, list(tags), "tag", "presence").select("tag", "presence", ratio.alias("ratio"))


def tag_coverage(ways: DataFrame) -> DataFrame:
    return presence(ways, F.col("constraints"), CONSTRAINT_TAGS)


def routing_tag_presence(elements: DataFrame, tags: tuple[str, ...] = ROUTING_TAGS) -> DataFrame:
    found = elements.where(F.col("type").isin("way", "relation") & F.map_contains_key("tags", "highway"))
    return presence(found, F.col("tags"), tags).select("tag", "presence")


def connector_counts(elements: DataFrame) -> DataFrame:
    """kind, n: a node may count under several kinds."""
    t = F.col("tags")
    tests = {"barrier": F.map_contains_key(t, "barrier"), "crossing": t["highway"] == "crossing", "level_crossing": t["railway"] == "level_crossing", "entrance": F.map_contains_key(t, "entrance")}
    counts = elements.where("type = 'node'").agg(F.count("*").alias("_all"), *[F.count_if(x).alias(k) for k, x in tests.items()])
    return _unpivoted(counts, list(tests), "kind", "n").select("kind", "n")


def observed_walkable(counts: DataFrame) -> DataFrame:
    """Routable highway values that occur, in the list's order."""
    ranks = counts.sparkSession.createDataFrame(list(enumerate(ROUTABLE_HIGHWAYS)), "rank int, highway string")
    return counts.join(F.broadcast(ranks), "highway").select("rank", "highway", "n").orderBy("rank")


def node_ref_density(elements: DataFrame) -> DataFrame:
    """Per region: ways, references, km and references per km over all highway ways; segments without coordinates are counted."""
    refs = F.filter("nodes", lambda x: x.isNotNull())
    ways = elements.where((F.col("type") == "way") & F.col("tags")["highway"].isNotNull() & (F.size(refs) >= 2))
    rows = ways.select("region_id", F.col("id").alias("way_id"), F.posexplode(refs).alias("pos", "node_id"))
    places = elements.where("type = 'node'").groupBy("region_id", F.col("id").alias("node_id")).agg(F.max_by(F.struct("lat", "lon"), "seq").alias("at"))
    rows = rows.join(places, ["region_id", "node_id"], "left")
    after = F.lead("at").over(Window.partitionBy("region_id", "way_id").orderBy("pos"))
    last = F.lead("pos").over(Window.partitionBy("region_id", "way_id").orderBy("pos")).isNull()
    rows = rows.select("region_id", "way_id", "pos", "at", after.alias("to"), last.alias("last"))
    known = ~F.col("last") & F.col("at").isNotNull() & F.col("to").isNotNull()
    metres = F.when(known, haversine_m(F.col("at.lat"), F.col("at.lon"), F.col("to.lat"), F.col("to.lon")))
    sums = rows.groupBy("region_id").agg(
        F.count_if(F.col("pos") == 0).alias("ways"), F.count("*").alias("refs"), (F.coalesce(F.sum(metres), F.lit(0.0)) / 1000).alias("km"), F.count_if(~F.col("last") & ~known).alias("missing_segments")
    )
    return sums.withColumn("refs_per_km", F.when(F.col("km") > 0, F.col("refs") / F.col("km")))


def geometry_density(elements: DataFrame) -> DataFrame:
    """References per km from inline geometry of two points or more."""
    points = F.filter("geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    ways = elements.where((F.col("type") == "way") & F.col("tags")["highway"].isNotNull()).select("region_id", points.alias("g")).where(F.size("g") >= 2)
    n = F.size("g")
    legs = F.zip_with(F.slice("g", F.lit(1), n - 1), F.slice("g", F.lit(2), n - 1), lambda a, b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]))
    rows = ways.select("region_id", n.alias("refs"), F.aggregate(legs, F.lit(0.0), lambda s, x: s + x).alias("m"))
    sums = rows.groupBy("region_id").agg(F.count("*").alias("ways"), F.sum("refs").alias("refs"), (F.sum("m") / 1000).alias("km"))
    return sums.withColumn("refs_per_km", F.when(F.col("km") > 0, F.col("refs") / F.col("km")))
