"""Rules on way tags as Columns; ``c`` is the map of constraint tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
ROUTABLE_HIGHWAYS = ("footway", "path", "pedestrian", "living_street", "residential", "service", "track", "steps", "cycleway", "unclassified", "tertiary", "secondary", "primary")
CONSTRAINT_TAGS = (
    "access", "foot", "oneway", "oneway:foot", "bicycle", "cycleway", "oneway:bicycle", "motor_vehicle", "vehicle",
    "sidewalk", "junction", "service", "surface", "tracktype", "maxspeed", "maxspeed:forward", "maxspeed:backward",
)
ALLOW = ("yes", "designated", "permissive", "official", "destination")
DENY = ("no", "private")
WALK, BIKE, CAR = 1, 2, 4
WALK_HIGHWAYS = ("footway", "path", "pedestrian", "steps", "cycleway", "track", "living_street", "residential", "service", "unclassified", "tertiary", "secondary", "primary")
BIKE_HIGHWAYS = ("cycleway", "path", "track", "living_street", "residential", "service", "unclassified", "tertiary", "secondary", "primary")
CAR_HIGHWAYS = ("living_street", "residential", "service", "unclassified", "tertiary", "secondary", "primary", "trunk", "motorway")
WALK_KPH = {"steps": 3, "footway": 5, "path": 5, "pedestrian": 5}
BIKE_KPH = {
    "cycleway": 20, "path": 15, "track": 15, "footway": 12, "pedestrian": 10, "living_street": 15,
    "residential": 18, "service": 16, "unclassified": 20, "tertiary": 22, "secondary": 22, "primary": 22,
}
CAR_KPH = {
    "living_street": 10, "service": 20, "residential": 30, "unclassified": 35, "tertiary": 40,
    "secondary": 50, "primary": 50, "trunk": 80, "motorway": 110, "track": 20,
}
ROAD_CLASSES = (
    "footway", "path", "pedestrian", "steps", "living_street", "residential", "service", "cycleway",
    "track", "unclassified", "tertiary", "secondary", "primary", "trunk", "motorway",
)
NODE_FLAGS = {"crossing": 1, "level_crossing": 2, "entrance": 4, "barrier": 8}
PROTECTED_FLAG = 16
SPEED_TOKEN = r"^([0-9]+(?:\.[0-9]+)?)\s*(km/h|kmh|kph|mph)?$"
NO_SPEED = ("none", "signals", "variable", "national")
WALK_SPEED = ("walk", "walking_speed")
ROUTING_TAGS = ("maxspeed", "maxspeed:forward", "maxspeed:backward", "access", "foot", "vehicle", "motor_vehicle", "bicycle", "oneway", "oneway:foot", "sidewalk")


def lookup(c: Column, values: dict[str, int], default: int | None = None) -> Column:
    """Value of a fixed map at ``c``."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def tag(c: Column, key: str) -> Column:
    return F.lower(F.trim(c[key]))


def has(c: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(c, key), F.lit(False))


def way_disallowed(c: Column, read: Callable[[str], Column] | None = None) -> Column:
    """Foot denies; else foot allows; else access denies. Closes the way to all modes."""
    read = read or (lambda key: tag(c, key))
    foot, access = read("foot"), read("access")
    return F.coalesce(F.when(foot.isin(*DENY), True).when(foot.isin(*ALLOW), False).when(access.isin(*DENY), True), F.lit(False))


def mode_mask(highway: Column, c: Column, read: Callable[[str], Column] | None = None) -> Column:
    """Modes a way is open to: defaults by highway, cycleways, access, then mode tags from general to special.

    ``read`` gives tags that have been put in lower case and trimmed before.
    """
    read = read or (lambda key: tag(c, key))
    bits = lambda names, bit: F.when(highway.isin(*names), bit).otherwise(0)
    mask = bits(WALK_HIGHWAYS, WALK) + bits(BIKE_HIGHWAYS, BIKE) + bits(CAR_HIGHWAYS, CAR)
    mask = mask.bitwiseOR(F.when(has(c, "cycleway"), BIKE).otherwise(0))
    access = read("access")
    mask = F.when(access.isin(*DENY), 0).when(access.isin(*ALLOW), 7).otherwise(mask)
    for key, bit in (("foot", WALK), ("bicycle", BIKE), ("vehicle", BIKE | CAR), ("motor_vehicle", CAR)):
        value = read(key)
        # Bits taken off, then bits put on; the mask stands once in each step.
        mask = mask.bitwiseAND(F.when(value.isin(*DENY), 7 & ~bit).otherwise(7)).bitwiseOR(F.when(value.isin(*ALLOW), bit).otherwise(0))
    return mask.cast("int")


def parse_maxspeed(raw: Column) -> Column:
    """km/h of a speed tag; the first readable part of a list counts, none readable is 0."""
    value = F.lower(F.trim(raw))

    # Step by step, so that each part of a list is trimmed and matched once.
    parts = F.transform(F.split(value, r"[;|]"), lambda t: F.trim(t))
    matched = F.transform(parts, lambda t: F.struct(t.alias("token"), F.regexp_extract(t, SPEED_TOKEN, 1).alias("number"), F.regexp_extract(t, SPEED_TOKEN, 2).alias("unit")))

    def kph(m: Column) -> Column:
        number = m["number"].try_cast("double")
        exact = F.when(m["unit"] == "mph", number * 1.60934).otherwise(number)
        return F.when(m["token"].isin(*NO_SPEED), 0).when(m["number"] != "", F.least(F.bround(exact, 0), F.lit(65535)).cast("int"))

    read = F.filter(F.transform(matched, kph), lambda x: x.isNotNull())
    return F.when(value.isin(*WALK_SPEED), 5).otherwise(F.coalesce(F.get(read, F.lit(0)), F.lit(0)))


def fallback_speed(highway: Column, mask: Column) -> Column:
    """Largest usual speed of the modes that may use the way."""
    of = lambda bit, speed: F.when(mask.bitwiseAND(bit) > 0, speed)
    return F.coalesce(F.greatest(of(WALK, lookup(highway, WALK_KPH, 5)), of(BIKE, lookup(highway, BIKE_KPH)), of(CAR, lookup(highway, CAR_KPH))), F.lit(0))


def direction_speed(c: Column, forward: bool) -> Column:
    """km/h of the tag for a direction, 0 if it is not readable; null without one."""
    key = "maxspeed:forward" if forward else "maxspeed:backward"
    return F.when(has(c, key), parse_maxspeed(c[key]))


def edge_speed(own: Column, read: Column, usual: Column) -> Column:
    """A tag for the direction (``own``) replaces the general one (``read``), readable or not; 0 goes to the usual speed."""
    speed = F.coalesce(own, read)
    return F.when(speed > 0, speed).otherwise(usual).cast("int")


def road_class(highway: Column) -> Column:
    return lookup(highway, {h: i for i, h in enumerate(ROAD_CLASSES, 1)}, 0)


def edge_flags(c: Column) -> Column:
    """Sidewalk 1, oneway 256, oneway:bicycle 512, roundabout 1024, speed by direction 2048."""
    bit = lambda test, value: F.when(test, value).otherwise(0)
    return (
        bit(c["sidewalk"].isNotNull() & ~c["sidewalk"].isin("no", "none"), 1)
        + bit(has(c, "oneway"), 256)
        + bit(has(c, "oneway:bicycle"), 512)
        + bit(F.lower(c["junction"]) == "roundabout", 1024)
        + bit(has(c, "maxspeed:forward") | has(c, "maxspeed:backward"), 2048)
    )


def node_flags(types: Column) -> Column:
    """Bit set of connector types."""
    return F.aggregate(types, F.lit(0), lambda acc, x: acc.bitwiseOR(lookup(x, NODE_FLAGS, 0)))
