"""Edge costs, colour bands and legend texts as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reachgrid.functions.numbers import half_even, half_up
from reachgrid.functions.tags import BIKE, CAR, WALK

WALKING_SPEED_M_S = 1.39
BIKE_KPH = 20
CAR_KPH = 30
MOTORWAY = 15
MAX_COST = 65_535
#: Fixed colours of the five bands.
PALETTES = {
    "dark": ((0, 255, 255), (64, 255, 64), (255, 255, 64), (255, 140, 0), (255, 64, 160)),
    "light": ((0, 110, 210), (0, 150, 70), (185, 140, 0), (185, 85, 0), (165, 0, 130)),
}


def walk_cost(dx: Column, dy: Column) -> Column:
    """Whole seconds on foot over an offset in metres, at least 1."""
    metres = F.sqrt((dx * dx + dy * dy).cast("double"))
    return F.greatest(F.lit(1), half_even(metres / WALKING_SPEED_M_S))


def edge_cost_seconds(mask: int, walking_speed: float = WALKING_SPEED_M_S) -> Column:
    """Seconds of an edge for the best of the modes in ``mask``; null if none may use it."""
    cost, open_to, speed = F.col("cost_seconds"), F.col("mode_mask"), F.col("maxspeed_kph")
    metres = F.greatest(F.lit(1.0), cost * walking_speed)
    usable = lambda bit: (open_to.bitwiseAND(mask & bit) != 0) & (cost > 0)
    slow = F.col("road_class_id") != MOTORWAY
    bike = F.least(F.lit(BIKE_KPH), speed)
    car = F.when(speed > 0, speed).otherwise(CAR_KPH)
    return F.least(
        F.when(usable(WALK) & slow, cost.cast("double")),
        F.when(usable(BIKE) & slow & (bike > 0), metres / (bike * 1000 / 3600)),
        F.when(usable(CAR), metres / (car * 1000 / 3600)),
    )


def edge_ticks(seconds: Column) -> Column:
    """Thousandths of a second, rounded up; 0 for an edge that may not be used."""
    return F.when(seconds > 0, F.least(F.ceil(seconds * 1000), F.lit(2**32 - 1))).otherwise(0).cast("long")


def band(seconds: Column, cycle_minutes: float = 75) -> Column:
    """0 to 4: fifth of the repeating cycle, upper ends included."""
    ratio = (seconds / 60) % F.lit(float(cycle_minutes)) / F.lit(float(cycle_minutes))
    return reduce(Column.__add__, [F.when(ratio > k / 5, 1).otherwise(0) for k in range(1, 5)])


def band_rgb(number: Column, theme: str = "dark") -> Column:
    """struct(r, g, b) of a band."""
    rgb = lambda c: F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "rgb")])
    return F.get(F.array(*[rgb(c) for c in PALETTES[theme]]), number)


#: Fixed message templates; other locales give their own.
TEMPLATES = {"minutes": "{m} min", "hours": "{h} h", "both": "{h} h {m} min"}


def duration_label(minutes: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    """A duration like ``15 min``, ``1 h`` or ``1 h 15 min``."""
    total = half_up(minutes)
    h, m = F.floor(total / 60), total % 60
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{h}"), h.cast("string")), F.lit("{m}"), m.cast("string"))
    return F.when(h == 0, fill(templates["minutes"])).when(m == 0, fill(templates["hours"])).otherwise(fill(templates["both"]))
