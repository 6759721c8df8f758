"""Seconds are rounded without decimals."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachgrid.functions.costs import walk_cost
from reachgrid.functions.numbers import half_even


def test_halves_go_to_the_even_one_as_bround_does(spark):
    """Halves, their neighbours and quotients of roots, as costs are."""
    x = F.col("id").cast("double") - 1_000
    near = F.explode(F.array(x + 0.5, x + 0.4999999999999999, x + 0.5000000000001, F.sqrt(F.col("id").cast("double")) / 1.39, x * 123_456_789.25))
    rows = spark.range(0, 4_000, 1, 2).select(near.alias("v"))
    assert rows.where(half_even(F.col("v")) != F.bround("v", 0).cast("long")).count() == 0
    assert rows.agg(F.count(half_even(F.col("v")))).first()[0] == 20_000


def test_costs_take_no_decimal_rounding(spark):
    """Rounding by `bround` makes a decimal of each cost."""
    plan = spark.range(1).select(walk_cost(F.col("id"), F.col("id")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert "rint" in plan.lower() and "bround" not in plan
