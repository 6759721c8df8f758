"""Projections with a datum of their own and conic ones, against published points and there and back again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reachgrid.functions import geo
from reachgrid.operators import project

#: Published test points of the national grid of Great Britain (lat, lon, easting, northing).
POINTS = [
    (49.92226393730, -6.29977752014, 91492.146, 11318.804),
    (49.96006137820, -5.20304609998, 170370.718, 11572.405),
    (50.43885825610, -4.10864563561, 250359.811, 62016.569),
    (50.57563665000, -1.29782277240, 449816.371, 75335.861),
    (51.40078220140, -3.55128349240, 292184.870, 168003.465),
    (51.37447025550, 1.44454730409, 639821.835, 169565.858),
]


def test_national_grid_by_published_points(spark):
    rows = project.projected(spark.createDataFrame(POINTS, "lat double, lon double, e double, n double"), 27700)
    for r in rows.collect():
        assert abs(r["easting"] - r["e"]) < 5 and abs(r["northing"] - r["n"]) < 5


@pytest.mark.parametrize(("epsg", "lat", "lon", "within"), [(2154, 48.85, 2.35, 1e-9), (32130, 41.8, -71.4, 1e-9), (3414, 1.35, 103.8, 1e-9), (27700, 51.5, -0.12, 2e-8), (2100, 37.98, 23.73, 2e-8), (2169, 49.61, 6.13, 2e-8)])
def test_there_and_back(spark, epsg, lat, lon, within):
    """Codes with a shift lose the point's height on the way, less than 2 mm."""
    points = spark.createDataFrame([(lat + i * 0.11, lon - i * 0.07) for i in range(-4, 5)] + [(None, lon)], "lat double, lon double")
    rows = project.projected(points, epsg)
    a, b = geo.unproject(F.col("easting"), F.col("northing"), epsg)
    for r in rows.select("lat", "lon", a.alias("a"), b.alias("b")).collect():
        assert r["lat"] is None and r["a"] is None or abs(r["a"] - r["lat"]) < within and abs(r["b"] - r["lon"]) < within


@pytest.mark.parametrize("epsg", [27700, 2100, 2169])
def test_origin_on_its_own_datum(spark, epsg):
    """What unprojects from the false origin projects back to it."""
    p = geo.projection(epsg)
    lat, lon = spark.range(1).select(*geo.unproject(F.lit(p.east), F.lit(p.north), epsg)).first()
    assert abs(lat - p.lat0) < 0.01 and abs(lon - p.lon0) < 0.01 and (lat, lon) != (p.lat0, p.lon0)
    east, north = spark.range(1).select(*geo.project(F.lit(lat), F.lit(lon), epsg)).first()
    assert abs(east - p.east) < 0.01 and abs(north - p.north) < 0.01


def test_unknown_code_is_an_error():
    with pytest.raises(ValueError, match="no projection"):
        geo.project(F.lit(1.0), F.lit(2.0), 4326)
