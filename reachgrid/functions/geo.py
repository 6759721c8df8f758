"""Distances and map projections as Column expressions.

Transverse Mercator by the Krueger series to fourth order, Lambert conformal conic by
its closed form forward and by the conformal latitude's series backward. Codes on another
datum go through geocentric coordinates with a seven-parameter shift, which agrees with
national grids to some metres.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Fixed axes and flattenings.
GRS80, WGS84 = (6378137.0, 1 / 298.257222101), (6378137.0, 1 / 298.257223563)
AIRY, HAYFORD = (6377563.396, 1 / 299.3249646), (6378388.0, 1 / 297.0)


@dataclass(frozen=True)
class Shift:
    """From a datum's geocentric coordinates to those of WGS 84: metres, seconds of arc, parts in a million."""

    x: float
    y: float
    z: float
    turn_x: float = 0.0
    turn_y: float = 0.0
    turn_z: float = 0.0
    scale: float = 0.0

    def matrix(self) -> np.ndarray:
        a, b, c = (math.radians(t / 3600) for t in (self.turn_x, self.turn_y, self.turn_z))
        return (1 + self.scale * 1e-6) * np.array([[1, -c, b], [c, 1, -a], [-b, a, 1]])


@dataclass(frozen=True)
class Projection:
    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    shape: tuple[float, float] = GRS80
    parallels: tuple[float, float] | None = None
    shift: Shift | None = None


#: Fixed parameters of the public registry codes.
PROJECTIONS = {
    25832: Projection(9.0),
    25833: Projection(15.0),
    32633: Projection(15.0, shape=WGS84),
    32737: Projection(39.0, north=10_000_000.0, shape=WGS84),
    28354: Projection(141.0, north=10_000_000.0),
    3414: Projection(103.0 + 50 / 60, 1.0 + 22 / 60, 1.0, 28001.642, 38744.572, WGS84),
    2154: Projection(3.0, 46.5, 1.0, 700_000.0, 6_600_000.0, parallels=(44.0, 49.0)),
    27700: Projection(-2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0, AIRY, shift=Shift(446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894)),
    2100: Projection(24.0, shift=Shift(-199.87, 74.79, 246.62)),
    2169: Projection(6.0 + 10 / 60, 49.0 + 50 / 60, 1.0, 80_000.0, 100_000.0, HAYFORD, shift=Shift(-189.6806, 18.3463, -42.7695, -0.33746, -3.09264, 2.53861, 0.4598)),
    32130: Projection(-71.5, 41.0 + 5 / 60, 160_000 / 160_001, 100_000.0, 0.0),
}


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _atanh(x: Column) -> Column:
    return 0.5 * F.log((1 + x) / (1 - x))


def _series(p: Projection) -> tuple[float, float, list[float], list[float]]:
    """Rectifying radius, eccentricity, forward and inverse coefficients."""
    a, f = p.shape
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, math.sqrt(f * (2 - f)), forward, inverse


def _north_of(p: Projection) -> float:
    """Northing of the origin's latitude on the central meridian, before the false northing."""
    radius, e, forward, _ = _series(p)
    phi = math.radians(p.lat0)
    xi = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))
    return p.scale * radius * (xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(forward, 1)))


def projection(epsg: int) -> Projection:
    if epsg not in PROJECTIONS:
        raise ValueError(f"no projection for EPSG:{epsg}")
    return PROJECTIONS[epsg]


def _let(f: Callable[[Column], Column], **values: Column) -> Column:
    """``f`` of a struct of ``values``, each worked out once; nested formulas written out in full outgrow compiled code."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), F.lit(0))


def _geocentric(lat: Column, lon: Column, shape: tuple[float, float]) -> list[Column]:
    a, f = shape
    e2 = f * (2 - f)
    phi, theta = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return [n * F.cos(phi) * F.cos(theta), n * F.cos(phi) * F.sin(theta), n * (1 - e2) * F.sin(phi)]


def _geographic(x: Column, y: Column, z: Column, shape: tuple[float, float]) -> Column:
    """struct(lat, lon) near the ellipsoid, by way of the reduced latitude."""
    a, f = shape
    b, e2 = a * (1 - f), f * (2 - f)
    lat = lambda g: F.atan2(g["z"] + e2 / (1 - e2) * b * F.pow(F.sin(g["u"]), 3), g["p"] - e2 * a * F.pow(F.cos(g["u"]), 3))
    made = lambda g: F.struct(F.degrees(lat(g)).alias("lat"), g["lon"].alias("lon"))
    with_u = lambda g: _let(made, u=F.atan2(a * g["z"], b * g["p"]), z=g["z"], p=g["p"], lon=g["lon"])
    return _let(with_u, p=F.sqrt(x * x + y * y), z=z, lon=F.degrees(F.atan2(y, x)))


def _moved(lat: Column, lon: Column, shapes: tuple, before: tuple, matrix: np.ndarray, after: tuple) -> Column:
    """struct(lat, lon) on another datum of a point near the ellipsoid: its geocentric coordinates shifted, turned, shifted."""
    turned = lambda g: [sum(float(w) * (g[c] + t) for w, c, t in zip(row, "xyz", before)) + end for row, end in zip(matrix, after)]
    placed = lambda g: _let(lambda h: _geographic(h["x"], h["y"], h["z"], shapes[1]), **dict(zip("xyz", turned(g))))
    return _let(placed, **dict(zip("xyz", _geocentric(lat, lon, shapes[0]))))


def _to_datum(lat: Column, lon: Column, p: Projection) -> Column:
    s = p.shift
    return _moved(lat, lon, (WGS84, p.shape), (-s.x, -s.y, -s.z), np.linalg.inv(s.matrix()), (0.0, 0.0, 0.0))


def _from_datum(lat: Column, lon: Column, p: Projection) -> Column:
    s = p.shift
    return _moved(lat, lon, (p.shape, WGS84), (0.0, 0.0, 0.0), s.matrix(), (s.x, s.y, s.z))


def project(lat: Column, lon: Column, epsg: int) -> tuple[Column, Column]:
    """(easting, northing) in metres; points are taken at height 0."""
    p = projection(epsg)
    if p.shift:
        grid = lambda g: _named("east", "north", _mercator(g["lat"], g["lon"], p))
        made = _let(lambda g: _let(lambda h: grid(h["at"]), at=_to_datum(g["lat"], g["lon"], p)), lat=lat, lon=lon)
        return made["east"], made["north"]
    return _conic(lat, lon, p) if p.parallels else _mercator(lat, lon, p)


def unproject(east: Column, north: Column, epsg: int) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    p = projection(epsg)
    back = _conic_back if p.parallels else _mercator_back
    if p.shift:
        made = lambda g: _let(lambda h: _from_datum(h["lat"], h["lon"], p), **dict(zip(("lat", "lon"), _geodetic(g["chi"], g["turn"], p))))
        place = _let(lambda g: _let(made, **dict(zip(("chi", "turn"), back(g["east"], g["north"], p)))), east=east, north=north)
        return place["lat"], place["lon"]
    return _geodetic(*back(east, north, p), p)


def _named(a: str, b: str, pair: tuple[Column, Column]) -> Column:
    return F.struct(pair[0].alias(a), pair[1].alias(b))


def _mercator(lat: Column, lon: Column, p: Projection) -> tuple[Column, Column]:
    radius, e, forward, _ = _series(p)
    phi, dl = F.radians(lat), F.radians(lon - p.lon0)
    t = F.sinh(_atanh(F.sin(phi)) - e * _atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dl)), _atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(forward, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return p.east + p.scale * radius * east, p.north - _north_of(p) + p.scale * radius * north


def _mercator_back(east: Column, north: Column, p: Projection) -> tuple[Column, Column]:
    """(conformal latitude, angle from the central meridian)."""
    radius, _, _, inverse = _series(p)
    x, y = (north - p.north + _north_of(p)) / (p.scale * radius), (east - p.east) / (p.scale * radius)
    xi, eta = x, y
    for j, c in enumerate(inverse, 1):
        xi = xi - c * F.sin(2 * j * x) * F.cosh(2 * j * y)
        eta = eta - c * F.cos(2 * j * x) * F.sinh(2 * j * y)
    return F.asin(F.sin(xi) / F.cosh(eta)), F.atan2(F.sinh(eta), F.cos(xi))


def _geodetic(chi: Column, turn: Column, p: Projection) -> tuple[Column, Column]:
    """(lat, lon) of a conformal latitude, by its series, and of an angle from the central meridian."""
    f = p.shape[1]
    n = f / (2 - f)
    deltas = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    phi = chi
    for j, c in enumerate(deltas, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return F.degrees(phi), p.lon0 + F.degrees(turn)


def _cone(p: Projection) -> tuple[float, float, float]:
    """Constant of the cone, radius at the equator, radius at the origin's latitude."""
    a, f = p.shape
    e = math.sqrt(f * (2 - f))
    t_ = lambda s: math.tan(math.pi / 4 - math.asin(s) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    m_ = lambda s: math.cos(math.asin(s)) / math.sqrt(1 - e * e * s * s)
    s1, s2, s0 = (math.sin(math.radians(x)) for x in (*p.parallels, p.lat0))
    n = (math.log(m_(s1)) - math.log(m_(s2))) / (math.log(t_(s1)) - math.log(t_(s2)))
    big = a * m_(s1) / (n * t_(s1) ** n)
    return n, big, big * t_(s0) ** n


def _conic(lat: Column, lon: Column, p: Projection) -> tuple[Column, Column]:
    n, big, rho0 = _cone(p)
    e, phi = math.sqrt(p.shape[1] * (2 - p.shape[1])), F.radians(lat)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    rho, theta = big * F.pow(t, F.lit(n)), n * F.radians(lon - p.lon0)
    return p.east + rho * F.sin(theta), p.north + rho0 - rho * F.cos(theta)


def _conic_back(east: Column, north: Column, p: Projection) -> tuple[Column, Column]:
    """(conformal latitude, angle from the central meridian)."""
    n, big, rho0 = _cone(p)
    x, y = east - p.east, rho0 - (north - p.north)
    t = F.pow(F.sqrt(x * x + y * y) / big, F.lit(1 / n))
    return math.pi / 2 - 2 * F.atan(t), F.atan2(x, y) / n
