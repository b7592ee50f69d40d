"""Geometry as Column expressions (no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Boundary lines of the area of interest as ((lat, lon), (lat, lon)).
AREA_COMMON = [(((44.0, -0.25), (43.25, 3.5)), "below"), (((42.5, -2.25), (42.0, 0.25)), "above")]
AREA_BY_SOURCE = {
    "RESIF": (((43.0, -2.25), (42.0, 2.25)), "above"),
    "IGN": (((43.75, -2.25), (42.0, 6.25)), "below"),
    "ICGC": (((43.75, -2.25), (42.0, 6.25)), "below"),
}
# Lambert-93 (RGF93, GRS80).
_A, _E2 = 6378137.0, 0.00669438002290
_LAT1, _LAT2, _LAT0, _LON0 = 44.0, 49.0, 46.5, 3.0
_FALSE_EAST, _FALSE_NORTH = 700_000.0, 6_600_000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km; null if any coordinate is null."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def chord_km(lat1: Column, lon1: Column, dep1: Column, lat2: Column, lon2: Column, dep2: Column) -> Column:
    """Straight distance between two points at depths in km below a sphere of 6371 km."""

    def xyz(lat: Column, lon: Column, dep: Column) -> tuple[Column, Column, Column]:
        r = EARTH_KM - dep
        return (
            r * F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
            r * F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
            r * F.sin(F.radians(lat)),
        )

    (x1, y1, z1), (x2, y2, z2) = xyz(lat1, lon1, dep1), xyz(lat2, lon2, dep2)
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2))


def beside_line(lat: Column, lon: Column, line: tuple, side: str) -> Column:
    """Strictly above or below the straight line through two (lat, lon) points."""
    (lat1, lon1), (lat2, lon2) = line
    cross = (lon - lon1) * (lat2 - lat1) - (lat - lat1) * (lon2 - lon1)
    return cross < 0 if side == "above" else cross > 0


def in_area(source: Column, lat: Column, lon: Column) -> Column:
    """Inside the area of interest: the source's own line and the two lines common to all."""
    inside = F.lit(True)
    for line, side in AREA_COMMON:
        inside = inside & beside_line(lat, lon, line, side)
    own = F.lit(True)
    for name, (line, side) in AREA_BY_SOURCE.items():
        own = F.when(source == name, beside_line(lat, lon, line, side)).otherwise(own)
    return inside & own


def destination(lat: Column, lon: Column, azimuth: float, km: float) -> tuple[Column, Column]:
    """(lat, lon) reached over a flat earth of 111 km a degree."""
    north, east = km * math.cos(math.radians(azimuth)) / 111.0, km * math.sin(math.radians(azimuth)) / 111.0
    return lat + north, lon + east / F.cos(F.radians(lat))


def local_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(x, y) in km east and north of (lat0, lon0), with the cosine of the mean latitude."""
    x = EARTH_KM * (F.radians(lon) - F.radians(lon0)) * F.cos((F.radians(lat0) + F.radians(lat)) / 2)
    return x, EARTH_KM * (F.radians(lat) - F.radians(lat0))


def from_local_km(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(lat, lon) of a point x km east and y km north of (lat0, lon0)."""
    return (
        F.degrees(F.radians(lat0) + y / EARTH_KM),
        F.degrees(F.radians(lon0) + x / (EARTH_KM * F.cos(F.radians(lat0)))),
    )


def lambert_constants() -> tuple[float, float, float]:
    """Exponent n, scale c and radius of the latitude of origin of the conic projection."""

    def iso(lat: float) -> float:
        s = math.sin(math.radians(lat))
        e = math.sqrt(_E2)
        return math.atanh(s) - e * math.atanh(e * s)

    def norm(lat: float) -> float:
        return _A / math.sqrt(1 - _E2 * math.sin(math.radians(lat)) ** 2)

    n = math.log(norm(_LAT2) * math.cos(math.radians(_LAT2)) / (norm(_LAT1) * math.cos(math.radians(_LAT1)))) / (iso(_LAT1) - iso(_LAT2))
    c = norm(_LAT1) * math.cos(math.radians(_LAT1)) / n * math.exp(n * iso(_LAT1))
    return n, c, c * math.exp(-n * iso(_LAT0))


def lambert93(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres of the conic projection with two standard parallels."""
    n, c, r0 = lambert_constants()
    e = math.sqrt(_E2)
    s = F.sin(F.radians(lat))
    iso = F.lit(0.5) * F.log((1 + s) / (1 - s)) - F.lit(e / 2) * F.log((1 + e * s) / (1 - e * s))
    r = c * F.exp(-n * iso)
    angle = n * (F.radians(lon) - math.radians(_LON0))
    return _FALSE_EAST + r * F.sin(angle), _FALSE_NORTH + r0 - r * F.cos(angle)


def from_lambert93(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of a point in the conic projection: the latitude by fixed-point steps, each a hundred times nearer or more."""
    n, c, r0 = lambert_constants()
    e = math.sqrt(_E2)
    east, north = x - _FALSE_EAST, F.lit(_FALSE_NORTH + r0) - y
    iso = -F.log(F.sqrt(east * east + north * north) / c) / n
    s = F.tanh(iso)
    for _ in range(7):
        s = F.tanh(iso + F.lit(e / 2) * F.log((1 + e * s) / (1 - e * s)))
    return F.degrees(F.asin(s)), F.degrees(F.atan2(east, north)) / n + _LON0


def along_section(lat: Column, lon: Column, lat0: float, lon0: float, azimuth: float) -> tuple[Column, Column]:
    """(along, across) in km of a point seen from (lat0, lon0) in the direction of the azimuth, on the sphere."""
    d = haversine_km(F.lit(lat0), F.lit(lon0), lat, lon) / EARTH_KM
    y = F.sin(F.radians(lon - lon0)) * F.cos(F.radians(lat))
    x = math.cos(math.radians(lat0)) * F.sin(F.radians(lat)) - math.sin(math.radians(lat0)) * F.cos(F.radians(lat)) * F.cos(
        F.radians(lon - lon0)
    )
    turn = F.atan2(y, x) - math.radians(azimuth)
    return F.atan2(F.sin(d) * F.cos(turn), F.cos(d)) * EARTH_KM, F.asin(F.sin(d) * F.sin(turn)) * EARTH_KM
