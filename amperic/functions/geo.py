"""Planar, spherical and map-projection expressions over degree columns.

Everything here is a Column expression, so it runs inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 ellipsoid, mean earth radius, metres per degree near the equator.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 110.25 * 1000

E2 = WGS84_F * (2 - WGS84_F)
E = math.sqrt(E2)

# Default standard parallels of the equal-area projection: either side of the region.
PARALLELS = (4.0, 8.0)
ORIGIN = (0.0, 0.0)


def planar_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dx, dy = lon2 - lon1, lat2 - lat1
    return F.sqrt(dx * dx + dy * dy)


def planar_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees times a constant; good close to the equator only."""
    return planar_degrees(lat1, lon1, lat2, lon2) * METRES_PER_DEGREE


def great_circle_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine form: stable for near points, where the arc cosine is not."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _q(sin_phi):
    """Authalic term of a latitude, for a float or a Column of its sine."""
    log = math.log if isinstance(sin_phi, float) else F.log
    es = sin_phi * E
    return (sin_phi / (1 - es * es) - log((1 - es) / (1 + es)) / (2 * E)) * (1 - E2)


def _m2(phi: float) -> float:
    return math.cos(phi) ** 2 / (1 - E2 * math.sin(phi) ** 2)


def albers(lat: Column, lon: Column, parallels: tuple[float, float] = PARALLELS) -> tuple[Column, Column]:
    """Albers equal-area conic on the ellipsoid, in metres."""
    p1, p2 = (math.radians(p) for p in parallels)
    q1, q2 = _q(math.sin(p1)), _q(math.sin(p2))
    n = (_m2(p1) - _m2(p2)) / (q2 - q1)
    c = _m2(p1) + n * q1
    q0 = _q(math.sin(math.radians(ORIGIN[0])))
    rho0 = WGS84_A * math.sqrt(c - n * q0) / n
    rho = F.sqrt(c - _q(F.sin(F.radians(lat))) * n) * (WGS84_A / n)
    theta = F.radians(lon - ORIGIN[1]) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def albers_metres(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, parallels: tuple[float, float] = PARALLELS
) -> Column:
    """Planar distance between two projected points."""
    x1, y1 = albers(lat1, lon1, parallels)
    x2, y2 = albers(lat2, lon2, parallels)
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def world_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Ellipsoidal Mercator (EPSG 3395), in metres."""
    phi = F.radians(lat)
    es = F.sin(phi) * E
    y = F.log(F.tan(phi / 2 + math.pi / 4) * F.pow((1 - es) / (1 + es), F.lit(E / 2)))
    return F.radians(lon) * WGS84_A, y * WGS84_A


def utm(lat: Column, lon: Column, zone: int = 30) -> tuple[Column, Column]:
    """Transverse Mercator series for a northern UTM zone (30 is EPSG 32630)."""
    k0 = 0.9996
    ep2 = E2 / (1 - E2)
    phi = F.radians(lat)
    sin_phi, cos_phi, tan_phi = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(WGS84_A) / F.sqrt(1 - sin_phi * sin_phi * E2)
    t = tan_phi * tan_phi
    c = cos_phi * cos_phi * ep2
    a = F.radians(lon - (zone * 6 - 183)) * cos_phi
    e4, e6 = E2**2, E2**3
    m = (
        phi * (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256)
        - F.sin(phi * 2) * (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024)
        + F.sin(phi * 4) * (15 * e4 / 256 + 45 * e6 / 1024)
        - F.sin(phi * 6) * (35 * e6 / 3072)
    ) * WGS84_A
    x = n * k0 * (
        a
        + (1 - t + c) * F.pow(a, 3) / 6
        + (t * t - t * 18 + c * 72 + 5 - 58 * ep2) * F.pow(a, 5) / 120
    )
    y = (
        m
        + n * tan_phi * (
            a * a / 2
            + (c * c * 4 + c * 9 + 5 - t) * F.pow(a, 4) / 24
            + (t * t - t * 58 + c * 600 + 61 - 330 * ep2) * F.pow(a, 6) / 720
        )
    ) * k0
    return x + 500000.0, y
