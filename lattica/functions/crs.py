"""Coordinate transforms as Column expressions and as plain functions: EPSG 4326, 3857 and the WGS 84 UTM zones."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere of 3857; axis, flattening, scale and false easting of UTM on WGS 84.
RADIUS, AXIS, FLAT, SCALE, EASTING = 6378137.0, 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
#: Latitude to which 3857 is defined; what lies beyond is put there.
MAX_LAT = 85.06

_N = FLAT / (2 - FLAT)
_A = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the Krueger series to third order, forward and inverse, and of the latitude.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


class _Scalar:
    """The functions of ``pyspark.sql.functions`` that are used here, over floats."""

    sin, cos, tan, sinh, cosh, tanh, atan, atan2, atanh, asinh, asin, exp, log, sqrt = (
        math.sin, math.cos, math.tan, math.sinh, math.cosh, math.tanh, math.atan, math.atan2, math.atanh, math.asinh, math.asin, math.exp, math.log, math.sqrt)
    radians, degrees = math.radians, math.degrees


def _mercator_lat(lat):
    if isinstance(lat, Column):
        return F.when(F.abs(lat) > MAX_LAT, F.signum(lat) * MAX_LAT).otherwise(lat)
    return max(-MAX_LAT, min(MAX_LAT, lat))


def _utm_zone(srid: int) -> tuple[float, float] | None:
    """Central meridian and false northing of EPSG 326zz and 327zz."""
    for base, north in ((32600, 0.0), (32700, 10_000_000.0)):
        if 1 <= srid - base <= 60:
            return (srid - base) * 6 - 183.0, north
    return None


def _to_lonlat(m, srid: int, x, y):
    if srid == 4326:
        return x, y
    if srid == 3857:
        return m.degrees(x / RADIUS), m.degrees(2 * m.atan(m.exp(y / RADIUS)) - math.pi / 2)
    if zone := _utm_zone(srid):
        xi, eta = (y - zone[1]) / (SCALE * _A), (x - EASTING) / (SCALE * _A)
        xi0, eta0 = xi, eta
        for j, b in enumerate(_BETA, 1):
            xi0 = xi0 - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
            eta0 = eta0 - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        chi = m.asin(m.sin(xi0) / m.cosh(eta0))
        lat = chi
        for j, d in enumerate(_DELTA, 1):
            lat = lat + d * m.sin(2 * j * chi)
        return zone[0] + m.degrees(m.atan2(m.sinh(eta0), m.cos(xi0))), m.degrees(lat)
    raise ValueError(f"SRID {srid} is not supported")


def _from_lonlat(m, srid: int, lon, lat):
    if srid == 4326:
        return lon, lat
    if srid == 3857:
        return RADIUS * m.radians(lon), RADIUS * m.log(m.tan(math.pi / 4 + m.radians(_mercator_lat(lat)) / 2))
    if zone := _utm_zone(srid):
        phi, lam = m.radians(lat), m.radians(lon - zone[0])
        c = 2 * math.sqrt(_N) / (1 + _N)
        t = m.sinh(m.atanh(m.sin(phi)) - c * m.atanh(c * m.sin(phi)))
        xi0, eta0 = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
        xi, eta = xi0, eta0
        for j, a in enumerate(_ALPHA, 1):
            xi = xi + a * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
            eta = eta + a * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
        return EASTING + SCALE * _A * eta, zone[1] + SCALE * _A * xi
    raise ValueError(f"SRID {srid} is not supported")


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    return (x, y) if source == target else _from_lonlat(F, target, *_to_lonlat(F, source, x, y))


def transform_point(x: float, y: float, source: int, target: int) -> tuple[float, float]:
    return (x, y) if source == target else _from_lonlat(_Scalar, target, *_to_lonlat(_Scalar, source, x, y))
