"""Transverse Mercator on the WGS84 ellipsoid as column expressions, by the series of Krueger to the third order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ellipsoid and of UTM: half axis, flattening, scale on the middle meridian, false easting.
AXIS, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = 2 * math.sqrt(_N) / (1 + _N)


def zone(lon: Column) -> Column:
    """The UTM zone of a longitude."""
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def _middle(zone_: Column) -> Column:
    return F.radians(zone_ * 6 - 183.0)


def _sums(table: tuple, xi: Column, eta: Column, f, g) -> Column:
    return sum((a * f(2 * (j + 1) * xi) * g(2 * (j + 1) * eta) for j, a in enumerate(table)), F.lit(0.0))


def forward(lat: Column, lon: Column, zone_: Column) -> tuple[Column, Column]:
    """Metres east (with the false easting) and north of the equator, negative in the south."""
    s, d = F.sin(F.radians(lat)), F.radians(lon) - _middle(zone_)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + _sums(_ALPHA, xi, eta, F.cos, F.sinh)
    north = xi + _sums(_ALPHA, xi, eta, F.sin, F.cosh)
    return EAST + SCALE * _RADIUS * east, SCALE * _RADIUS * north


def inverse(east: Column, north: Column, zone_: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees; to about a tenth of a millimetre within a zone."""
    xi, eta = north / (SCALE * _RADIUS), (east - EAST) / (SCALE * _RADIUS)
    x = xi - _sums(_BETA, xi, eta, F.sin, F.cosh)
    e = eta - _sums(_BETA, xi, eta, F.cos, F.sinh)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi + sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(_DELTA)), F.lit(0.0))
    return F.degrees(lat), F.degrees(_middle(zone_) + F.atan2(F.sinh(e), F.cos(x)))
