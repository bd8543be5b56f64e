"""Longitude and latitude to UTM metres and back, by the Krüger series on WGS84."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid, the scale on the central meridian and the false easting.
AXIS, FLATTENING, SCALE, EASTING, NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
ECCENTRIC = 2 * math.sqrt(N) / (1 + N)


def zone_of(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone; southern latitudes have the false northing."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - ECCENTRIC * F.atanh(ECCENTRIC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east += a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north += a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * RADIUS * east, SCALE * RADIUS * north + F.when(lat < 0, NORTHING).otherwise(0.0)


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    xi = (northing - F.when(south, NORTHING).otherwise(0.0)) / (SCALE * RADIUS)
    eta = (easting - EASTING) / (SCALE * RADIUS)
    x, e = xi, eta
    for j, b in enumerate(BETA, 1):
        x -= b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e -= b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi += d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(phi)


def box_to_lon_lat(x0: Column, y0: Column, x1: Column, y1: Column, zone: Column, south: Column) -> list[Column]:
    """By its two corners only, which is not the true envelope."""
    a, b = from_utm(x0, y0, zone, south), from_utm(x1, y1, zone, south)
    return [*a, *b]
