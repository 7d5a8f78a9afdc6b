"""Distances, envelopes and the UTM projection as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
METRES_A_DEGREE = 111_320.0
# The box around Canada, west, south, east, north.
CANADA = (-141.5, 41.5, -52.0, 84.0)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; null where a coordinate is missing."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    # least() passes over nulls, so a missing place would be at the antipode
    return F.when(h.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def envelope(lon: Column, lat: Column, metres: float) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a point and a margin."""
    dy = F.lit(metres / METRES_A_DEGREE)
    dx = F.lit(metres) / (F.lit(METRES_A_DEGREE) * F.greatest(F.lit(0.1), F.cos(F.radians(lat))))
    return lon - dx, lat - dy, lon + dx, lat + dy


def reach(lon: Column, lat: Column, km: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of all that lies within a distance, in degrees.  The
    farthest meridian is met nearer to the pole than the place itself; a circle around a
    pole has all of them.  West and east may lie beyond a full turn's ends."""
    turn = km / EARTH_KM
    # a little further than numbers say, as sines are rounded
    dy = F.degrees(turn) * (1 + 1e-9) + 1e-9
    side = F.sin(F.least(turn, F.lit(math.pi / 2))) / F.cos(F.radians(lat))
    dx = F.when(F.abs(lat) + dy >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), side))) * (1 + 1e-9) + 1e-6)
    return lon - dx, lat - dy, lon + dx, lat + dy


def in_canada(lon: Column, lat: Column, inclusive: bool = False) -> Column:
    w, s, e, n = CANADA
    return ((lon >= w) & (lon <= e) & (lat >= s) & (lat <= n)) if inclusive else ((lon > w) & (lon < e) & (lat > s) & (lat < n))


def utm17(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in UTM zone 17 north (WGS 84), by the usual series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon) - F.lit(math.radians(-81.0))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, x = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (x + (1 - t + c) * F.pow(x, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(x, 5) / 120) + 500000.0
    north = k0 * (m + n * F.tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(x, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(x, 6) / 720))
    return east, north
