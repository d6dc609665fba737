"""Distance, geohash and the profile's piecewise curves, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, EARTH_MILES, ROAD = 6371.0, 3958.8, 1.3
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"  # the geohash alphabet


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


def road_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_MILES) * ROAD


def geohash(lat: Column, lon: Column, length: int = 6) -> Column:
    """Interleaved cells of longitude and latitude, five bits a letter; empty without a point. A value on a middle line goes low."""
    bits = length * 5
    nx, ny = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.greatest(F.lit(0), F.least(F.ceil((v - low) / span * (1 << n)) - 1, F.lit((1 << n) - 1))).cast("long")
    x, y = cell(lon, -180.0, 360.0, nx), cell(lat, -90.0, 180.0, ny)
    out = []
    for i in range(length):
        value = F.lit(0)
        for j in range(5):
            k = 5 * i + j  # the k-th bit from the left: longitude first
            source, n = (x, nx) if k % 2 == 0 else (y, ny)
            value = value * 2 + F.shiftright(source, n - 1 - k // 2).bitwiseAND(1)
        out.append(F.substring(F.lit(_BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.when(lat.isNull() | lon.isNull(), "").otherwise(F.concat(*out))


def piecewise(x: Column, points: list[tuple[float, float]], below: float, above: float) -> Column:
    """Linear between the points (x, y); `below` before the first of them, `above` behind the last."""
    c = F.when(x < points[0][0], below)
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        c = c.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return c.otherwise(above)
