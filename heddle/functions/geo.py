"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Earth's radius in miles.
MILES = 3958.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles; null if any part is missing."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.lit(2 * MILES) * F.asin(F.sqrt(h))


def box(lat: Column, lon: Column, at: tuple[float, float], miles: float) -> Column:
    """A plain range test that every point within the radius passes, for pruning before the exact test.

    Near a pole or the date line only the latitude is tested.
    """
    import math

    dlat = math.degrees(miles / MILES) * 1.0001
    near = lat.between(at[0] - dlat, at[0] + dlat)
    top = max(abs(at[0] - dlat), abs(at[0] + dlat))
    if top >= 89:
        return near
    s = math.sin(miles / MILES / 2) / math.cos(math.radians(top))
    dlon = math.degrees(2 * math.asin(s)) * 1.0001 if s < 1 else 360.0
    if at[1] - dlon < -180 or at[1] + dlon > 180:
        return near
    return near & lon.between(at[1] - dlon, at[1] + dlon)
