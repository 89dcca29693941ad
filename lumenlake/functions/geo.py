"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is null."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h)))  # least() would pass over a null


def located(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def inside_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive on all sides; null coordinates are not inside (null, which no filter passes)."""
    return lat.between(south, north) & lon.between(west, east)
