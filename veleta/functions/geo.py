"""Great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(chord))


def distance_to_parallel_km(degrees: Column) -> Column:
    """Least distance to any point at least ``degrees`` of latitude away."""
    return F.lit(EARTH_KM) * F.radians(degrees)


def distance_to_meridian_km(lat: Column, degrees: Column) -> Column:
    """Least distance to any point at least ``degrees`` (< 90) of longitude away."""
    return F.lit(EARTH_KM) * F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(degrees)))
