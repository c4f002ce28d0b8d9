"""Distances and travel minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Km of the earth's radius and of a degree; walking and riding speeds.
RADIUS, DEGREE = 6371.0, 111.0
DETOUR, WALK, RIDE, STOP = 1.3, 80.0, 0.75, 0.7


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(a))


def flat(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular km."""
    return F.hypot((lat2 - lat1) * DEGREE, (lon2 - lon1) * DEGREE * F.cos(F.radians((lat1 + lat2) / 2)))


def walk_minutes(km: Column) -> Column:
    return F.ceil(km * DETOUR * 1000 / WALK).cast("int")


def ride_minutes(km: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1.0), (km / RIDE + STOP) * factor)
