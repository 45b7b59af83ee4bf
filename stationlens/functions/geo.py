"""Geometry on longitude/latitude columns (degrees)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in metres used for all distances.
EARTH_RADIUS_M = 6371000.0


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres."""
    lon1, lat1, lon2, lat2 = (F.radians(c) for c in (lon1, lat1, lon2, lat2))
    half_chord_sq = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(
        F.sin((lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(half_chord_sq, F.lit(1.0))))


def unit_vector(lon, lat) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; straight-line order equals great-circle order."""
    lon, lat = F.radians(lon), F.radians(lat)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


@dataclass(frozen=True)
class Grid:
    """Regular half-open grid: ``lon_min + i * step`` while below ``lon_max``."""

    # The default map window and its cell size, in degrees.
    lon_min: float = -5.0
    lat_min: float = 39.0
    lon_max: float = 9.0
    lat_max: float = 53.0
    step: float = 0.07

    @property
    def nx(self) -> int:
        return math.ceil(round((self.lon_max - self.lon_min) / self.step, 9))

    @property
    def ny(self) -> int:
        return math.ceil(round((self.lat_max - self.lat_min) / self.step, 9))


def axis_size(low, high, step) -> Column:
    """Number of cells of a half-open axis."""
    return F.ceil(F.round((high - low) / step, 9)).cast("int")


def explode_grid(df, lon_min, lat_min, nx, ny, step):
    """Add one row per grid cell (``ix, iy, lon, lat``) to each row of ``df``.

    The mesh is generated inside each row by two explodes, not by a join; the
    coordinates come from the integer index, so no rounding error adds up.
    """
    cells = df.withColumn("ix", F.explode(F.sequence(F.lit(0), nx - 1))).withColumn(
        "iy", F.explode(F.sequence(F.lit(0), ny - 1))
    )
    return cells.withColumn("lon", lon_min + F.col("ix") * step).withColumn(
        "lat", lat_min + F.col("iy") * step
    )
