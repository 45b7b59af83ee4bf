"""The observation data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of a report file, in file order.
REPORT_COLUMNS = (
    "station", "valid", "lon", "lat",
    "tmpf", "dwpf", "relh", "drct", "sknt", "p01i", "alti", "mslp", "vsby", "gust",
    "skyc1", "skyc2", "skyc3", "skyc4",
    "skyl1", "skyl2", "skyl3", "skyl4",
    "wxcodes",
    "ice_accretion_1hr", "ice_accretion_3hr", "ice_accretion_6hr",
    "peak_wind_gust", "peak_wind_drct", "peak_wind_time",
    "feel", "metar",
)
# Columns kept as text.
TEXT_COLUMNS = ("skyc1", "skyc2", "skyc3", "skyc4", "wxcodes", "metar")
# Columns averaged per place before clustering.
CLUSTER_INDICATORS = ("tmpf", "dwpf", "relh", "drct", "sknt", "alti", "vsby", "skyl1", "feel")

LOCATION_COLUMNS = ("lon", "lat")
NUMERIC_COLUMNS = tuple(
    c for c in REPORT_COLUMNS if c not in TEXT_COLUMNS and c not in ("station", "valid")
)
#: Everything that can be drawn on a map: all numbers but the location itself.
MAP_INDICATORS = tuple(c for c in NUMERIC_COLUMNS if c not in LOCATION_COLUMNS)
TIME_COLUMNS = ("year", "month", "day_of_month", "hour", "minute")

REPORT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REPORT_COLUMNS])


def check_indicator(name: str, available) -> str:
    """Return ``name`` if it is a column of ``available``, else raise."""
    if name not in available:
        raise ValueError(f"unknown indicator {name!r}; choose one of {sorted(available)}")
    return name
