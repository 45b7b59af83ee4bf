"""Question 2: the map of an indicator at an instant, or at many instants at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.functions.geo import Grid
from stationlens.functions.stats import band
from stationlens.operators.kriging import Solved, krige_surface, krige_weights, location_means, semivariogram, variogram_fit
from stationlens.operators.skew import salted_join
from stationlens.schema import MAP_INDICATORS, check_indicator
from stationlens.session import written
from stationlens.sources.layouts import hour_rows

SNAPSHOT = ["day", "hour"]
# Fixed value: number of contour levels of a map.
LEVELS = 100


def hour_snapshot(obs: DataFrame, year: int, month: int, day: int, hour: int) -> DataFrame:
    """All indicators of all stations in one hour; empty when nothing was reported."""
    wanted = [c for c in MAP_INDICATORS if c in obs.columns]
    return hour_rows(obs, year, month, day, hour).select("station", *SNAPSHOT, "lon", "lat", *wanted)


def snapshot_bounds(rows: DataFrame, indicator: str) -> DataFrame:
    """(day, hour, low, high, n) of the non-null values of each snapshot."""
    v = F.col(indicator).cast("double")
    return (
        rows.filter(v.isNotNull())
        .groupBy(*SNAPSHOT)
        .agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n"))
    )


def contour_bands(surface: DataFrame, bounds: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Add ``band``, the contour interval of ``z`` between the snapshot's bounds."""
    joined = salted_join(surface, bounds.select(*SNAPSHOT, "low", "high"), SNAPSHOT, ["lon", "lat", "z"])
    return joined.select(*surface.columns, band(F.col("z"), F.col("low"), F.col("high"), levels).alias("band"))


def fitted_weights(rows: DataFrame, indicator: str) -> Solved:
    """The solved kriging system of every snapshot, with the semivariogram fitted to it."""
    places = written(location_means(rows, SNAPSHOT, indicator), "places")
    model = variogram_fit(semivariogram(places, SNAPSHOT), SNAPSHOT)
    return krige_weights(places, model, SNAPSHOT)


def indicator_surface(rows: DataFrame, indicator: str, grid: Grid = Grid(), variance: bool = False) -> DataFrame:
    """Interpolated grid of every snapshot in ``rows``."""
    check_indicator(indicator, rows.columns)
    return krige_surface(fitted_weights(rows, indicator), SNAPSHOT, grid, variance)


def indicator_map(
    obs: DataFrame, year: int, month: int, day: int, hour: int, indicator: str, grid: Grid = Grid()
) -> DataFrame:
    """Grid and contour interval of one indicator in one hour."""
    rows = hour_rows(obs, year, month, day, hour)
    return contour_bands(indicator_surface(rows, indicator, grid), snapshot_bounds(rows, indicator))


def write_surface(surface: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store surfaces in one directory per day."""
    surface.repartitionByRange(*SNAPSHOT, "iy", "ix").sortWithinPartitions(*SNAPSHOT, "iy", "ix").write.mode(
        mode
    ).partitionBy("day").parquet(path)


def wide_surface(surface: DataFrame, nx: int) -> DataFrame:
    """One row per grid line with a column ``x<ix>`` per cell."""
    return surface.groupBy(*SNAPSHOT, "iy").agg(
        *[F.max(F.when(F.col("ix") == i, F.col("z"))).alias(f"x{i}") for i in range(nx)]
    )
