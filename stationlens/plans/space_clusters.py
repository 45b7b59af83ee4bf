"""Question 3: clusters of space over a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.functions.stats import mean, round_exact
from stationlens.operators.clustering import kmeans, minmax_scale
from stationlens.schema import CLUSTER_INDICATORS
from stationlens.session import written
from stationlens.sources.layouts import period_rows

PLACE = ["station", "lon", "lat"]


def feature_names(indicators=CLUSTER_INDICATORS) -> list[str]:
    return ["f_lon", "f_lat", *indicators]


def period_scan(obs: DataFrame, start, end, indicators=CLUSTER_INDICATORS) -> DataFrame:
    return period_rows(obs, start, end).select(*PLACE, *indicators)


def complete_cases(rows: DataFrame, indicators=CLUSTER_INDICATORS) -> DataFrame:
    """Rows without any missing value."""
    return rows.na.drop(how="any", subset=[*PLACE, *indicators])


def period_features(
    obs: DataFrame, start, end, indicators=CLUSTER_INDICATORS, decimals: int | None = None
) -> DataFrame:
    """Mean of location and indicators per (station, lon, lat to two places)."""
    rows = complete_cases(period_scan(obs, start, end, indicators), indicators)
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    place = (F.col("station"), round_exact(lon, 2).alias("k_lon"), round_exact(lat, 2).alias("k_lat"))
    means = rows.groupBy(*place).agg(
        mean(lon, decimals).alias("f_lon"),
        mean(lat, decimals).alias("f_lat"),
        *[mean(F.col(c), decimals).alias(c) for c in indicators],
    )
    return means.withColumnsRenamed({"k_lon": "lon", "k_lat": "lat"})


def cluster_period(
    obs: DataFrame,
    start,
    end,
    k: int = 10,
    indicators=CLUSTER_INDICATORS,
    decimals: int | None = None,
    first_as_centres: bool = False,
    max_iter: int = 100_000,
    eps: float = 1e-4,
    seed: int = 42,
) -> DataFrame:
    """(station, lon, lat, label): k-means over the scaled means of the period.

    Start centres are drawn by ``seed``, or are the first ``k`` places by name
    with ``first_as_centres``.
    """
    features = feature_names(indicators)
    means = written(period_features(obs, start, end, indicators, decimals), "period-features")
    points = minmax_scale(means, features)
    start_rows = points.orderBy(*PLACE).limit(k) if first_as_centres else None
    labelled = kmeans(points, PLACE, features, k, start_rows, max_iter, eps, seed)
    return labelled.select(*PLACE, "label")


def cluster_map_layer(obs: DataFrame, start, end, k: int = 10, **options) -> DataFrame:
    """Markers of the cluster map: position, label and the station as caption."""
    return cluster_period(obs, start, end, k, **options).select("lon", "lat", "label", F.col("station").alias("popup"))
