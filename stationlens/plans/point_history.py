"""Question 1: the past of a point, its seasons and its deviations from them.

All functions take observations ``(station, year, month, ..., value)`` of any
number of stations and answer for every station at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlens.functions.stats import from_units, mean, quarter_of, units
from stationlens.operators.nearest import StationIndex, nearest_to, resolve_points
from stationlens.operators.quantiles import histogram, quantiles, readings_in
from stationlens.operators.skew import lookup_join
from stationlens.schema import check_indicator
from stationlens.session import written

MONTHS = range(1, 13)
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
# Fixed value: whiskers reach this many interquartile ranges beyond the box.
WHISKER = 1.5


def history(obs: DataFrame, indicator: str) -> DataFrame:
    """(station, year, month, day, value), missing values included."""
    check_indicator(indicator, obs.columns)
    return obs.select("station", "year", "month", "day", F.col(indicator).alias("value"))


def history_of_station(obs: DataFrame, station: str, indicator: str) -> DataFrame:
    return history(obs.filter(F.col("station") == station), indicator)


def history_of_points(obs: DataFrame, points: DataFrame, stations: DataFrame | StationIndex, indicator: str) -> DataFrame:
    """History at the stations standing for the points, with ``n_points`` served.

    Points are ids or coordinates (see :func:`resolve_points`); each station
    comes once, however many points it stands for. ``stations`` is the dimension
    or its stored index.
    """
    resolved = resolve_points(points, stations)
    wanted = written(resolved.groupBy("station").agg(F.count("*").alias("n_points")), "wanted-stations")
    check_indicator(indicator, obs.columns)
    narrow = obs.select("station", "year", "month", "day", "ts", F.col(indicator).alias("value"))
    return lookup_join(narrow, wanted, wanted.count(), ["station"], ["ts"])


def history_of_coordinates(obs: DataFrame, lon: float, lat: float, stations: DataFrame, indicator: str) -> DataFrame:
    """History at the station nearest to one position.

    The station is looked up first, so that the scan of the observations is that of one station.
    """
    return history_of_station(obs, nearest_to(lon, lat, stations), indicator)


def _known(hist: DataFrame) -> DataFrame:
    return hist.filter(F.col("value").isNotNull())


def month_profile(hist: DataFrame, decimals: int | None = None) -> DataFrame:
    """Count, minimum, maximum and mean per month over all years."""
    v = F.col("value").cast("double")
    return (
        _known(hist)
        .groupBy("station", "month")
        .agg(F.count("*").alias("n"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), mean(v, decimals).alias("mean"))
        .orderBy("station", "month")
    )


def year_month_mean(hist: DataFrame, decimals: int | None = None) -> DataFrame:
    """Mean per year and month; months without data have no row."""
    return (
        _known(hist)
        .groupBy("station", "year", "month")
        .agg(F.count("*").alias("n"), mean(F.col("value"), decimals).alias("mean"))
        .orderBy("station", "year", "month")
    )


def year_month_matrix(hist: DataFrame, decimals: int | None = None) -> DataFrame:
    """One row per year with columns ``m01`` to ``m12``, 0 where a month is missing."""
    means = _known(hist).groupBy("station", "year", "month").agg(mean(F.col("value"), decimals).alias("mean"))
    slots = [F.coalesce(F.max(F.when(F.col("month") == m, F.col("mean"))), F.lit(0.0)).alias(f"m{m:02d}") for m in MONTHS]
    return means.groupBy("station", "year").agg(*slots).orderBy("station", "year")


def seasonal_anomaly(hist: DataFrame, decimals: int | None = None) -> DataFrame:
    """Mean of each year-month, the climatology of its month, and the deviation.

    Readings are summed once per year-month; the climatology only adds up those
    few partial sums.
    """
    sums = (
        _known(hist)
        .groupBy("station", "year", "month")
        .agg(F.sum(units(F.col("value"), decimals)).alias("total"), F.count("*").alias("n"))
    )
    all_years = Window.partitionBy("station", "month")  # one row per year
    normal = from_units(F.sum("total").over(all_years), decimals) / F.sum("n").over(all_years)
    return sums.select(
        "station",
        "year",
        "month",
        "n",
        (from_units(F.col("total"), decimals) / F.col("n")).alias("mean"),
        normal.alias("climatology"),
    ).withColumn("anomaly", F.col("mean") - F.col("climatology"))


QUARTER = ["station", "quarter"]


def _by_quarter(hist: DataFrame) -> DataFrame:
    return hist.select("station", quarter_of(F.col("month")).alias("quarter"), "value")


def _fences(readings: DataFrame, bins: DataFrame) -> DataFrame:
    """The box of each quarter and the fences around it."""
    boxes = quantiles(readings, bins, QUARTER, "value", QUARTILES)
    fences = boxes.selectExpr(
        "*", f"q1 - {WHISKER}D * (q3 - q1) as fence_low", f"q3 + {WHISKER}D * (q3 - q1) as fence_high"
    )
    return written(fences, "boxes")


def quarter_box_stats(hist: DataFrame, decimals: int | None = None) -> DataFrame:
    """What a box plot per calendar quarter shows, with all four quarters present.

    Whiskers end at the last values within the fences, or at the box when no
    value lies between. Means and what lies beyond the fences come from the bins
    of the histogram; readings are looked at again only in the bins that hold a
    quartile or a fence.
    """
    readings = _by_quarter(hist)
    bins = written(histogram(readings, QUARTER, "value", decimals), "histogram")
    boxes = _fences(readings, bins)
    n_boxes = boxes.count()
    fenced = lookup_join(bins.filter("bin is not null"), boxes.select(*QUARTER, "fence_low", "fence_high"), n_boxes, QUARTER, ["bin"])
    cut = "(low < fence_low and fence_low <= high) or (low <= fence_high and fence_high < high)"
    whole = fenced.filter(f"not ({cut})").selectExpr(
        *QUARTER, "n", "total", "if(low >= fence_low, low, null) as inner_low", "if(high <= fence_high, high, null) as inner_high",
        "if(high < fence_low or low > fence_high, n, 0) as outside",
    )
    crossed = fenced.filter(cut)
    within = lookup_join(readings_in(readings, QUARTER, "value", crossed), boxes, n_boxes, QUARTER, ["value"])
    split = within.groupBy(*QUARTER).agg(
        F.expr("min(if(value >= fence_low, value, null)) as inner_low"), F.expr("max(if(value <= fence_high, value, null)) as inner_high"),
        F.count_if(F.expr("value < fence_low or value > fence_high")).alias("outside"),
    )
    sums = crossed.groupBy(*QUARTER).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).join(split, QUARTER)
    summed = whole.unionByName(sums).groupBy(*QUARTER).agg(
        F.sum("n").alias("n"), (from_units(F.sum("total"), decimals) / F.sum("n")).alias("mean"),
        F.min("inner_low").alias("inner_low"), F.max("inner_high").alias("inner_high"), F.sum("outside").alias("n_outliers"),
    )
    every = bins.select("station").distinct().withColumn("quarter", F.expr("explode(sequence(1, 4))"))
    return (
        every.join(boxes, QUARTER, "left")
        .join(summed, QUARTER, "left")
        .select(
            *QUARTER, *QUARTILES, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "mean",
            F.least("inner_low", "q1").alias("whisker_low"), F.greatest("inner_high", "q3").alias("whisker_high"),
            F.coalesce("n_outliers", F.lit(0).cast("bigint")).alias("n_outliers"),
        )
        .orderBy(*QUARTER)
    )


def quarter_outliers(hist: DataFrame) -> DataFrame:
    """(station, quarter, value, n): the values beyond the fences and how often they occur."""
    readings = _by_quarter(hist)
    boxes = _fences(readings, written(histogram(readings, QUARTER, "value"), "histogram"))
    known = readings.select(*QUARTER, F.col("value").cast("double").alias("value")).filter("value is not null")
    fenced = lookup_join(known, boxes, boxes.count(), QUARTER, ["value"])
    outside = fenced.filter("value < fence_low or value > fence_high")
    return outside.groupBy(*QUARTER, "value").agg(F.count("*").alias("n"))
