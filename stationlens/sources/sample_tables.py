"""The sample tables seen as station observations.

The tables hold no weather data, so stations, positions and readings are derived
from their columns; every row of a table becomes one observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlens.schema import REPORT_COLUMNS, TEXT_COLUMNS

# The indicators derived for lineitem and events.
LINEITEM_INDICATORS = ("tmpf", "dwpf", "relh", "drct")
EVENT_INDICATORS = ("tmpf", "relh", "feel")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(key: Column, factor: int, shift: int, origin: int) -> Column:
    return ((key * factor + shift) % 1400 + origin).cast("double") / F.lit(100.0)


def station_lon(key: Column) -> Column:
    return _hundredths(key, 37, 0, -500)


def station_lat(key: Column) -> Column:
    return _hundredths(key, 91, 0, 3900)


def point_lon(key: Column) -> Column:
    return _hundredths(key, 53, 17, -500)


def point_lat(key: Column) -> Column:
    return _hundredths(key, 67, 29, 3900)


def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as readings of the customer's nation."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("string").alias("station"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_totalprice").alias("tmpf"),
    )


def obs_events(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    """Events as readings of the user; an event of type ``error`` has none.

    ``hours`` widens the snapshots the ``hour`` column stands for.
    """
    key = F.col("user_id")
    lon, lat = station_lon(key), station_lat(key)
    reading = F.when(F.col("event_type") != "error", F.col("value"))
    hour = F.hour("ts")
    return table(spark, sf_dir, "events").select(
        key.cast("string").alias("station"),
        "ts",
        F.to_date("ts").alias("day"),
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.dayofmonth("ts").alias("day_of_month"),
        (hour - hour % hours).alias("hour"),
        F.minute("ts").alias("minute"),
        lon.alias("lon"),
        lat.alias("lat"),
        reading.alias("tmpf"),
        F.regexp_extract("props", r"(\d+)", 1).try_cast("double").alias("relh"),
        (10 * F.sin(lon / 3) + 5 * F.cos(lat / 2) + reading * F.lit(0.01)).alias("feel"),
        F.col("event_id").alias("_seq"),
    )


def obs_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings of the supplier; returned items lack ``tmpf``."""
    key = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        key.cast("string").alias("station"),
        F.to_date("l_shipdate").alias("day"),
        station_lon(key).alias("lon"),
        station_lat(key).alias("lat"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("tmpf"),
        F.col("l_extendedprice").alias("dwpf"),
        F.col("l_discount").alias("relh"),
        F.col("l_tax").alias("drct"),
    )


def points_of(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """(point_id, lon, lat) of each row of a table."""
    return table(spark, sf_dir, name).select(
        F.col(key).alias("point_id"), point_lon(F.col(key)).alias("lon"), point_lat(F.col(key)).alias("lat")
    )


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hourly report lines in text, with the faults real files have."""
    ts, second, minute = F.col("ts"), F.second("ts"), F.minute("ts")
    clock = (F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts))
    valid = (
        F.when(second == 0, F.lit("bad"))
        .when(second == 1, F.format_string("%04d-13-%02d %02d:00", clock[0], clock[2], clock[3]))
        .when(second <= 10, F.format_string("%d-%d-%d %d:0", *clock))
        .when(second <= 20, F.format_string("%04d-%02d-%02d %02d:00:59", *clock))
        .otherwise(F.format_string("%04d-%02d-%02d %02d:00", *clock))
    )
    lon = F.when(minute == 0, "").when(minute == 1, "null").otherwise(station_lon(F.col("user_id")).cast("string"))
    reading = (
        F.when(F.col("event_type") == "error", "null")
        .when(second == 30, "M")
        .when(second == 31, "NaN")
        .when(second == 32, "")
        .otherwise(F.col("value").cast("string"))
    )
    known = {
        "station": F.col("user_id").cast("string"),
        "valid": valid,
        "lon": lon,
        "lat": station_lat(F.col("user_id")).cast("string"),
        "tmpf": reading,
        "skyc1": F.when(F.col("event_type") == "error", "null").otherwise(F.col("event_type")),
        "metar": F.col("props"),
    }
    others = [c for c in REPORT_COLUMNS if c not in known and c not in TEXT_COLUMNS]
    for i, c in enumerate(others):  # every other number has values and gaps of its own
        known[c] = F.when(F.col("event_id") % (7 + i) == 0, "null").otherwise((F.col("event_id") % (50 + i)).cast("string"))
    columns = [known.get(c, F.lit("null")).alias(c) for c in REPORT_COLUMNS]
    return table(spark, sf_dir, "events").select(*columns, F.col("event_id").alias("_seq"))
