"""The physical tables of an observation set and the scans they serve.

``obs_by_station``  sorted by (station, time): history of one point.
``obs_by_instant``  directory per day, sorted by (hour, minute, station): maps of
                    an hour and scans of a period.
``stations``        one row per station.
``station_index``   the places of the stations and the cells they lie in, for nearest
                    stations of many points (``operators.nearest.open_index``).

Rows are range-partitioned on the full sort key, so a station or a day holding a
large share of the rows is split over many tasks and files instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stationlens.operators.nearest import write_index
from stationlens.session import written

STATION_ORDER = ("station", "ts")
INSTANT_ORDER = ("day", "hour", "minute", "station")
TABLES = ("obs_by_station", "obs_by_instant", "stations")


def _write(df: DataFrame, path: str, mode: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write and return the number of rows written, counted on the way."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return seen.get["rows"]


def _ordered(obs: DataFrame, order: tuple[str, ...], files: int | None) -> DataFrame:
    ranges = obs.repartitionByRange(files, *order) if files else obs.repartitionByRange(*order)
    return ranges.sortWithinPartitions(*order)


def write_by_station(obs: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> int:
    """``files`` sets how many ranges are cut; else the shuffle partitions of the session."""
    return _write(_ordered(obs, STATION_ORDER, files), path, mode)


def write_by_instant(obs: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> int:
    return _write(_ordered(obs, INSTANT_ORDER, files), path, mode, ("day",))


def station_dimension(obs: DataFrame) -> DataFrame:
    """(station, lon, lat, station_seq): last complete coordinates, place of first appearance.

    A station that never had both coordinates keeps NULL ones.

    Rows are first reduced to one per coordinates a station ever had.
    """
    places = obs.groupBy(
        "station", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")
    ).agg(F.max("_seq").alias("last"), F.min("_seq").alias("first"))
    return (
        places.groupBy("station")
        .agg(
            F.max_by(F.struct("lon", "lat"), F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.col("last"))).alias("at"),
            F.min("first").alias("station_seq"),
        )
        .select("station", "at.lon", "at.lat", "station_seq")
    )


def build_layouts(obs: DataFrame, root: str, mode: str = "overwrite", files: int | None = None) -> dict[str, int]:
    """Write all tables below ``root`` and return their row counts.

    The input is parsed and deduplicated once; the other tables are made from
    the first one.
    """
    spark = obs.sparkSession
    counts = {"obs_by_station": write_by_station(obs, f"{root}/obs_by_station", mode, files)}
    stored = spark.read.schema(obs.schema).parquet(f"{root}/obs_by_station")
    counts["obs_by_instant"] = write_by_instant(stored, f"{root}/obs_by_instant", mode, files)
    counts["stations"] = _write(station_dimension(stored), f"{root}/stations", mode)
    write_index(spark.read.parquet(f"{root}/stations"), f"{root}/station_index", "overwrite")
    return counts


def open_layouts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables written by :func:`build_layouts`, also as views for ``spark.sql``."""
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in TABLES}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return tables


def station_rows(obs: DataFrame, station: str) -> DataFrame:
    return obs.filter(F.col("station") == station)


def hour_rows(obs: DataFrame, year: int, month: int, day: int, hour: int) -> DataFrame:
    date = F.make_date(F.lit(year), F.lit(month), F.lit(day))
    return obs.filter((F.col("day") == date) & (F.col("hour") == hour))


def period_rows(obs: DataFrame, start, end) -> DataFrame:
    """Rows of the days from ``start`` to ``end``, both included."""
    return obs.filter(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def day_coverage(obs: DataFrame, start=None, end=None) -> DataFrame:
    """(day, n) for every day of the period, 0 where there is no row.

    Without bounds the period runs from the first to the last day present.
    """
    if start is not None:
        obs = period_rows(obs, start, end)
    counts = written(obs.groupBy("day").agg(F.count("*").alias("n")), "day-counts")
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    if start is not None:
        span = span.select(F.to_date(F.lit(start)).alias("a"), F.to_date(F.lit(end)).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
