"""Nearest-station join without comparing every point with every station.

Stations are put into cells of a cube grid around the unit sphere, at several
levels of detail; each occupied cell keeps one of its stations. The stations
kept for the cells a point lies in bound its distance to the nearest one, so
only the few cells within that bound are looked at, and crowded cells among them
are narrowed down level by level. The answer is exact, and the work per point
does not grow with the number of stations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationlens.functions.geo import haversine_m, unit_vector
from stationlens.operators.skew import lookup_join
from stationlens.session import written

_DEEPEST = 18  # cell edge 2 / 2**level, down to some 50 m
_LEVELS = range(0, _DEEPEST + 1, 2)
_CROWDED = 16  # cells with more locations are narrowed down
_SLACK = 1e-7  # rounding margin on unit-sphere distances

_SIDE = "shiftleft(1L, level)"
_DIAMETER = f"({2 * math.sqrt(3)!r}D / {_SIDE} + {_SLACK!r}D)"
_CHORD = "sqrt((px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z))"
_POINT = ("point_id", "plon", "plat", "px", "py", "pz")


def _index(value: str) -> str:
    """Cell index of a coordinate along one axis at the column ``level``."""
    return f"cast(least(greatest(floor(({value} + 1) / 2 * {_SIDE}), 0), {_SIDE} - 1) as bigint)"


def _node(ix: str, iy: str, iz: str) -> str:
    return f"shiftleft(cast(level as bigint), 54) + shiftleft({ix}, 36) + shiftleft({iy}, 18) + {iz}"


def _nodes_of(df: DataFrame, *xyz: str) -> DataFrame:
    """One row per level with the cell ``node`` the position lies in."""
    levels = ", ".join(map(str, _LEVELS))
    return df.selectExpr("*", f"explode(array({levels})) as level").selectExpr(
        "*", f"{_node(*map(_index, xyz))} as node"
    )


def _places(stations: DataFrame) -> DataFrame:
    """One row per location with the station that comes first in order."""
    x, y, z = unit_vector(F.col("lon"), F.col("lat"))
    return (
        stations.filter("lon is not null and lat is not null")
        .groupBy(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
        .agg(F.min_by(F.struct("station", "station_seq"), "station_seq").alias("first"))
        .select("lon", "lat", "first.station", "first.station_seq", x.alias("x"), y.alias("y"), z.alias("z"))
    )


def _pyramid(homes: DataFrame) -> DataFrame:
    """(level, node, n, x, y, z, parent, parent_n): occupied cells, each with one of its stations."""
    cells = (
        homes.groupBy("level", "node")
        .agg(F.count("*").alias("n"), F.min_by(F.struct("x", "y", "z"), "station_seq").alias("rep"))
        .select("level", "node", "n", "rep.x", "rep.y", "rep.z")
    )
    siblings = Window.partitionBy("parent")  # at most 64 cells
    return (
        cells.filter("level > 0")
        .withColumns({"own_level": F.col("level"), "level": F.greatest(F.col("level") - 2, F.lit(0))})
        .withColumn("parent", F.expr(_node(*map(_index, "xyz"))))
        .withColumns({"level": F.col("own_level"), "parent_n": F.sum("n").over(siblings)})
        .drop("own_level")
        .unionByName(cells.filter("level = 0").selectExpr("*", "cast(null as bigint) as parent", "0L as parent_n"))
    )


@dataclass(frozen=True)
class StationIndex:
    """The places of the stations, the cells they lie in, and how long these tables are.

    ``crowded`` are the levels with cells that have to be narrowed down.
    """

    places: DataFrame
    pyramid: DataFrame
    rows: int
    crowded: tuple[int, ...]


_INDEX = ("places", "pyramid")


def _opened(places: DataFrame, pyramid: DataFrame) -> StationIndex:
    crowded = pyramid.filter(f"n > {_CROWDED} and level < {_DEEPEST}").select("level").distinct().collect()
    return StationIndex(places, pyramid, places.count() * len(_LEVELS), tuple(sorted(r["level"] for r in crowded)))  # at most nine


def station_index(stations: DataFrame) -> StationIndex:
    """The index of ``stations``, as intermediate tables."""
    places = written(_places(stations), "places")
    return _opened(places, written(_pyramid(_nodes_of(places, "x", "y", "z")), "pyramid"))


def write_index(stations: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Store the index of ``stations`` below ``root``."""
    spark = stations.sparkSession
    _places(stations).write.mode(mode).parquet(f"{root}/places")
    places = spark.read.parquet(f"{root}/places")
    _pyramid(_nodes_of(places, "x", "y", "z")).write.mode(mode).parquet(f"{root}/pyramid")


def open_index(spark: SparkSession, root: str) -> StationIndex:
    """The index stored by :func:`write_index`."""
    return _opened(*[spark.read.parquet(f"{root}/{name}") for name in _INDEX])


def nearest_to(lon: float, lat: float, stations: DataFrame) -> str:
    """The station nearest to one position, ``''`` if no station has a place: one pass over the dimension."""
    d = haversine_m(F.col("lon").cast("double"), F.col("lat").cast("double"), F.lit(float(lon)), F.lit(float(lat)))
    first = stations.filter("lon is not null and lat is not null").agg(F.min_by("station", F.struct(d, "station_seq"))).first()[0]
    return first or ""


def nearest_station(points: DataFrame, stations: DataFrame | StationIndex) -> DataFrame:
    """(point_id, lon, lat) x (station, lon, lat, station_seq) -> the nearest one.

    ``stations`` is the dimension or its index (:func:`station_index`, :func:`open_index`).

    Returns ``point_id, station, distance_m``; of equally near stations the one
    with the lowest ``station_seq`` wins. A point without coordinates, or with an
    empty dimension, gets the station ``''`` and no distance. Each distinct
    (point_id, lon, lat) gives one row.
    """
    spark = points.sparkSession
    blank = (F.lit("").alias("station"), F.lit(None).cast("double").alias("distance_m"))
    lost = points.filter("lon is null or lat is null").select("point_id", "lon", "lat").distinct().select("point_id", *blank)
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    x, y, z = unit_vector(lon, lat)
    points = points.filter("lon is not null and lat is not null").select(
        "point_id", lon.alias("plon"), lat.alias("plat"), x.alias("px"), y.alias("py"), z.alias("pz")
    )
    index = stations if isinstance(stations, StationIndex) else station_index(stations)
    rows, pyramid = index.rows, index.pyramid  # no table below is longer
    if rows == 0:
        return points.select("point_id", "plon", "plat").distinct().select("point_id", *blank).unionByName(lost)
    homes = _nodes_of(index.places, "x", "y", "z")

    # Few bytes per point, much work: partitions of a stated number are not merged by size.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = _nodes_of(points.repartition(tasks, "point_id"), "px", "py", "pz")
    kept = pyramid.select("node", "x", "y", "z")
    bounded = (
        lookup_join(own, kept, rows, ["node"], ["point_id"])
        .groupBy(*_POINT)
        .agg(F.min(F.expr(_CHORD)).alias("reach"))
    )

    # Cells within reach, at the finest level whose cells are no smaller than the reach.
    level = f"greatest(0, least({_DEEPEST}, 2 * cast(floor(log2(2 / (reach + {_SLACK!r}D)) / 2) as int)))"
    around = bounded.selectExpr("*", f"{level} as level")
    for c in "xyz":
        low, high = _index(f"p{c} - reach - {_SLACK!r}D"), _index(f"p{c} + reach + {_SLACK!r}D")
        around = around.selectExpr("*", f"explode(sequence({low}, {high})) as i{c}")
    around = around.selectExpr(*_POINT, "reach", "level", f"{_node('ix', 'iy', 'iz')} as node")
    frontier = (
        lookup_join(around, kept, rows, ["node"], ["point_id"])
        .selectExpr(*_POINT, "reach", "level", "node", f"{_CHORD} as d")
        .filter(f"d - {_DIAMETER} <= reach")
        .sortWithinPartitions("point_id", "plon", "plat")  # kept by the joins below, so their windows need no sort
    )

    per_point = Window.partitionBy("point_id", "plon", "plat")
    for at in index.crowded:
        inner = pyramid.filter(f"level = {at + 2} and parent_n > {_CROWDED}").selectExpr(
            "parent as node", "node as inner", "x", "y", "z"
        )
        frontier = (
            lookup_join(frontier, inner, rows, ["node"], ["point_id"], how="left")
            .selectExpr(
                *_POINT, "reach", f"if(inner is null, level, {at + 2}) as level",
                "coalesce(inner, node) as node", f"coalesce({_CHORD}, d) as d",
            )
            .withColumn("reach", F.least("reach", F.min("d").over(per_point)))
            .filter(f"d - {_DIAMETER} <= reach")
        )

    small = pyramid.filter(f"n <= {_CROWDED} or level = {_DEEPEST}").select("node")
    leaves = lookup_join(homes, small, rows, ["node"], ["station_seq"]).select(
        "node", "lon", "lat", "station", "station_seq"
    )
    found = lookup_join(frontier, leaves, rows, ["node"], ["point_id"]).withColumn(
        "_d", haversine_m(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    )
    best = found.groupBy("point_id", "plon", "plat").agg(F.min(F.struct("_d", "station_seq", "station")).alias("best"))
    return best.select("point_id", "best.station", F.col("best._d").alias("distance_m")).unionByName(lost)


def resolve_points(points: DataFrame, stations: DataFrame | StationIndex) -> DataFrame:
    """Station of each requested point, given as a station id or as coordinates."""
    named = points.filter("station is not null").select("point_id", "station")
    placed = nearest_station(points.filter("station is null").select("point_id", "lon", "lat"), stations)
    return named.unionByName(placed.select("point_id", "station"))
