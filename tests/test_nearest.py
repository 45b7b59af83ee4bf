"""Nearest station against comparing everything with everything."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationlens.functions.geo import Grid, haversine_m
from stationlens.operators import nearest, skew
from stationlens.operators.nearest import nearest_station, resolve_points


def metres(lon1, lat1, lon2, lat2):
    """Arc between unit vectors: the angle whose sine and cosine are the cross and dot product."""

    def vector(lon, lat):
        lon, lat = np.radians(lon), np.radians(lat)
        return np.stack(np.broadcast_arrays(np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)), axis=-1)

    a, b = vector(lon1, lat1), vector(lon2, lat2)
    return 6371000.0 * np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(-1))


def frames(spark, points, stations):
    p = pd.DataFrame(points, columns=["lon", "lat"]).assign(point_id=np.arange(len(points)))
    s = pd.DataFrame(stations, columns=["lon", "lat"]).assign(station_seq=np.arange(len(stations)))
    s["station"] = "S" + s["station_seq"].astype(str)
    return spark.createDataFrame(p), spark.createDataFrame(s)


def check(spark, points, stations):
    p, s = frames(spark, points, stations)
    got = nearest_station(p, s).orderBy("point_id").toPandas()
    assert len(got) == len(points)
    d = metres(points[:, :1], points[:, 1:], stations[:, 0], stations[:, 1])
    assert np.allclose(got["distance_m"], d.min(axis=1), atol=1e-3)
    mine = d[np.arange(len(points)), got["station"].str[1:].astype(int)]
    assert np.allclose(mine, d.min(axis=1), atol=1e-3)


def sphere(rng, n):
    return np.column_stack([rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))])


def test_worldwide(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([sphere(rng, 400), [[180, 0], [-180, 0], [0, 90], [0, -90], [179.99, 10]]])
    check(spark, points, np.vstack([sphere(rng, 300), [[-179.99, 10.0]]]))


def test_one_dense_cluster(spark):
    """A third of the stations within a few metres, seen from near and far."""
    rng = np.random.default_rng(2)
    cluster = np.array([2.0, 48.0]) + rng.normal(0, 1e-4, (300, 2))
    near = np.array([2.0, 48.0]) + rng.normal(0, 1e-3, (100, 2))
    check(spark, np.vstack([near, sphere(rng, 100)]), np.vstack([cluster, sphere(rng, 600)]))


def test_long_dimension_is_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    rng = np.random.default_rng(3)
    check(spark, sphere(rng, 200), sphere(rng, 150))


def test_work_per_point_does_not_follow_the_number_of_stations(spark, monkeypatch):
    """Every join that carries points has few rows per point."""
    rng = np.random.default_rng(4)
    seen = []
    original = nearest.lookup_join

    def counting(*args, **kwargs):
        out = original(*args, **kwargs)
        seen.append(out)
        return out

    monkeypatch.setattr(nearest, "lookup_join", counting)
    p, s = frames(spark, sphere(rng, 100), sphere(rng, 20_000))
    nearest_station(p, s).count()
    steps = [step for step in seen if "point_id" in step.columns]
    assert len(steps) >= 3 and all(step.count() < 100 * 400 for step in steps)


def test_ties_and_empty_dimension(spark):
    p, s = frames(spark, np.array([[0.0, 0.0]]), np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]))
    assert nearest_station(p, s).first()["station"] == "S0"
    reordered = s.withColumn("station_seq", -F.col("station_seq"))
    assert nearest_station(p, reordered).first()["station"] == "S3"
    assert nearest_station(p, s.filter("false")).first()["station"] == ""


def test_resolve(spark):
    _, s = frames(spark, np.array([[0.0, 0.0]]), np.array([[1.0, 0.0], [5.0, 0.0]]))
    points = spark.sql(
        "select * from values (1, 'S1', null, null), (2, null, 0.5d, 0.5d) as t(point_id, station, lon, lat)"
    )
    assert {r.point_id: r.station for r in resolve_points(points, s).collect()} == {1: "S1", 2: "S0"}


def test_haversine_properties(spark):
    rng = np.random.default_rng(5)
    a, b = sphere(rng, 500), sphere(rng, 500)
    df = spark.createDataFrame(pd.DataFrame(np.hstack([a, b]), columns=["x1", "y1", "x2", "y2"]))
    out = df.select(
        haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("ab"),
        haversine_m(F.col("x2"), F.col("y2"), F.col("x1"), F.col("y1")).alias("ba"),
        haversine_m(F.col("x1"), F.col("y1"), F.col("x1"), F.col("y1")).alias("aa"),
        haversine_m(F.col("x1"), F.col("y1"), F.col("x1") + 180, -F.col("y1")).alias("far"),
    ).toPandas()
    assert np.allclose(out["ab"], out["ba"]) and (out["aa"] == 0).all()
    assert np.allclose(out["ab"], metres(a[:, 0], a[:, 1], b[:, 0], b[:, 1]))
    assert (out["ab"] <= np.pi * 6371000 + 1e-6).all() and np.allclose(out["far"], np.pi * 6371000)


@pytest.mark.parametrize("step,n", [(0.07, 200), (0.7, 20), (5.0, 3), (14.0, 1)])
def test_grid_size(step, n):
    grid = Grid(step=step)
    assert (grid.nx, grid.ny) == (n, n) == (len(np.arange(-5.0, 9.0, step)),) * 2


def test_stored_index_and_one_position(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    points, stations = sphere(rng, 60), sphere(rng, 500)
    p, s = frames(spark, points, stations)
    s = s.unionByName(spark.sql("select cast(null as double) as lon, 1d as lat, 900L as station_seq, 'lost' as station"))
    nearest.write_index(s, str(tmp_path))
    want = {r["point_id"]: r["station"] for r in nearest_station(p, s).collect()}

    def refused(*_):
        raise AssertionError("built again")

    monkeypatch.setattr(nearest, "_pyramid", refused)
    index = nearest.open_index(spark, str(tmp_path))
    assert {r["point_id"]: r["station"] for r in nearest_station(p, index).collect()} == want
    assert [nearest.nearest_to(lon, lat, s) for lon, lat in points[:10]] == [want[i] for i in range(10)]
    assert nearest.nearest_to(0.0, 0.0, s.filter("false")) == ""
