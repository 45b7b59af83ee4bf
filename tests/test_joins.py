"""Salted joins, written tables, and histories of requested points."""

import datetime as dt

import pytest

from stationlens import session
from stationlens.operators import skew
from stationlens.plans import point_history as ph


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id % 40) as k", "id")
    small = spark.range(30).selectExpr("id as k", "id * 10 as w")
    want = sorted(map(str, big.join(small, "k", how).collect()))
    for salts in (1, 7, 32):
        got = skew.salted_join(big, small, ["k"], ["id"], salts, how).select("k", "id", "w")
        assert sorted(map(str, got.collect())) == want


def test_hot_key_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(64_000).selectExpr("1 as k", "id")
        joined = skew.salted_join(big, spark.sql("select 1 as k, 2 as w"), ["k"], ["id"])
        sizes = joined.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 64_000 / 3


@pytest.mark.parametrize("limit", [0, 500_000])
def test_lookup_join_by_size(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    big = spark.range(100).selectExpr("id % 5 as k", "id")
    table = spark.range(3).selectExpr("id as k", "'x' as w")
    assert skew.lookup_join(big, table, 3, ["k"], ["id"]).count() == 60


def test_history_of_points(spark):
    obs = spark.createDataFrame(
        [(s, dt.datetime(2024, 1, d), 2024, 1, dt.date(2024, 1, d), float(d)) for s in "ABC" for d in (1, 2)],
        "station string, ts timestamp_ntz, year int, month int, day date, tmpf double",
    )
    stations = spark.sql(
        "select * from values ('A', 0d, 0d, 0), ('B', 3d, 3d, 1), ('C', 8d, 8d, 2) as t(station, lon, lat, station_seq)"
    )
    near_b = ph.history_of_coordinates(obs, 3.4, 2.9, stations, "tmpf")
    assert near_b.columns == ["station", "year", "month", "day", "value"]
    assert sorted((r.station, r.value) for r in near_b.collect()) == [("B", 1.0), ("B", 2.0)]
    points = spark.sql(
        "select * from values (1, 'A', null, null), (2, null, 3d, 3d), (3, null, 2.9d, 3d)"
        " as t(point_id, station, lon, lat)"
    )
    served = ph.history_of_points(obs, points, stations, "tmpf").select("station", "n_points").distinct().collect()
    assert {tuple(r) for r in served} == {("A", 1), ("B", 2)}
    assert ph.history_of_station(obs, "C", "tmpf").count() == 2


def test_written_tables_live_in_the_shared_folder(spark):
    df = session.written(spark.range(3), "probe")
    assert df.count() == 3
    path = df.inputFiles()[0]
    assert session.shared_dir(spark).removeprefix("file:") in path and spark.sparkContext.applicationId in path


def test_broadcast_is_bounded_in_bytes(spark, monkeypatch):
    from stationlens.operators import skew

    wide = spark.sql("select 1L as k, array('a') as names, named_struct('x', 1d, 'y', 'b') as s")
    assert skew.row_bytes(wide.schema) == 8 + 16 * 64 + 72
    assert skew.fits_broadcast(wide, 100_000) and not skew.fits_broadcast(wide, 200_000)
    assert not skew.fits_broadcast(wide.select("k"), 600_000)
    big = spark.range(1000).selectExpr("id % 2 as k", "id")
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 10)
    joined = skew.lookup_join(big, wide, 1, ["k"], ["id"])
    assert joined.count() == 500 and "BroadcastHint" not in joined._jdf.queryExecution().logical().toString()
