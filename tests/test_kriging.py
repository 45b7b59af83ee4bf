"""Semivariogram, fit, kriging and contour bands against direct computation."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as some

from stationlens.functions.geo import Grid
from stationlens.operators import kriging as kr
from stationlens.plans import indicator_map as im

KEYS = ["day", "hour"]
GRID = Grid(0.0, 0.0, 5.0, 5.0, 0.5)


def places(spark, x, y, z, hour=0):
    rows = [
        (float(a), float(b), None if v is None else float(v), hour, dt.date(2024, 1, 1)) for a, b, v in zip(x, y, z)
    ]
    return spark.createDataFrame(rows, "lon double, lat double, z double, hour int, day date")


def field(rng, n):
    x, y = rng.uniform(0, 5, n), rng.uniform(0, 5, n)
    return x, y, 10 * np.sin(x / 2) + 3 * np.cos(y) + rng.normal(0, 0.3, n)


def model_row(spark, nugget, psill, reach):
    return spark.createDataFrame(
        [(dt.date(2024, 1, 1), 0, nugget, psill, reach)], "day date, hour int, nugget double, psill double, range double"
    )


def bins_by_hand(x, y, z, lags=6):
    i, j = np.triu_indices(len(x), 1)
    h, g = np.hypot(x[i] - x[j], y[i] - y[j]), 0.5 * (z[i] - z[j]) ** 2
    k = np.minimum(((h - h.min()) / ((h.max() - h.min()) / lags)).astype(int), lags - 1)
    return {b: ((k == b).sum(), h[k == b].mean(), g[k == b].mean()) for b in range(lags) if (k == b).any()}


@pytest.mark.parametrize("block", [7, 25, 512])
def test_semivariogram_in_blocks(spark, block):
    x, y, z = field(np.random.default_rng(0), 60)
    both = places(spark, x, y, z).unionByName(places(spark, [1.0], [1.0], [5.0], hour=1))
    got = kr.semivariogram(both, KEYS, block=block).toPandas()
    want = bins_by_hand(x, y, z)
    assert set(got["hour"]) == {0} and set(got["bin"]) == set(want)
    for _, r in got.iterrows():
        n, lag, gamma = want[r["bin"]]
        assert r["n"] == n and r["lag"] == pytest.approx(lag) and r["gamma"] == pytest.approx(gamma)


def test_fit_recovers_the_model(spark):
    h = np.linspace(0.5, 10, 6)
    gamma = kr.gamma(h, 0.4, 2.5, 6.0)
    bins = spark.createDataFrame(
        pd.DataFrame({"day": dt.date(2024, 1, 1), "hour": 0, "bin": range(6), "n": 9, "lag": h, "gamma": gamma})
    )
    fit = kr.variogram_fit(bins, KEYS).first()
    assert (fit.nugget, fit.psill, fit.range) == (pytest.approx(0.4), pytest.approx(2.5), pytest.approx(6.0))
    falling = bins.selectExpr("day", "hour", "bin", "n", "lag", "10 - lag as gamma")
    flat = kr.variogram_fit(falling, KEYS).first()
    assert flat.psill == 0 and flat.nugget == pytest.approx((10 - h).mean())


def semivariances(h, nugget, psill, reach):
    """Gaussian model with the least nugget."""
    nugget = max(nugget, 1e-4 * psill)
    return np.where(h < 1e-9, 0.0, nugget + psill * (1 - np.exp(-((h / (reach * 4 / 7)) ** 2))))


@pytest.mark.parametrize("model, block", [((0.3, 20.0, 4.0), 512), ((1.0, 0.0, 1.0), 512), ((0.0, 20.0, 3.0), 14)])
def test_surface_equals_one_solve_per_cell(spark, model, block):
    x, y, z = field(np.random.default_rng(1), 40)
    weights = kr.krige_weights(places(spark, x, y, z), model_row(spark, *model), KEYS, block=block)
    got = kr.krige_surface(weights, KEYS, GRID, variance=True).orderBy("iy", "ix").toPandas()
    assert len(got) == GRID.nx * GRID.ny
    plain = kr.krige_surface(weights, KEYS, GRID).orderBy("iy", "ix").toPandas()
    assert np.allclose(plain["z"], got["z"], rtol=0, atol=1e-8)
    a = np.ones((41, 41))
    a[:40, :40] = semivariances(np.hypot(x[:, None] - x, y[:, None] - y), *model)
    a[40, 40] = 0
    for _, c in got.iloc[::7].iterrows():
        b = np.append(semivariances(np.hypot(x - c["lon"], y - c["lat"]), *model), 1.0)
        s = np.linalg.solve(a, b)
        assert s[:-1].sum() == pytest.approx(1)
        assert c["z"] == pytest.approx(s[:-1] @ z, abs=1e-6)
        assert c["variance"] == pytest.approx(s @ b, abs=1e-6)


def test_exact_at_stations_with_zero_variance(spark):
    rng = np.random.default_rng(2)
    cells = [(i, j) for i in range(0, 10, 2) for j in range(0, 10, 2)]
    x, y = (np.array(c) * 0.5 for c in zip(*cells))
    z = rng.normal(0, 5, len(x))
    weights = kr.krige_weights(places(spark, x, y, z), model_row(spark, 0.2, 9.0, 3.0), KEYS)
    got = kr.krige_surface(weights, KEYS, GRID, variance=True).toPandas().set_index(["ix", "iy"])
    for (i, j), v in zip(cells, z):
        assert got.loc[(i, j), "z"] == pytest.approx(v, abs=1e-6)
        assert got.loc[(i, j), "variance"] == pytest.approx(0, abs=1e-6)
    assert (got["variance"] > -1e-9).all() and got["variance"].max() > 0


def test_degenerate_snapshots(spark):
    rows = (
        places(spark, [1.0], [1.0], [5.0], hour=0)
        .unionByName(places(spark, [1.0, 2.0, 3.0], [1.0, 1.0, 2.0], [4.0] * 3, hour=1))
        .unionByName(places(spark, [1.0, 2.0], [1.0, 1.0], [4.0, 6.0], hour=2))
    )
    out = im.indicator_surface(rows, "z", GRID, variance=True).toPandas()
    assert not out.isna().any().any()
    assert out.groupby("hour").size().to_dict() == {0: 100, 1: 100, 2: 100}
    assert np.allclose(out[out["hour"] == 0]["z"], 5) and np.allclose(out[out["hour"] == 1]["z"], 4)
    two = out[out["hour"] == 2]["z"]
    assert two.min() >= 4 - 1e-9 and two.max() <= 6 + 1e-9


def test_near_singular_system_stays_finite(spark):
    x, y, z = field(np.random.default_rng(3), 120)
    weights = kr.krige_weights(places(spark, x, y, z), model_row(spark, 0.0, 30.0, 8.0), KEYS)
    out = kr.krige_surface(weights, KEYS, GRID).toPandas()
    assert np.isfinite(out["z"]).all()


def test_large_snapshot_beside_a_small_one_reproduces_its_stations(spark):
    rng = np.random.default_rng(4)
    grid = Grid(0.0, 0.0, 5.0, 5.0, 0.25)
    at = [(i * 0.25, j * 0.25) for i in range(20) for j in range(20)]
    x = np.append(rng.uniform(0, 5, 5600), [c[0] for c in at])
    y = np.append(rng.uniform(0, 5, 5600), [c[1] for c in at])
    z = 10 * np.sin(x / 2) + 3 * np.cos(y) + rng.normal(0, 0.3, 6000)
    both = places(spark, x, y, z).unionByName(places(spark, x[5590:5610], y[5590:5610], z[5590:5610], hour=1))
    model = model_row(spark, 0.0, 30.0, 4.0).unionByName(model_row(spark, 0.1, 30.0, 4.0).selectExpr("day", "1 as hour", "nugget", "psill", "range"))
    solved = kr.krige_weights(both, model, KEYS, block=1024)
    sizes = {r["hour"]: r["parts"] for r in solved.blocks.select("hour", "parts").distinct().collect()}
    assert sizes == {0: 6, 1: 1}
    got = kr.krige_surface(solved, KEYS, grid).toPandas()
    large = got[got["hour"] == 0].set_index(["ix", "iy"])["z"]
    assert len(got) == 800
    assert np.abs([large[i, j] - z[5600 + 20 * i + j] for i in range(20) for j in range(20)]).max() < 1e-6


def test_variance_of_several_blocks(spark):
    rng = np.random.default_rng(6)
    x, y, z = field(rng, 300)
    model = model_row(spark, 0.2, 9.0, 3.0)
    one, many = (kr.krige_surface(kr.krige_weights(places(spark, x, y, z), model, KEYS, block=b), KEYS, GRID, variance=True) for b in (512, 110))
    one, many = (df.orderBy("iy", "ix").toPandas() for df in (one, many))
    assert np.allclose(one["z"], many["z"], rtol=0, atol=1e-8) and np.allclose(one["variance"], many["variance"], rtol=0, atol=1e-8)
    assert one["variance"].min() > 0


def test_factor_of_a_matrix_rounding_made_indefinite():
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    square = q @ np.diag([5, 3, 1, 0.5, 1e-3, -1e-12]) @ q.T
    low = kr._triangle(square, 1e-4)
    assert np.allclose(np.triu(low, 1), 0) and (np.diag(low) > 0).all()
    assert np.allclose(low @ low.T, square, atol=2e-4)


def test_extents_without_all_pairs(spark):
    rng = np.random.default_rng(8)
    clouds = [
        rng.uniform(0, 5, (200, 2)), np.round(rng.uniform(0, 3, (80, 2)), 1), np.column_stack([np.arange(30.0), np.arange(30.0)]),
        np.vstack([rng.normal(0, 1e-4, (60, 2)), rng.uniform(-5, 5, (60, 2))]), np.array([[1.0, 2.0]]), np.array([[1.0, 2.0], [1.0, 3.5]]),
        np.column_stack([np.cos(np.arange(50)), np.sin(np.arange(50))]),
    ]
    clouds = [np.unique(c, axis=0) for c in clouds]
    table = None
    for hour, c in enumerate(clouds):
        part = places(spark, c[:, 0], c[:, 1], np.zeros(len(c)), hour=hour)
        table = part if table is None else table.unionByName(part)
    for block in (6, 512):
        owned, pairs = kr._in_blocks(table, KEYS, block)
        got = {r["hour"]: (r["h_min"], r["h_max"]) for r in kr._extents(owned, KEYS, block).collect()}
        want = {}
        for hour, c in enumerate(clouds):
            i, j = np.triu_indices(len(c), 1)
            if len(i):
                h = np.hypot(*(c[i] - c[j]).T)
                want[hour] = (h.min(), h.max())
        assert set(got) == set(want) and pairs > 0
        for hour, ends in want.items():
            assert got[hour] == pytest.approx(ends, rel=1e-12)


def test_repeated_location_is_averaged(spark):
    rows = places(spark, [1.0, 1.0, 2.0], [1.0, 1.0, 2.0], [4.0, 6.0, None])
    out = kr.location_means(rows, KEYS, "z").collect()
    assert [(r.lon, r.lat, r.z) for r in out] == [(1.0, 1.0, 5.0)]


def test_bands(spark):
    z = [-1.0, 0.0, 0.5, 9.89, 9.91, 10.0, 11.0, None]
    surface = places(spark, range(8), range(8), z)
    bounds = spark.sql("select date'2024-01-01' as day, 0 as hour, 0d as low, 9.9d as high")
    bands = im.contour_bands(surface, bounds).orderBy("lon").collect()
    assert [r.band for r in bands] == [0, 1, 6, 99, 100, 100, 100, None]
    same = spark.sql("select date'2024-01-01' as day, 0 as hour, 5d as low, 5d as high")
    assert {r.band for r in im.contour_bands(surface, same).collect()} == {1, None}


def test_map_of_one_hour_and_storage(spark, tmp_path):
    x, y, z = field(np.random.default_rng(5), 50)
    obs = places(spark, x, y, z, hour=3).unionByName(places(spark, x, y, z * 9, hour=4))
    one = im.indicator_map(obs, 2024, 1, 1, 3, "z", GRID)
    got = one.toPandas()
    assert len(got) == 100 and set(got["hour"]) == {3} and got["band"].between(0, 100).all()
    assert im.indicator_map(obs, 2024, 1, 1, 9, "z", GRID).count() == 0
    path = str(tmp_path / "surface")
    im.write_surface(one, path)
    wide = im.wide_surface(spark.read.parquet(path), GRID.nx).orderBy("iy").toPandas()
    assert wide.shape == (10, 3 + 10)
    assert wide.loc[4, "x7"] == got.set_index(["ix", "iy"]).loc[(7, 4), "z"]


@given(
    some.lists(some.floats(0, 50), min_size=1, max_size=20),
    some.floats(0, 5),
    some.floats(0, 50),
    some.floats(0.1, 30),
)
def test_gamma_rises_from_zero(h, nugget, psill, reach):
    h = np.sort(np.array([0.0, *h]))
    g = kr.gamma(h, nugget, psill, reach)
    assert g[0] == 0 and (np.diff(g) >= -1e-12).all() and g.max() <= nugget + psill + 1e-9
