"""K-means against a plain loop."""

import numpy as np
import pandas as pd
import pytest

from stationlens.operators import clustering as cl

FEATURES = ["a", "b", "c"]


def table(spark, x):
    df = pd.DataFrame(x, columns=FEATURES)
    df.insert(0, "station", [f"{i:05d}" for i in range(len(x))])
    return spark.createDataFrame(df)


def lloyd(x, centres, max_iter, eps):
    centres = np.array(centres, dtype=float)
    for _ in range(max_iter):
        label = np.sqrt(((x[:, None] - centres) ** 2).sum(-1)).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(len(centres))])
        shift = np.sqrt(((new - centres) ** 2).sum())
        centres = new
        if shift <= eps:
            break
    return centres, np.sqrt(((x[:, None] - centres) ** 2).sum(-1)).argmin(1)


def test_same_as_a_loop(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.5, (80, 3)) for c in (0, 2, 5)])
    points = table(spark, x)
    start = points.orderBy("station").limit(4)
    got = cl.kmeans(points, ["station"], FEATURES, 4, start).orderBy("station").toPandas()
    _, want = lloyd(x, x[:4], 1000, 1e-4)
    assert list(got["label"]) == list(want)


def test_empty_cluster_keeps_its_centre_and_inertia_falls(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (100, 3))
    points = table(spark, x).cache()
    centres = [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [99.0, 99.0, 99.0]]
    last = np.inf
    for _ in range(4):
        inertia = (cl.assign(points, FEATURES, centres).toPandas()["distance"] ** 2).sum()
        assert inertia <= last + 1e-9
        last = inertia
        centres, _ = cl.step(points, FEATURES, centres)
        assert centres[2] == [99.0, 99.0, 99.0]


def test_lowest_centre_wins_ties(spark):
    points = table(spark, np.zeros((3, 3)))
    out = cl.assign(points, FEATURES, [[1.0, 0, 0], [-1.0, 0, 0], [0, 1.0, 0]]).toPandas()
    assert set(out["label"]) == {0} and set(out["distance"]) == {1.0}


def test_scaling(spark):
    x = np.array([[1.0, 5.0, -2.0], [3.0, 5.0, 0.0], [2.0, 5.0, 2.0]])
    out = cl.minmax_scale(table(spark, x), FEATURES).orderBy("station").toPandas()
    assert np.array_equal(out[FEATURES], [[0, 0, 0], [1, 0, 0.5], [0.5, 0, 1]])


def test_seeded_start(spark):
    points = table(spark, np.random.default_rng(2).normal(0, 1, (50, 3)))
    one = cl.sample_centres(points, ["station"], FEATURES, 7, seed=1).collect()
    assert one == cl.sample_centres(points.repartition(13), ["station"], FEATURES, 7, seed=1).collect()
    assert one != cl.sample_centres(points, ["station"], FEATURES, 7, seed=2).collect()
    assert len({r.station for r in one}) == 7 and [r.centre for r in one] == list(range(7))


def test_bad_arguments(spark):
    points = table(spark, np.zeros((3, 3)))
    with pytest.raises(ValueError, match="only 3 points"):
        cl.kmeans(points, ["station"], FEATURES, 4)
    with pytest.raises(ValueError):
        cl.kmeans(points, ["station"], FEATURES, 0)
    with pytest.raises(ValueError):
        cl.fit(points, FEATURES, [[0.0, 0.0, 0.0]], max_iter=0)


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_centres_do_not_depend_on_the_partitions(spark, parts):
    x = np.random.default_rng(9).random((400, 3))
    points = table(spark, x).repartition(parts, "station")
    found = cl.fit(points, FEATURES, x[:4].tolist())
    assert found == cl.fit(table(spark, x).coalesce(1), FEATURES, x[:4].tolist())


def test_cluster_pipeline_rounds_places_half_even(spark):
    from stationlens.plans import space_clusters as sc

    obs = spark.sql(
        "select * from values ('A', date'2024-01-01', 0.125d, 1d, 1d), ('A', date'2024-01-02', 0.125d, 1d, 3d),"
        "('B', date'2024-01-01', 2.5d, 3d, cast(null as double)), ('C', date'2024-01-03', 2.5d, 3d, 9d)"
        " as t(station, day, lon, lat, tmpf)"
    )
    out = sc.period_features(obs, "2024-01-01 13:00", "2024-01-02", ["tmpf"]).collect()
    assert [tuple(r) for r in out] == [("A", 0.12, 1.0, 0.125, 1.0, 2.0)]
    labels = sc.cluster_period(obs, "2024-01-01", "2024-01-31", k=2, indicators=["tmpf"]).collect()
    assert {r.station for r in labels} == {"A", "C"} and len({r.label for r in labels}) == 2
    layer = sc.cluster_map_layer(obs, "2024-01-01", "2024-01-31", k=1, indicators=["tmpf"])
    assert layer.columns == ["lon", "lat", "label", "popup"]


@pytest.mark.parametrize("k", [1, 5, 12])
def test_bounds_skip_points_and_change_nothing(spark, k):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, 0.6, (300, 3)) for c in (0, 1.5, 3, 6)])
    points = table(spark, x).repartition(3).cache()
    looked_at: list[int] = []
    start = x[rng.choice(len(x), k, replace=False)].tolist()
    got = cl.fit(points, FEATURES, start, eps=1e-6, looked_at=looked_at)
    centres, rounds = start, 0
    while True:
        centres, shift = cl.step(points, FEATURES, centres)
        rounds += 1
        if shift <= 1e-6:
            break
    assert got == centres and len(looked_at) == rounds
    assert looked_at[0] == len(x)
    assert k == 1 or sum(looked_at) < 0.6 * rounds * len(x)


def test_copies_of_a_centre_keep_the_lowest_label(spark):
    x = np.vstack([np.zeros((5, 3)), np.ones((5, 3))])
    got = cl.fit(table(spark, x), FEATURES, [[0.0] * 3, [0.0] * 3, [1.5] * 3])
    assert got == [[0.0] * 3, [0.0] * 3, [1.0] * 3]


def test_rounding_decides_by_the_binary_value(spark):
    from stationlens.functions.stats import round_exact

    rng = np.random.default_rng(3)
    values = [0.125, 0.375, -0.125, 2.675, 1.005, 1.115, -2.675, 0.0, -0.005, 0.005, 0.015, 1e17, -3.5e300, 5e-324, 0.994999999999, 179.995, 2.0**45 + 0.125]
    values += (rng.integers(-20_000_000, 20_000_000, 4000) / 1000).tolist() + rng.normal(0, 100, 2000).tolist()
    values += [np.nextafter(v, w) for v in (0.125, 1.115, 8.0, 0.01) for w in (-9, 9)]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = [r[0] for r in df.select(round_exact(df["v"], 2)).collect()]
    assert got == [round(v, 2) for v in values]
