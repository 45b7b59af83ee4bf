"""Quantiles, box statistics and seasonal tables."""

import numpy as np
import pandas as pd
import pytest

from stationlens.operators.quantiles import exact_quantiles
from stationlens.plans import point_history as ph

PROBS = {"p0": 0.0, "p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p100": 1.0}


@pytest.mark.parametrize("seed, sorted_rows", [(0, 65536), (1, 65536), (2, 0), (3, 20)])
def test_quantiles_equal_numpy(spark, seed, sorted_rows):
    rng = np.random.default_rng(seed)
    groups = {
        "hot": rng.lognormal(0, 6, 20_000) * rng.choice([-1, 1], 20_000),
        "ties": rng.integers(-3, 3, 500).astype(float),
        "one": np.array([7.25]),
        "float32": rng.normal(60, 20, 3000).astype(np.float32).astype(float),
        "same": np.full(999, -0.5),
        "tiny": rng.uniform(-1e-300, 1e-300, 50),
    }
    df = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])
    sdf = spark.createDataFrame(df).unionByName(spark.sql("select 'hot' as g, cast(null as double) as v"))
    got = exact_quantiles(sdf, ["g"], "v", PROBS, sorted_rows).toPandas().set_index("g")
    for g, v in groups.items():
        assert list(got.loc[g, list(PROBS)]) == [np.percentile(v, p * 100) for p in PROBS.values()], g


def test_tables_of_the_quantiles_stay_small(spark, monkeypatch):
    """What is written depends on the bins of a group, not on its readings or their values."""
    from stationlens.operators import quantiles

    rows = []

    def counting(df, name):
        table = written(df, name)
        rows.append((name, table.count()))
        return table

    written = quantiles.written
    monkeypatch.setattr(quantiles, "written", counting)
    df = spark.range(600_000).selectExpr("'hot' as g", "cast(id as float) + 0.5f as v")
    got = exact_quantiles(df, ["g"], "v", {"median": 0.5}, sorted_rows=1000).first()
    assert got["median"] == np.median(np.arange(600_000, dtype=np.float32) + np.float32(0.5))
    assert {n for n, _ in rows} >= {"histogram", "quantile-bins", "quantile-parts"}
    assert max(n for _, n in rows) < 500


def hist(spark, rows):
    rows = [(s, y, m, None if v is None else float(v), None) for s, y, m, v in rows]
    return spark.createDataFrame(rows, "station string, year int, month int, value double, day date")


def boxes(values):
    q1, med, q3 = np.percentile(values, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside_low, inside_high = values[values >= low], values[values <= high]
    return (
        q1, med, q3,
        min(inside_low.min(), q1), max(inside_high.max(), q3),
        int(((values < low) | (values > high)).sum()),
    )


def test_box_stats(spark):
    rng = np.random.default_rng(7)
    rows = [("A", 2000 + i % 5, 1 + i % 9, round(v, 2)) for i, v in enumerate(rng.standard_t(2, 3000) * 10)]
    rows += [("B", 2001, 2, v) for v in (0.0, 0.0, 0.0, 100.0)] + [("C", 2001, 2, None)]
    out = ph.quarter_box_stats(hist(spark, rows)).collect()
    assert [(r.station, r.quarter) for r in out] == [(s, q) for s in "ABC" for q in (1, 2, 3, 4)]
    got = {(r.station, r.quarter): r for r in out}
    for q in (1, 2, 3):
        v = np.array([r[3] for r in rows if r[0] == "A" and (r[2] + 2) // 3 == q])
        r = got["A", q]
        assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.n_outliers) == boxes(v)
        assert r.n == len(v) and r["mean"] == pytest.approx(v.mean())
    assert got["A", 4].n == 0 and got["A", 4].median is None
    b = got["B", 1]
    assert (b.q1, b.q3, b.whisker_high, b.n_outliers) == (0.0, 25.0, 25.0, 1)
    assert got["C", 1].n == 0
    outliers = ph.quarter_outliers(hist(spark, rows)).toPandas().groupby(["station", "quarter"])["n"].sum()
    assert all(outliers.get((r.station, r.quarter), 0) == r.n_outliers for r in out)


def test_months_and_years(spark):
    rows = [("A", 2001, 1, 1.0), ("A", 2001, 1, 4.0), ("A", 2002, 1, 10.0), ("A", 2002, 3, None), ("A", 2002, 12, -2.0)]
    h = hist(spark, rows)
    profile = {r.month: tuple(r)[2:] for r in ph.month_profile(h).collect()}
    assert profile == {1: (3, 1.0, 10.0, 5.0), 12: (1, -2.0, -2.0, -2.0)}
    matrix = {r.year: tuple(r)[2:] for r in ph.year_month_matrix(h).collect()}
    assert matrix == {2001: (2.5, *[0.0] * 11), 2002: (10.0, *[0.0] * 10, -2.0)}
    assert [(r.year, r.month, r["mean"]) for r in ph.year_month_mean(h).collect()] == [
        (2001, 1, 2.5), (2002, 1, 10.0), (2002, 12, -2.0),
    ]


def test_anomalies_balance(spark, sf_dir):
    from stationlens.plans.registry import QUERIES

    out = QUERIES["seasonal_anomaly"](spark, sf_dir).toPandas()
    balance = (out["anomaly"] * out["n"]).groupby([out["station"], out["month"]]).sum()
    assert np.abs(balance).max() < 1e-6
    assert np.abs(out["anomaly"]).max() > 0


def test_unknown_indicator(spark):
    with pytest.raises(ValueError):
        ph.history(hist(spark, [("A", 2001, 1, 1.0)]), "value; drop table x")


@pytest.mark.parametrize("name", ["month_profile", "quarter_box_stats", "seasonal_anomaly", "period_features"])
def test_partitioning_does_not_matter(spark, sf_dir, name):
    from stationlens.plans.registry import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "4", "32"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, QUERIES[name](spark, sf_dir).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
