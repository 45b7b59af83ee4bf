"""K-means (Lloyd) with distance bounds kept per point (after Hamerly 2010).

A pass over all points writes, for each, its label and its slack: how much nearer its
centre is than the next one. As long as the centres have not moved by more than the
slack, the label cannot have changed, so a round looks only at the points with less
slack than the movement, adds up how they changed sides and corrects the sums of the
last full pass. Sums are whole numbers, so the result is that of looking at all points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlens.functions.stats import minmax
from stationlens.session import written


def minmax_bounds(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: ``<feature>_min`` and ``<feature>_max`` of every feature."""
    return df.agg(
        *[agg(c).alias(f"{c}_{name}") for c in features for name, agg in (("min", F.min), ("max", F.max))]
    )


def minmax_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """Scale every feature to [0, 1]; the one-row bounds come in as a scalar subquery.

    ``df`` is read twice: pass a written table.
    """
    bounds = minmax_bounds(df, features)
    row = bounds.select(F.struct(*bounds.columns).alias("b")).scalar()
    scaled = {c: minmax(F.col(c), row[f"{c}_min"], row[f"{c}_max"]) for c in features}
    return df.withColumns(scaled)


def sample_centres(points: DataFrame, key: list[str], features: list[str], k: int, seed: int = 42) -> DataFrame:
    """``k`` distinct rows in a random order fixed by ``seed``, numbered from 0."""
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    drawn = points.withColumn("_lot", lot).orderBy("_lot", *key).limit(k)
    order = Window.orderBy("_lot", *key)  # k rows
    return drawn.select((F.row_number().over(order) - 1).alias("centre"), *key, *features)


def collect_centres(start: DataFrame, features: list[str], k: int) -> list[list[float]]:
    """Start centres as numbers; raises when there are fewer than ``k`` rows."""
    rows = start.select(*features).limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} centres asked for, but there are only {len(rows)} points")
    return [[float(v) for v in r] for r in rows]


#: Units of a sum of features: whole ones add up to the same in any order.
_UNIT = float(1 << 40)


def centre_distances(features: list[str], centres: list[list[float]]) -> Column:
    """Array of the distances to all centres.

    The centres are one array value, so every round runs the same generated code.
    """
    table = F.lit([[float(v) for v in c] for c in centres])

    def distance(centre):
        gaps = [F.col(f"`{f}`") - centre[i] for i, f in enumerate(features)]
        total = gaps[0] * gaps[0]
        for gap in gaps[1:]:
            total = total + gap * gap
        return F.sqrt(total)

    return F.transform(table, distance)


def assign(points: DataFrame, features: list[str], centres: list[list[float]]) -> DataFrame:
    """Add ``label`` (index of the nearest centre, the lowest on ties) and ``distance``."""
    d = centre_distances(features, centres)
    return points.withColumn("_d", d).select(
        *points.columns,
        (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("label"),
        F.array_min("_d").alias("distance"),
    )


def centre_means(assigned: DataFrame, features: list[str]) -> DataFrame:
    """Mean vector and size of every non-empty cluster."""

    def average(feature):
        whole = F.rint(F.col(f"`{feature}`") * _UNIT).cast("decimal(38,0)")
        return (F.sum(whole).cast("double") / _UNIT / F.count("*")).alias(feature)

    return assigned.groupBy("label").agg(F.count("*").alias("n"), *map(average, features))


def _sums(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(label, n, one whole sum per feature)."""
    whole = [F.sum(F.rint(F.col(f"`{f}`") * _UNIT).cast("decimal(38,0)")).alias(f"s{i}") for i, f in enumerate(features)]
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *whole)


def _movement(old: list[list[float]], new: list[list[float]]) -> list[float]:
    return [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(old, new)]


#: Room for rounding in a comparison of distances.
_MARGIN = 1e-9
#: A new full pass once so many times the points have been looked at since the last one.
_REFRESH = 2


class _Bounded:
    """Labels and slacks of the last full pass and the sums of its clusters."""

    def __init__(self, points: DataFrame, features: list[str], centres: list[list[float]]):
        self.features, self.centres = features, centres
        ordered = F.array_sort("_d")
        second = F.get(ordered, F.lit(1))  # none with one centre
        slack = F.coalesce(second - F.get(ordered, F.lit(0)), F.lit(float("inf")))
        named = points.withColumn("_d", centre_distances(features, centres)).select(
            *[F.col(f"`{f}`") for f in features], (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("_label"), slack.alias("_slack")
        )
        # In the order of the slack, so that a round skips the row groups with more.
        self.state = written(named.sortWithinPartitions("_slack"), "kmeans-bounds")
        self.sums = {r["label"]: list(r)[1:] for r in _sums(self.state, "_label", features).collect()}  # at most k rows
        self.size = sum(v[0] for v in self.sums.values())

    def means(self, sums: dict[int, list], centres: list[list[float]]) -> list[list[float]]:
        """The mean of every cluster; an empty one keeps its centre."""
        return [
            [float(s) / _UNIT / sums[j][0] for s in sums[j][1:]] if sums.get(j, [0])[0] else list(c)
            for j, c in enumerate(centres)
        ]

    def moved(self, centres: list[list[float]]) -> tuple[dict[int, list], int]:
        """Sums of the clusters around ``centres``, and how many points had to be looked at."""
        gone = _movement(self.centres, centres)
        top = sorted(gone, reverse=True)[:2] + [0.0]
        # A label is safe while the slack exceeds the way of its centre and the longest way of another one.
        reach = [g + (top[1] if g == top[0] else top[0]) + _MARGIN for g in gone]
        near = self.state.filter(F.col("_slack") <= max(reach)).filter(F.col("_slack") <= F.get(F.lit(reach), F.col("_label")))
        d = F.col("_d")
        now = near.withColumn("_d", centre_distances(self.features, centres)).withColumn(
            "_now", (F.array_position(d, F.array_min(d)) - 1).cast("int")
        )
        sides = now.withColumn("_side", F.explode(F.array(F.struct(F.col("_now").alias("label"), F.lit(1).alias("sign")), F.struct(F.col("_label").alias("label"), F.lit(-1).alias("sign")))))
        whole = [F.sum(F.rint(F.col(f"`{f}`") * _UNIT).cast("decimal(38,0)") * F.col("_side.sign")).alias(f"s{i}") for i, f in enumerate(self.features)]
        changes = sides.groupBy("_side.label").agg(F.sum("_side.sign").alias("n"), *whole, F.count_if(F.col("_side.sign") == 1).alias("seen"))
        sums = {j: list(v) for j, v in self.sums.items()}
        seen = 0
        for row in changes.collect():  # at most k rows
            label, *more, looked = row
            old = sums.get(label, [0] * len(more))
            sums[label] = [a + b for a, b in zip(old, more)]
            seen += looked
        return sums, seen


def step(points: DataFrame, features: list[str], centres: list[list[float]]) -> tuple[list[list[float]], float]:
    """New centres and how far they moved; an empty cluster keeps its centre."""
    moved = [list(c) for c in centres]
    for row in centre_means(assign(points, features, centres), features).collect():  # at most k rows
        moved[row["label"]] = [row[f] for f in features]
    return moved, math.hypot(*_movement(centres, moved))


def fit(
    points: DataFrame,
    features: list[str],
    start: list[list[float]],
    max_iter: int = 100_000,
    eps: float = 1e-4,
    looked_at: list[int] | None = None,
) -> list[list[float]]:
    """Final centres: stop when they move at most ``eps`` or after ``max_iter`` rounds.

    Every round is a fresh plan over a written table with the centres as constants, so
    no lineage builds up. ``looked_at`` receives the number of points each round
    computed distances for.
    """
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")
    centres, bounded, spent = start, None, 0
    for _ in range(max_iter):
        if bounded is None or spent > _REFRESH * bounded.size:
            bounded, spent = _Bounded(points, features, centres), 0
            sums, seen = bounded.sums, bounded.size
        else:
            sums, seen = bounded.moved(centres)
            spent += seen
        if looked_at is not None:
            looked_at.append(seen)
        new = bounded.means(sums, centres)
        shift, centres = math.hypot(*_movement(centres, new)), new
        if shift <= eps:
            break
    return centres


def kmeans(
    points: DataFrame,
    key: list[str],
    features: list[str],
    k: int,
    start: DataFrame | None = None,
    max_iter: int = 100_000,
    eps: float = 1e-4,
    seed: int = 42,
) -> DataFrame:
    """Points with their ``label`` with respect to the final centres."""
    if k < 1:
        raise ValueError("k must be at least 1")
    points = written(points.select(*key, *features), "kmeans-points")
    if start is None:
        start = sample_centres(points, key, features, k, seed).orderBy("centre")
    centres = fit(points, features, collect_centres(start, features, k), max_iter, eps)
    return assign(points, features, centres)

