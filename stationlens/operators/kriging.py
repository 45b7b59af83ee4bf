"""Ordinary kriging of many snapshots at once (Matheron 1963, Cressie 1993).

A snapshot is the set of station values sharing the ``keys``. Pairs of stations
are never emitted as rows: stations travel in blocks, every pair of blocks is
one small group, and only its sums per lag come out.

The dense system of a snapshot of any size is factored once, as tiles (block of
stations, block of stations): one round per block column, in which a task owns a
tile and streams the finished tiles it needs. A snapshot of one block takes one
round, so all snapshots go the same way. The surface and its variance are
evaluated per range of grid cells against the same tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlens.functions.geo import Grid
from stationlens.functions.stats import mean
from stationlens.operators.skew import salted_join
from stationlens.session import written

BLOCK = 512
# Fixed value: number of lags of the experimental semivariogram.
LAGS = 6
#: Stations per block of the dense system; a task holds a few tiles of its square.
SOLVE_BLOCK = 512
#: The nugget is at least this share of the partial sill. It keeps a Gaussian system, which is
#: nearly singular without nugget, solvable to about ten digits at any number of stations.
LEAST_NUGGET = 1e-4
#: Multiplications a task should have, and numbers it may hold for its grid cells.
_TASK_WORK = 4e9
#: Pairs of stations a task should have.
_PAIR_WORK = 5e6
_CELL_NUMBERS = 4_000_000
_SURFACE_CELLS = 1 << 16
_SAME_PLACE = 1e-10


def location_means(rows: DataFrame, keys: list[str], value: str, decimals: int | None = None) -> DataFrame:
    """(keys, lon, lat, z): mean of the non-null values at each location."""
    z = F.col(value).cast("double")
    return (
        rows.filter(z.isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .groupBy(*keys, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
        .agg(mean(z, decimals).alias("z"))
    )


def _struct(df: DataFrame, names: list[str], **added: T.DataType) -> T.StructType:
    """Fields ``names`` of ``df`` followed by new ones."""
    return T.StructType([df.schema[n] for n in names] + [T.StructField(n, t) for n, t in added.items()])


def _heavy_groups(df: DataFrame, keys: list[str], work: float):
    """Group by ``keys``, the groups spread over as many tasks as their counted work asks for.

    The groups are heavy for the few bytes they hold, so they must not be merged
    by size: a partitioning of stated number on a hash of the keys stays as is.
    """
    tasks = int(max(1, min(20_000, -(-work // _PAIR_WORK))))
    return df.withColumn("task", F.xxhash64(*keys)).repartition(tasks, "task").groupBy("task", *keys)


def _keyed(group: pa.Table, keys: list[str], columns: dict[str, np.ndarray]) -> pa.Table:
    """Columns of equal length under the key values of a group."""
    rows = np.zeros(len(next(iter(columns.values()))), dtype=np.int64)
    out = {k: group.column(k).take(pa.array(rows)) for k in keys}
    return pa.table(out | {n: pa.array(v) for n, v in columns.items()})


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _in_blocks(places: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, float]:
    """Places with ``parts`` and their block ``own``, and the number of pairs there are."""
    sizes = written(places.groupBy(*keys).agg(F.count("*").alias("size")), "snapshot-sizes")
    parts = sizes.withColumn("parts", F.ceil(F.col("size") / block).cast("int")).drop("size")
    owned = salted_join(places, parts, keys, ["lon", "lat"]).withColumn("own", F.expr("cast(pmod(xxhash64(lon, lat), parts) as int)"))
    size = F.col("size").cast("double")
    return owned, sizes.agg(F.sum(size * size / 2)).first()[0] or 0.0


def _block_pairs(owned: DataFrame, keys: list[str]) -> DataFrame:
    """Each place once per pair of blocks (``bi <= bj``) its block belongs to."""
    rest = [c for c in owned.columns if c not in (*keys, "parts", "own")]
    return owned.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).selectExpr(
        *keys, "least(own, other) as bi", "greatest(own, other) as bj", "own <= other as first", *rest
    )


def _pair_places(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs of one block pair."""
    bi, bj = _numbers(group, "bi", "bj")
    if bi[0] == bj[0]:
        return np.triu_indices(len(bi), k=1)
    first = group.column("first").to_numpy()
    i, j = np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first), indexing="ij")
    return i.ravel(), j.ravel()


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull; the two places farthest apart are among them."""
    order = np.lexsort((y, x)).tolist()
    px, py = x.tolist(), y.tolist()

    def chain(places):
        kept: list[int] = []
        for c in places:
            while len(kept) > 1:
                a, b = kept[-2], kept[-1]
                if (px[b] - px[a]) * (py[c] - py[a]) - (py[b] - py[a]) * (px[c] - px[a]) > 0:
                    break
                kept.pop()
            kept.append(c)
        return kept

    return np.unique(chain(order) + chain(order[::-1]))


def _closest(x: np.ndarray, y: np.ndarray) -> float:
    """Least distance of two places, by a sweep along ``x``."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    best = np.inf
    for step in range(1, len(x)):
        dx, dy = x[step:] - x[:-step], y[step:] - y[:-step]
        if dx.min() >= best:
            break
        best = min(best, float(np.sqrt(dx * dx + dy * dy).min()))
    return best


def _extents(owned: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, h_min, h_max): least and largest distance of two places of a snapshot.

    The largest is found among the hull corners of its blocks. The least distance within a
    block bounds that of the snapshot; places nearer than the bound lie in neighbouring
    cells of that width, and a block has but a few places in such a cell.
    """
    double = T.DoubleType()

    def corners(table: pa.Table) -> pa.Table:
        x, y = _numbers(table, "lon", "lat")
        hull = _hull(x, y)
        near = np.full(len(hull), _closest(x, y))
        return _keyed(table, keys, {"lon": x[hull], "lat": y[hull], "near": near})

    found = owned.select(*keys, "own", "lon", "lat").groupBy(*keys, "own")
    hulls = written(found.applyInArrow(corners, _struct(owned, keys, lon=double, lat=double, near=double)), "hull-corners")

    def farthest(table: pa.Table) -> pa.Table:
        i, j = _pair_places(table)
        x, y = _numbers(table, "lon", "lat")
        dx, dy = x[i] - x[j], y[i] - y[j]
        return _keyed(table, keys, {"h_max": np.sqrt(dx * dx + dy * dy).max(keepdims=True) if len(i) else np.empty(0)})

    dealt, work = _in_blocks(hulls.select(*keys, "lon", "lat"), keys, block)
    far = (
        _heavy_groups(_block_pairs(dealt, keys), [*keys, "bi", "bj"], work)
        .applyInArrow(farthest, _struct(owned, keys, h_max=double)).groupBy(*keys).agg(F.max("h_max").alias("h_max"))
    )
    # Blocks of one place each have no distance; then the whole snapshot is one cell.
    bounds = written(hulls.groupBy(*keys).agg(F.min("near").alias("near")).join(far, keys).withColumn("width", F.least("near", "h_max")), "pair-bounds")
    placed = (
        salted_join(owned.filter("parts > 1").select(*keys, "lon", "lat"), bounds.select(*keys, "width"), keys, ["lon", "lat"])
        .selectExpr(*keys, "lon", "lat", "floor(lon / width) as cx", "floor(lat / width) as cy")
    )
    around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    others = placed.withColumnsRenamed({"lon": "lon2", "lat": "lat2"}).select(*keys, "lon2", "lat2", around.alias("c")).select(*keys, "lon2", "lat2", "c.*")
    across = (
        placed.join(others, [*keys, "cx", "cy"]).filter("lon < lon2 or (lon = lon2 and lat < lat2)")
        .groupBy(*keys).agg(F.expr("min(sqrt((lon - lon2) * (lon - lon2) + (lat - lat2) * (lat - lat2)))").alias("across"))
    )
    return bounds.join(across, keys, "left").select(*keys, F.least("near", "across").alias("h_min"), "h_max")


def semivariogram(places: DataFrame, keys: list[str], lags: int = LAGS, block: int = BLOCK) -> DataFrame:
    """(keys, bin, n, lag, gamma): mean distance and semivariance per distance class.

    Classes have equal width between the smallest and largest pair distance of
    the snapshot, which are found without looking at all pairs; those are gone
    through once. A snapshot with fewer than two places has no row.
    """
    group = [*keys, "bi", "bj"]
    double = T.DoubleType()
    owned, work = _in_blocks(places, keys, block)
    extents = written(_extents(owned, keys, block), "pair-extents")

    def sums(table: pa.Table) -> pa.Table:
        i, j = _pair_places(table)
        x, y, z = _numbers(table, "lon", "lat", "z")
        dx, dy, dz = x[i] - x[j], y[i] - y[j], z[i] - z[j]
        h, g = np.sqrt(dx * dx + dy * dy), 0.5 * dz * dz
        low, high = (v[0] for v in _numbers(table, "h_min", "h_max"))
        width = (high - low) / lags
        index = np.minimum(np.floor((h - low) / width), lags - 1).astype(np.int64) if width > 0 else np.zeros(len(h), int)
        n, h_sum, g_sum = (np.bincount(np.maximum(index, 0), weights=w, minlength=lags) for w in (None, h, g))
        used = np.flatnonzero(n)
        return _keyed(
            table, keys, {"bin": used.astype(np.int32), "n": n[used], "h_sum": h_sum[used], "g_sum": g_sum[used]}
        )

    summed = _struct(places, keys, bin=T.IntegerType(), n=T.LongType(), h_sum=double, g_sum=double)
    bounded = salted_join(owned, extents, keys, ["lon", "lat"])
    return (
        _heavy_groups(_block_pairs(bounded, keys), group, work)
        .applyInArrow(sums, summed)
        .groupBy(*keys, "bin")
        .agg(F.sum("n").alias("n"), F.sum("h_sum").alias("h_sum"), F.sum("g_sum").alias("g_sum"))
        .selectExpr(*keys, "bin", "n", "h_sum / n as lag", "g_sum / n as gamma")
    )


def variogram_fit(bins: DataFrame, keys: list[str], candidates: int = 20) -> DataFrame:
    """(keys, nugget, psill, range, sse): Gaussian model fitted by least squares.

    With the range fixed the model is linear, so each candidate range has a
    closed-form fit with nugget and partial sill not below 0; the candidate with
    the smallest error wins, the shortest one on ties. When no rising model
    fits, the partial sill is 0 and the nugget the mean semivariance.
    """
    top = F.max("lag").over(Window.partitionBy(*keys))  # at most `lags` rows
    moments = (
        bins.withColumn("top", top)
        .selectExpr(*keys, "lag", "gamma", "top", f"explode(sequence(1, {candidates})) as j")
        .selectExpr(*keys, "lag", "gamma", f"top * j / {candidates} as range")
        .selectExpr(*keys, "range", "gamma", "1 - exp(-power(lag / nullif(range * 4 / 7, 0), 2)) as x")
        .groupBy(*keys, "range")
        .agg(
            *[
                F.expr(e)
                for e in (
                    "count(*) as m", "sum(x) as sx", "sum(gamma) as sg", "sum(x * x) as sxx",
                    "sum(x * gamma) as sxg", "sum(gamma * gamma) as sgg",
                )
            ]
        )
    )
    free = moments.selectExpr(
        "*", "case when m * sxx - sx * sx > 1e-12 then (m * sxg - sx * sg) / (m * sxx - sx * sx) end as slope"
    ).selectExpr("*", "coalesce((sg - slope * sx) / m >= 0, false) as with_nugget")
    fitted = free.selectExpr(
        "*",
        "case when with_nugget then (sg - slope * sx) / m else 0d end as c0",
        "case when with_nugget then slope else sxg / nullif(sxx, 0) end as c1",
    ).selectExpr("*", "coalesce(c1 <= 0, true) as flat")
    models = fitted.selectExpr(
        "*", "case when flat then sg / m else c0 end as nugget", "case when flat then 0d else c1 end as psill"
    )
    error = (
        "greatest(0d, sgg - 2 * nugget * sg + m * nugget * nugget + case when flat then 0d "
        "else psill * (psill * sxx + 2 * nugget * sx - 2 * sxg) end) as sse"
    )
    return (
        models.selectExpr(*keys, "flat", error, "range", "nugget", "psill")
        .groupBy(*keys)
        .agg(F.min(F.struct("flat", "sse", "range", "nugget", "psill")).alias("best"))
        .select(*keys, "best.nugget", "best.psill", "best.range", "best.sse")
    )


def gamma(h: np.ndarray, nugget: float, psill: float, reach: float) -> np.ndarray:
    """Gaussian semivariogram; 0 at distance 0."""
    rise = 1.0 - np.exp(-((h / (reach * 4.0 / 7.0)) ** 2)) if psill > 0 else np.zeros_like(h)
    return np.where(h <= _SAME_PLACE, 0.0, nugget + psill * rise)


MODEL = ("nugget", "psill", "range")


class Solved:
    """The solved systems of all snapshots.

    ``blocks``: keys, block, n, flat, nugget, psill, range, constant and the arrays lons, lats, weights:
    ``z(place) = constant + sum(weight_i * covariance(distance_i))`` over all blocks of a snapshot.
    ``tiles``: keys, parts, row, col, height, tile: the triangular factor; row ``parts`` holds
    two lines, the factor applied to the values and to ones.
    """

    def __init__(self, blocks: DataFrame, tiles: DataFrame):
        self.blocks, self.tiles = blocks, tiles


def _station_blocks(places: DataFrame, model: DataFrame, keys: list[str], block: int) -> DataFrame:
    """One row per block of a snapshot's stations, with the model of the snapshot.

    A snapshot of one place, or without variation, gets the identity as its system,
    which makes it a constant surface.
    """
    sizes = places.groupBy(*keys).agg(F.count("*").alias("n"))
    fitted = sizes.join(model.select(*keys, *MODEL), keys, "left").withColumn(
        "flat", F.expr("n < 2 or not coalesce(nugget + psill > 0, false)")
    )
    params = written(
        fitted.selectExpr(
            *keys, "n", "flat", f"cast(ceil(n / {block}) as int) as parts",
            f"if(flat, 1d, greatest(nugget, {LEAST_NUGGET!r}D * psill)) as nugget", "if(flat, 0d, psill) as psill",
            "if(flat, 1d, range) as range",
        ),
        "kriging-models",
    )
    named = [*keys, "parts", "n", "flat", *MODEL]
    return (
        salted_join(places, params, keys, ["lon", "lat"])
        .withColumn("block", F.expr("cast(pmod(xxhash64(lon, lat), parts) as int)"))
        .groupBy(*named, "block")
        .agg(F.array_sort(F.collect_list(F.struct("lon", "lat", "z"))).alias("s"))
        .select(*named, "block", *[F.col(f"s.{a}").alias(b) for a, b in (("lon", "xs"), ("lat", "ys"), ("z", "zs"))])
    )


def _parts_table(blocks: DataFrame) -> list[tuple[int, int, float]]:
    """(blocks, snapshots, multiplications of a tile product): as many rows as there are sizes in blocks."""
    sizes = blocks.groupBy("parts").agg(
        F.sum(F.when(F.col("block") == 0, 1).otherwise(0)).alias("snapshots"), F.avg(F.pow(F.size("xs"), 3)).alias("cube")
    )
    return [(r["parts"], r["snapshots"], r["cube"]) for r in sizes.collect()]


def _dealt(df: DataFrame, keys: list[str], order: list[str], work: float) -> DataFrame:
    """``df`` with the rows of each key in one task, in order; as many tasks as the work asks for.

    The rows are heavy for the few bytes they hold, so tasks must not be merged by size.
    """
    return df.repartition(int(max(1, min(20_000, -(-work // _TASK_WORK)))), *keys).sortWithinPartitions(*keys, *order)


def _each_row(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, row) one by one, and at the end (None, None)."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            yield tuple(row.column(k)[0].as_py() for k in keys), row
    yield None, None


def _array(row: pa.RecordBatch, name: str) -> np.ndarray:
    return row.column(name)[0].values.to_numpy()


def _tile(row: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(row.column("tile")[0].as_buffer()).reshape(row.column("height")[0].as_py(), -1)


def _covariance(x, y, u, v, model) -> np.ndarray:
    nugget, psill, reach = model
    squared = (x[:, None] - u) ** 2 + (y[:, None] - v) ** 2
    c = psill * np.exp(-squared / (reach * 4.0 / 7.0) ** 2) if psill > 0 else np.zeros(squared.shape)
    c[squared <= _SAME_PLACE**2] = nugget + psill
    return c


def _triangle(square: np.ndarray, nugget: float) -> np.ndarray:
    """The lower triangular factor of a positive definite matrix.

    No eigenvalue of a partial system lies below the nugget; those that rounding pushed there go back to it.
    """
    try:
        return np.linalg.cholesky(square)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(square)
        r = np.linalg.qr((vectors * np.sqrt(np.maximum(values, nugget))).T, mode="r")
        return r.T * np.sign(np.diag(r))


def _factored(blocks: DataFrame, keys: list[str], sizes: list[tuple[int, int, float]]) -> DataFrame:
    """The tiles of the factor and of the two right-hand sides, one block column per round."""
    most = max((p for p, _, _ in sizes), default=0)
    schema = _struct(blocks, [*keys, "parts"], row=T.IntegerType(), col=T.IntegerType(), height=T.IntegerType(), tile=T.BinaryType())
    unit = [*keys, "row"]
    nothing = lambda t: F.lit(None).cast(t)
    every = lambda k: F.explode(F.sequence(F.lit(k), F.col("parts"))).alias("row")
    done: DataFrame | None = None
    for k in range(most):
        stations = [*[F.col(c) for c in (*MODEL, "xs", "ys", "zs")], nothing("int").alias("height"), nothing("binary").alias("tile")]
        own = blocks.filter(F.col("block") == k).select(*keys, "parts", every(k), F.lit(-1).alias("j"), F.lit(0).alias("kind"), *stations)
        theirs = blocks.filter(F.col("block") > k).select(*keys, "parts", F.col("block").alias("row"), F.lit(-1).alias("j"), F.lit(1).alias("kind"), *stations)
        rows = own.union(theirs)
        if done is not None:
            empty = [nothing("double").alias(c) for c in MODEL] + [nothing("array<double>").alias(c) for c in ("xs", "ys", "zs")]
            alive = done.filter(F.col("parts") > k)
            line = alive.filter(F.col("row") == k).select(*keys, "parts", every(k), F.col("col").alias("j"), F.lit(2).alias("kind"), *empty, "height", "tile")
            rest = alive.filter(F.col("row") > k).select(*keys, "parts", "row", F.col("col").alias("j"), F.lit(3).alias("kind"), *empty, "height", "tile")
            rows = rows.union(line).union(rest)
        work = sum(count * (parts - k + 1) * (k + 1) * cube for parts, count, cube in sizes if parts > k)
        column = _dealt(rows, unit, ["j", "kind"], work).mapInArrow(_column_task(k, unit, schema.names), schema)
        column = written(column, "kriging-factor")
        done = column if done is None else done.union(column)
    return done if done is not None else blocks.sparkSession.createDataFrame([], schema)


def _column_task(k: int, unit: list[str], names: list[str]):
    """Computes tile (row, k) of each unit from the stations and the tiles to the left of it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = square = side = across = None
        for here, row in _each_row(batches, unit):
            if here != key:
                if square is not None and (side is not None or key[-1] == k):
                    low = _triangle(square, first.column("nugget")[0].as_py())
                    out = low if key[-1] == k else np.linalg.solve(low, side.T).T
                    columns = {n: first.column(n) for n in names[:-4]}
                    columns |= {"row": pa.array([key[-1]], pa.int32()), "col": pa.array([k], pa.int32())}
                    columns |= {"height": pa.array([len(out)], pa.int32()), "tile": pa.array([np.ascontiguousarray(out).tobytes()], pa.binary())}
                    yield pa.RecordBatch.from_pydict(columns)
                key, first, square, side, across = here, None, None, None, None
            if here is None:
                return
            kind = row.column("kind")[0].as_py()
            if kind == 0:
                first = row
                model = [row.column(c)[0].as_py() for c in MODEL]
                x, y, z = (_array(row, c) for c in ("xs", "ys", "zs"))
                square = _covariance(x, y, x, y, model)
                if key[-1] == row.column("parts")[0].as_py():
                    side = np.vstack([z, np.ones(len(z))])
            elif square is None:
                continue  # the hash left block k without stations
            elif kind == 1:
                side = _covariance(_array(row, "xs"), _array(row, "ys"), x, y, model)
            elif kind == 2:
                across = _tile(row)
                square = square - across @ across.T
            elif side is not None:
                side = side - _tile(row) @ across.T

    return task


def _backward(tiles: DataFrame, keys: list[str], sizes: list[tuple[int, int, float]]) -> tuple[DataFrame, DataFrame]:
    """(keys, block, weights) and (keys, constant), from the last block column to the first."""
    most = max((p for p, _, _ in sizes), default=0)
    right = tiles.filter("row = parts")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, row in _each_row(batches, ["col"]):
            if row is not None:
                z, one = _tile(row)
                columns = {k: row.column(k) for k in (*keys, "col")}
                yield pa.RecordBatch.from_pydict(columns | {"zy": pa.array([float(z @ one)]), "yy": pa.array([float(one @ one)])})

    double = T.DoubleType()
    parts = right.mapInArrow(dots, _struct(tiles, [*keys, "col"], zy=double, yy=double))
    added = lambda c: F.aggregate(F.transform("p", lambda p: p[c]), F.lit(0.0), lambda a, b: a + b)
    means = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col", "zy", "yy"))).alias("p"))
    means = written(means.select(*keys, (added("zy") / added("yy")).alias("constant")), "kriging-constants")

    unit = [*keys, "block"]
    schema = _struct(tiles, [*keys, "parts"], block=T.IntegerType(), weights=T.ArrayType(double))
    found: list[DataFrame] = []
    before: DataFrame | None = None
    no_tile = [F.lit(None).cast("int").alias("height"), F.lit(None).cast("binary").alias("tile"), F.lit(None).cast("double").alias("constant")]
    for k in reversed(range(most)):
        every = F.explode(F.sequence(F.lit(0), F.lit(k))).alias("block")
        alive = tiles.filter((F.col("parts") > k) & (F.col("row") == k))
        corner = alive.filter(F.col("col") == k).select(*keys, "parts", every, F.lit(1).alias("kind"), "height", "tile", F.lit(None).cast("double").alias("constant"), F.lit(None).cast("array<double>").alias("rest"))
        line = alive.filter(F.col("col") < k).select(*keys, "parts", F.col("col").alias("block"), F.lit(3).alias("kind"), "height", "tile", F.lit(None).cast("double").alias("constant"), F.lit(None).cast("array<double>").alias("rest"))
        # What is left of the right-hand sides: as they were, or after the block columns behind.
        start = salted_join(right.filter(F.col("parts") == k + 1), means, keys, ["col"]).select(*keys, "parts", F.col("col").alias("block"), "height", "tile", "constant", F.lit(None).cast("array<double>").alias("rest"))
        left = start if before is None else start.union(before.filter(F.col("block") <= k).select(*keys, "parts", "block", *no_tile, F.col("weights").alias("rest")))
        values = ["height", "tile", "constant", "rest"]
        mine = left.filter(F.col("block") < k).select(*keys, "parts", "block", F.lit(2).alias("kind"), *values)
        shared = left.filter(F.col("block") == k).select(*keys, "parts", every, F.lit(0).alias("kind"), *values)
        rows = corner.union(line).union(mine).union(shared)
        work = sum(count * cube for parts_, count, cube in sizes if parts_ > k) * (k + 1)
        before = written(_dealt(rows, unit, ["kind"], work).mapInArrow(_back_task(k, unit, schema.names), schema), "kriging-weights")
        found.append(before.filter(F.col("block") == k))
    weights = found[0] if found else tiles.sparkSession.createDataFrame([], schema)
    for more in found[1:]:
        weights = weights.union(more)
    return weights.drop("parts"), means


def _back_task(k: int, unit: list[str], names: list[str]):
    """Solves for block ``k`` and takes its share off the right-hand side of each earlier block."""

    def rest(row: pa.RecordBatch) -> np.ndarray:
        if row.column("rest")[0].is_valid:
            return _array(row, "rest")
        z, one = _tile(row)
        return z - row.column("constant")[0].as_py() * one

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = last = weights = mine = None
        for here, row in _each_row(batches, unit):
            if here != key:
                out = weights if key is not None and key[-1] == k else mine
                if out is not None:
                    columns = {n: first.column(n) for n in names[:-1]}
                    yield pa.RecordBatch.from_pydict(columns | {"weights": pa.array([out], pa.list_(pa.float64()))})
                key, first, last, weights, mine = here, row, None, None, None
            if here is None:
                return
            kind = row.column("kind")[0].as_py()
            if kind == 0:
                last = rest(row)
            elif kind == 1:
                weights = np.linalg.solve(_tile(row).T, last)
            elif kind == 2:
                mine = rest(row)
            else:
                mine = mine - _tile(row).T @ weights

    return task


def krige_weights(places: DataFrame, model: DataFrame, keys: list[str], block: int = SOLVE_BLOCK) -> Solved:
    """The systems of all snapshots solved, whatever their number of stations.

    ``block`` stations make a tile side; a snapshot of m blocks takes m rounds forward and
    m back, all snapshots at once. Blocks, tiles and weights are written tables, so a lost
    executor costs one tile.
    """
    blocks = written(_station_blocks(places, model, keys, block), "kriging-blocks")
    sizes = _parts_table(blocks)
    tiles = _factored(blocks, keys, sizes)
    weights, means = _backward(tiles, keys, sizes)
    named = blocks.join(weights, [*keys, "block"]).join(means, keys)
    solved = named.select(
        *keys, "parts", "block", "n", "flat", *MODEL, "constant", F.col("xs").alias("lons"), F.col("ys").alias("lats"), "weights"
    )
    return Solved(written(solved, "kriging-solved"), tiles)


class _Cells:
    """Covariances between the cells ``low .. high`` of a grid and stations; they are products over the two axes."""

    def __init__(self, grid: Grid, low: int, high: int):
        self.grid = grid
        cell = np.arange(low, high)
        self.ix, self.iy, self.low = cell % grid.nx, cell // grid.nx, low
        self.gx = grid.lon_min + np.arange(grid.nx) * grid.step
        self.gy = grid.lat_min + np.arange(grid.ny) * grid.step

    def axes(self, x, y, model) -> tuple[np.ndarray, np.ndarray]:
        scale = model[2] * 4.0 / 7.0
        return np.exp(-(((self.gx[:, None] - x) / scale) ** 2)), model[1] * np.exp(-(((self.gy[:, None] - y) / scale) ** 2))

    def same_places(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """(cell, station) pairs of one place, cells counted from ``low``."""
        grid = self.grid
        ix = np.clip(np.rint((x - grid.lon_min) / grid.step), 0, grid.nx - 1).astype(np.int64)
        iy = np.clip(np.rint((y - grid.lat_min) / grid.step), 0, grid.ny - 1).astype(np.int64)
        cell = iy * grid.nx + ix - self.low
        near = (np.hypot(self.gx[ix] - x, self.gy[iy] - y) <= _SAME_PLACE) & (cell >= 0) & (cell < len(self.ix))
        return cell[near], np.flatnonzero(near)

    def covariances(self, x, y, model) -> np.ndarray:
        """One line per station."""
        if model[1] > 0:
            ex, ey = self.axes(x, y, model)
            c = ex[self.ix].T * ey[self.iy].T
        else:
            c = np.zeros((len(x), len(self.ix)))
        cell, station = self.same_places(x, y)
        c[station, cell] = model[0] + model[1]
        return c

    def weighted(self, x, y, w, model) -> np.ndarray:
        """The weighted sum of the covariances of each cell, by a product over whole grid lines."""
        total = np.zeros(len(self.ix))
        if model[1] > 0:
            ex, ey = self.axes(x, y, model)
            lines = np.arange(self.iy[0], self.iy[-1] + 1)
            plane = (ey[lines] * w) @ ex.T
            total = plane.ravel()[self.low - lines[0] * self.grid.nx :][: len(self.ix)].copy()
            cell, station = self.same_places(x, y)
            np.add.at(total, cell, w[station] * (model[0] + model[1] - ey[self.iy[cell], station] * ex[self.ix[cell], station]))
        else:
            cell, station = self.same_places(x, y)
            np.add.at(total, cell, w[station] * model[0])
        return total


def krige_surface(solved: Solved, keys: list[str], grid: Grid = Grid(), variance: bool = False) -> DataFrame:
    """(keys, ix, iy, lon, lat, z[, variance]) for all cells of the grid.

    Work is shared out as (snapshot, range of cells). A range streams the blocks of its
    snapshot, for the variance also the tiles of the factor, and holds one number per cell,
    for the variance one per cell and station in bounded ranges.
    """
    cells = grid.nx * grid.ny
    per = F.greatest(F.lit(1), F.least(F.lit(_SURFACE_CELLS), F.floor(F.lit(_CELL_NUMBERS) / F.col("n")))) if variance else F.lit(_SURFACE_CELLS)
    unit = [*keys, "part"]
    blocks = solved.blocks.withColumn("per", per.cast("int"))
    sized = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(cells) / F.col("per")).cast("int") - 1)))
    stations = ["n", "flat", *MODEL, "constant", "lons", "lats", "weights"]
    rows = sized.select(*unit, "block", F.lit(-1).alias("j"), "per", *stations)
    each = F.col("n") * F.size("lons") if variance else F.size("lons")
    work = blocks.agg(F.sum(each * F.lit(float(cells)))).first()[0] or 0.0
    if variance:
        nothing = lambda t: F.lit(None).cast(t)
        rows = rows.select("*", nothing("int").alias("height"), nothing("binary").alias("tile"))
        empty = [nothing(solved.blocks.schema[c].dataType).alias(c) for c in stations]
        # Tile (block, j) of the factor, and last the block of ones.
        factor = solved.tiles.select(
            *keys, "height", "tile", F.when(F.col("row") < F.col("parts"), F.col("row")).otherwise(F.col("col")).alias("block"),
            F.when(F.col("row") < F.col("parts"), F.col("col")).otherwise(F.col("parts")).alias("j"),
        )
        spread = sized.select(*unit, "block", "per")
        rows = rows.unionByName(
            factor.join(spread, [*keys, "block"]).select(*unit, "block", "j", "per", *empty, "height", "tile")
        )
    numbers = {"ix": T.IntegerType(), "iy": T.IntegerType()}
    numbers |= dict.fromkeys(("lon", "lat", "z", "variance") if variance else ("lon", "lat", "z"), T.DoubleType())
    # A surface is little work but many rows: about half a million cells a task.
    dealt = _dealt(rows, unit, ["block", "j"], max(work, _TASK_WORK * _surface_tasks(solved, keys, cells)))
    return dealt.mapInArrow(_surface_task(grid, keys, variance), _struct(solved.blocks, keys, **numbers))


def _surface_tasks(solved: Solved, keys: list[str], cells: int) -> float:
    return solved.blocks.select(*keys).distinct().count() * cells / 500_000


def _surface_task(grid: Grid, keys: list[str], variance: bool):
    unit = [*keys, "part"]
    cells = grid.nx * grid.ny

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = key = None
        for here, row in _each_row(batches, unit):
            if here != key:
                if state is not None:
                    yield from state.result()
                key = here
                state = None if here is None else _Range(grid, cells, keys, row, variance)
            if here is not None:
                state.add(row)

    return task


class _Range:
    """Values and variances of one range of cells of a snapshot."""

    def __init__(self, grid: Grid, cells: int, keys: list[str], row: pa.RecordBatch, variance: bool):
        per, part = row.column("per")[0].as_py(), row.column("part")[0].as_py()
        self.cells = _Cells(grid, part * per, min(cells, (part + 1) * per))
        self.keys, self.first, self.variance = keys, row, variance
        size = len(self.cells.ix)
        self.z, self.squares, self.ones = np.zeros(size), np.zeros(size), np.zeros(size)
        self.norm, self.solved = 0.0, {}

    def add(self, row: pa.RecordBatch) -> None:
        block, j = row.column("block")[0].as_py(), row.column("j")[0].as_py()
        if j < 0:
            self.model = [row.column(c)[0].as_py() for c in MODEL]
            self.flat, self.constant = row.column("flat")[0].as_py(), row.column("constant")[0].as_py()
            x, y, w = (_array(row, c) for c in ("lons", "lats", "weights"))
            if not self.variance:
                self.z += self.cells.weighted(x, y, w, self.model)
                return
            self.rest = self.cells.covariances(x, y, self.model)
            self.z += w @ self.rest
        elif j < block:
            self.rest -= _tile(row) @ self.solved[j]
        elif block in self.solved:
            one = _tile(row)[1]
            self.ones += one @ self.solved[block]
            self.norm += float(one @ one)
        else:
            self.solved[block] = np.linalg.solve(_tile(row), self.rest)
            self.squares += (self.solved[block] ** 2).sum(axis=0)

    def result(self) -> Iterator[pa.RecordBatch]:
        c = self.cells
        values = {
            "ix": c.ix.astype(np.int32), "iy": c.iy.astype(np.int32), "lon": c.gx[c.ix], "lat": c.gy[c.iy],
            "z": np.full(len(c.ix), self.constant) if self.flat else self.constant + self.z,
        }
        if self.variance:
            sill = self.model[0] + self.model[1]
            values["variance"] = np.zeros(len(c.ix)) if self.flat else sill - self.squares + (1 - self.ones) ** 2 / self.norm
        yield from _keyed(pa.Table.from_batches([self.first]), self.keys, values).to_batches()
