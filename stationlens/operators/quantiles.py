"""Exact quantiles of groups that need not fit in one task.

``percentile`` holds every distinct value of a group in one aggregation buffer.
Here readings are first added up in bins of 1/16 of an octave: counts, sums and
the ends of each bin, which merge before the shuffle, so what is written is a
few thousand rows per group whatever the number of readings. Only the bins that
hold a wanted rank are looked into again: one with few readings is sorted, one
with many is split into 1024 parts between its ends, and the parts that hold a
wanted rank are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlens.functions.stats import units
from stationlens.operators.skew import lookup_join
from stationlens.session import written

_BINS_PER_OCTAVE = 16
_OFFSET = 1100 * _BINS_PER_OCTAVE  # doubles have exponents above -1100
_PARTS = 1024
#: A bin with more readings is split before its values are sorted.
SORTED_ROWS = 65_536


def _bin(value):
    """Integer that never decreases when the value grows."""
    size = F.floor(F.log2(F.abs(value)) * _BINS_PER_OCTAVE).cast("int") + _OFFSET
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def histogram(df: DataFrame, keys: list[str], value: str, decimals: int | None = None) -> DataFrame:
    """(keys, bin, n, low, high, total): readings, ends and sum of each bin, NULL being a bin of its own.

    ``total`` is in whole units of ``decimals`` where given.
    """
    v = F.col(value).cast("double")
    added = units(F.col("value"), decimals)
    return (
        df.select(*keys, F.when(v.isNotNull(), _bin(v)).alias("bin"), v.alias("value"))
        .groupBy(*keys, "bin")
        .agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
            F.sum(added if decimals is None else added.cast("decimal(38,0)")).alias("total"),
        )
    )


def _ranks(probabilities: dict[str, float]) -> dict[str, tuple[str, str, str]]:
    """Fractional position, and the ranks below and above it, of each quantile as SQL."""
    at = {name: f"((size - 1) * {float(p)!r}D)" for name, p in probabilities.items()}
    return {name: (h, f"floor({h})", f"ceil({h})") for name, h in at.items()}


def _holding(bins: DataFrame, keys: list[str], ranks: Column) -> DataFrame:
    """(keys, rank, size, before, n, low, high): the bin that holds each rank of the array ``ranks``.

    ``bins`` has ``before``, the readings of the group below the bin.
    """
    within = F.filter(ranks, lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n")))
    return bins.select(*keys, F.explode(within).alias("rank"), "size", "before", "n", "low", "high")


def readings_in(df: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(keys, low, high, value): the readings within the ranges ``wanted`` of their group.

    A group has few ranges, and they do not overlap.
    """
    ranges = written(wanted.groupBy(*keys).agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "quantile-ranges")
    v = F.col(value).cast("double")
    known = df.select(*keys, v.alias("value")).filter("value is not null")
    joined = lookup_join(known, ranges, ranges.count(), keys, ["value"])
    hit = F.filter("ranges", lambda r: (r["low"] <= F.col("value")) & (F.col("value") <= r["high"]))
    return joined.withColumn("hit", F.get(hit, F.lit(0))).filter("hit is not null").select(*keys, "hit.low", "hit.high", "value")


def quantiles(
    df: DataFrame, bins: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """Linear-interpolation quantiles of each group, from its (written) :func:`histogram`."""
    group = Window.partitionBy(*keys)
    below = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = bins.filter("bin is not null").select(
        *keys, "n", "low", "high", (F.sum("n").over(below) - F.col("n")).alias("before"), F.sum("n").over(group).alias("size")
    )
    ends = [F.expr(rank).cast("bigint") for _, low, high in _ranks(probabilities).values() for rank in (low, high)]
    wanted = written(_holding(placed, keys, F.array_distinct(F.array(*ends))), "quantile-bins")
    found = [wanted.filter("low = high").select(*keys, "size", "rank", F.col("low").alias("value"))]
    while True:
        small = wanted.filter(f"low < high and n <= {sorted_rows}")
        if not small.isEmpty():
            found.append(_sorted(df, small, keys, value))
        wanted = wanted.filter(f"low < high and n > {sorted_rows}")
        if wanted.isEmpty():
            break
        wanted = written(_split(df, wanted, keys, value), "quantile-parts")
        found.append(wanted.filter("low = high").select(*keys, "size", "rank", F.col("low").alias("value")))
    values = found[0]
    for more in found[1:]:
        values = values.union(more)
    aggs = []
    for name, (position, *ranks) in _ranks(probabilities).items():
        low, high = (f"max(case when rank = {r} then value end)" for r in ranks)
        part, step = f"max({position} - {ranks[0]})", f"({high} - {low})"
        # interpolated from the nearer end, which keeps rounding errors smallest
        upward, downward = f"{low} + {step} * {part}", f"{high} - {step} * (1 - {part})"
        aggs.append(f"case when {part} < 0.5D then {upward} else {downward} end as `{name}`")
    return values.groupBy(*keys).agg(*map(F.expr, aggs))


def _sorted(df: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, size, rank, value) of the ranks in bins few enough to sort."""
    in_range = [*keys, "low", "high"]
    counts = readings_in(df, keys, value, wanted).groupBy(*in_range, "value").agg(F.count("*").alias("m"))
    upto = Window.partitionBy(*in_range).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("upto", F.sum("m").over(upto))
    at = wanted.join(ends, in_range).filter("before + upto - m <= rank and rank < before + upto")
    return at.select(*keys, "size", "rank", "value")


def _split(df: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The parts of crowded bins that hold the wanted ranks, in the form of ``wanted``."""
    in_range = [*keys, "low", "high"]
    part = F.least(F.lit(_PARTS - 1), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * _PARTS)).cast("int")
    parts = (
        readings_in(df, keys, value, wanted).withColumn("part", part).groupBy(*in_range, "part")
        .agg(F.count("*").alias("m"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    upto = Window.partitionBy(*in_range).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ranks = wanted.groupBy(*in_range, "size", "before").agg(F.collect_set("rank").alias("ranks"))
    placed = ranks.join(parts.withColumn("upto", F.sum("m").over(upto)), in_range).select(
        *keys, "size", "ranks", (F.col("before") + F.col("upto") - F.col("m")).alias("before"), F.col("m").alias("n"),
        F.col("least").alias("low"), F.col("most").alias("high"),
    )
    return _holding(placed, keys, F.col("ranks"))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """One row per group with one column per named probability."""
    return quantiles(df, written(histogram(df, keys, value), "histogram"), keys, value, probabilities, sorted_rows)
