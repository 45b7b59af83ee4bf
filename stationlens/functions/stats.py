"""Aggregate and scaling expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def units(value, decimals: int | None) -> Column:
    """A reading in whole units of its last place, or as it is without ``decimals``.

    Whole numbers add up to the same sum in any order, doubles only nearly.
    """
    value = value.cast("double")
    return value if decimals is None else F.rint(value * F.lit(float(10**decimals))).cast("bigint")


def from_units(total, decimals: int | None) -> Column:
    return total if decimals is None else total.cast("double") / F.lit(float(10**decimals))


def mean(value, decimals: int | None = None) -> Column:
    """Arithmetic mean; with ``decimals``, over whole units (see :func:`units`)."""
    if decimals is None:
        return F.avg(value.cast("double"))
    return from_units(F.sum(units(value, decimals).cast("decimal(38,0)")), decimals) / F.count(value)


def minmax(value, low, high) -> Column:
    """(value - low) / (high - low); a constant column becomes 0."""
    return (value - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def band(value, low, high, levels: int) -> Column:
    """Index of the contour interval among ``levels`` equally spaced levels.

    0 lies below the first level and ``levels`` above the last one, so both
    ends stay open; when all levels coincide everything is in band 1.
    """
    return F.coalesce(
        F.width_bucket(value, low, high, F.lit(levels - 1)).cast("int"),
        F.when(value.isNotNull(), F.lit(1)),
    )


def euclidean(a, b) -> Column:
    """Euclidean distance of two numeric arrays of equal length."""
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))


def quarter_of(month) -> Column:
    """Calendar quarter 1..4 of a month number."""
    return F.ceil(month / 3).cast("int")


def round_exact(value, digits: int = 2) -> Column:
    """A double rounded to ``digits`` decimals by its exact binary value, halves to even.

    1.115 lies below the half, 0.125 on it. The product with the power of ten is taken with
    its rounding error (Dekker 1971), so nothing is decided by a rounded product.
    """
    value = value.cast("double")
    scale = F.lit(float(10**digits))
    spread = value * F.lit(134217729.0)  # 2^27 + 1 cuts a double into two halves
    high = spread - (spread - value)
    product = value * scale
    error = (high * scale - product) + (value - high) * scale
    below = F.floor(product).cast("double")
    beyond = (product - below - 0.5) + error  # the first difference is exact
    whole = F.when((beyond > 0) | ((beyond == 0) & (F.pmod(below, F.lit(2.0)) == 1)), below + 1).otherwise(below)
    exact = F.abs(value) < F.lit(2.0**52 / 10**digits)  # larger doubles have no further decimals
    return F.when(exact, whole / scale).otherwise(value)
