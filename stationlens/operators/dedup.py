"""Upsert semantics: one row per key, the last one written wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: str = "_seq") -> DataFrame:
    """Row with the highest ``order`` for each key.

    ``row_number() = 1`` is applied before the shuffle too (window group limit),
    so each task sends at most one row per key, however many copies a key has.
    """
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")
