"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SALTS = 32
#: A side may be broadcast when it has been counted and is neither longer nor, by the width
#: of its columns, larger than this.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 << 20
_NUMBER, _TEXT, _ITEMS = 8, 64, 16


def row_bytes(kind: T.DataType) -> int:
    """About how many bytes a value takes: texts count as 64, arrays as 16 items."""
    if isinstance(kind, T.StructType):
        return sum(row_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _ITEMS * row_bytes(kind.elementType)
    if isinstance(kind, T.MapType):
        return _ITEMS * (row_bytes(kind.keyType) + row_bytes(kind.valueType))
    return _TEXT if isinstance(kind, (T.StringType, T.BinaryType)) else _NUMBER


def fits_broadcast(table: DataFrame, rows: int) -> bool:
    return rows <= BROADCAST_ROWS and rows * row_bytes(table.schema) <= BROADCAST_BYTES


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: list[str],
    salts: int = DEFAULT_SALTS,
    how: str = "inner",
) -> DataFrame:
    """Equi-join on ``keys`` with each key of ``big`` spread over ``salts`` parts.

    ``small`` (few rows per key) is replicated once per part, so the rows of one
    hot key are joined by many tasks. ``spread`` names columns of ``big`` that
    vary within a key; hashing them keeps the salt the same on every retry.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = big.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how)
    return joined.drop("_salt")


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    rows: int,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
) -> DataFrame:
    """Join ``big`` to a ``table`` counted to have at most ``rows`` rows.

    Small tables are broadcast, larger ones joined with salted keys.
    """
    if fits_broadcast(table, rows):
        return big.join(F.broadcast(table), keys, how)
    return salted_join(big, table, keys, spread, how=how)
