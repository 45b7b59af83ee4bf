"""Helpers shared by the operators: tables, text buffers, worker memory."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text a worker turns into arrays at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_memo(key: str, build: Callable[[], object]) -> object:
    """``build()`` once per worker process; tasks run later by the same worker find it again.

    Functions travel by value, so their module globals do not outlive a task.
    """
    memo = sys.modules.setdefault("stationlens_worker_memo", types.ModuleType("stationlens_worker_memo"))
    if not hasattr(memo, key):
        setattr(memo, key, build())
    return getattr(memo, key)


def give_back() -> None:
    """Return freed memory of this worker to the machine; what it keeps counts for its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def given_back(function: Callable[..., pa.Table], tables: int = 1) -> Callable[..., pa.Table]:
    """``function`` of one or two tables, with its memory returned behind each call."""

    def one(table: pa.Table) -> pa.Table:
        out = function(table)
        give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = function(left, right)
        give_back()
        return out

    return two if tables == 2 else one


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    rows = len(offsets) - 1
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def ragged_take(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + counts[i]``, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
