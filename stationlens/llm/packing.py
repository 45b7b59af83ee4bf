"""Hierarchical multi-length packing of token sequences.

Every document becomes ids and an end id. Its full windows of the longest tier
stand alone; what is left is routed to the smallest tier (context size) it fits.
The tiers are packed from the longest to the shortest: a remainder opens a window
of its tier, and the gap behind it is filled from shorter remainders, the longest
fitting one first. Only when nothing fits whole is the next shorter one cut at the
gap, so all windows are full and need no padding. A few ids per task are left at
its end; they fill windows of smaller powers of two, which need none either.

A task packs its own documents in the order it reads them, so nothing is shuffled,
a lost task repeats exactly, and one hot source or one very long document changes
nothing: open remainders are bounded by ``pool_tokens``.

Null text is an empty document: its end id alone. Null or repeated ids and further
columns are allowed; only ``id_col`` and ``text_col`` are read. No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.llm.chunk_cache import library_cache
from stationlens.llm.common import slices, utf8_buffers, worker_memo

TIERS = (128, 256, 512, 1024)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, sequence_tokens long, step_group long, ids binary"
)
#: Sequence ids of one task are below this, so ids of tasks never meet.
TASK_SPAN = 1 << 40


class Packer:
    """Packs remainders of documents into windows of the tiers; see the module."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool = True):
        self.with_ids = with_ids
        self.tiers, self.top, self.step = sorted(tiers), max(tiers), step_tokens
        self.by_length: list[list[tuple]] = [[] for _ in range(self.top)]
        self.present = 0  # bit n: a remainder of n tokens waits
        self.waiting = 0
        self.next_id = task * TASK_SPAN
        self.first_id = self.next_id
        self.step_of: dict[int, tuple[int, int]] = {}  # tier -> (open step group, its tokens)
        self.next_step = task * TASK_SPAN
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.top * self.top
        for at in range(0, whole, self.top):
            self._emit([(doc, at, ids[at : at + self.top], len(ids))], self.top)
        if whole < len(ids):
            self._put((doc, whole, ids[whole:], len(ids)))

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.by_length[n].append(piece)
        self.present |= 1 << n
        self.waiting += n

    def _take(self, at_most: int, above: int = 0) -> tuple | None:
        """The longest waiting remainder of ``above < n <= at_most`` tokens."""
        n = (self.present & ((1 << (at_most + 1)) - 1)).bit_length() - 1
        if n <= above:
            return None
        stack = self.by_length[n]
        piece = stack.pop()
        if not stack:
            self.present &= ~(1 << n)
        self.waiting -= n
        return piece

    def _emit(self, pieces: list[tuple], size: int) -> None:
        group, filled = self.step_of.get(size, (None, self.step))
        if filled + size > self.step and filled > 0:  # the step is full: open the next one of this size
            group, filled = self.next_step, 0
            self.next_step += 1
        self.step_of[size] = (group, filled + size)
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.next_id, offset, size, group, raw if self.with_ids else None))
            offset += len(ids)
        self.next_id += 1

    def pack(self, last: bool = False) -> None:
        """Fill windows of every tier; keeps less than one window of each tier back unless ``last``."""
        for size, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while self.waiting >= size:
                piece = self._take(min(size, self.top - 1), below)
                if piece is None:
                    break
                self._window(piece, size)
        while last and self.waiting:
            size = 1 << (min(self.waiting, self.top).bit_length() - 1)
            piece = self._take(self.top - 1)
            if len(piece[2]) > size:
                piece = self._cut(piece, size)
            self._window(piece, size)

    def _window(self, piece: tuple, size: int) -> None:
        pieces, gap = [piece], size - len(piece[2])
        while gap:
            filler = self._take(gap)
            if filler is None:
                filler = self._cut(self._shortest(), gap)
            pieces.append(filler)
            gap -= len(filler[2])
        self._emit(pieces, size)

    def _shortest(self) -> tuple:
        n = (self.present & -self.present).bit_length() - 1
        stack = self.by_length[n]
        piece = stack.pop()
        if not stack:
            self.present &= ~(1 << n)
        self.waiting -= n
        return piece

    def _cut(self, piece: tuple, size: int) -> tuple:
        """The first ``size`` ids of ``piece``; the rest waits again."""
        doc, start, ids, total = piece
        self._put((doc, start + size, ids[size:], total))
        return doc, start, ids[:size], total

    def drain(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns, self.rows = list(zip(*self.rows)), []
        arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    end_id: int = 0,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 1 << 16,
    pool_tokens: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, with its ids.

    ``with_ids=False`` leaves the ids (little-endian, 32 bits) out and only tells their crc32.

    ``tiers`` are powers of two. Sequences of one ``step_group`` have the same size
    and together ``step_tokens`` tokens (the last group of a size and task fewer).
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_memo("library_cache", lambda: library_cache(shared.value))
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens, with_ids)
        end = np.array([end_id], np.int64)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = utf8_buffers(batch.column(1))
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                ids, counts = encode(data[part[0] : part[-1]], part - part[0])
                upto = np.cumsum(counts)
                for row in range(last - first):
                    own = ids[upto[row] - counts[row] : upto[row]]
                    packer.add(doc_ids[first + row], np.concatenate([own, end]))
                if packer.waiting > pool_tokens:
                    packer.pack()
                if (ready := packer.drain()) is not None:
                    yield ready
        packer.pack(last=True)
        if (ready := packer.drain()) is not None:
            yield ready

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    packed = docs.select(*columns).mapInArrow(task, SCHEMA)
    return packed if with_ids else packed.drop("ids")
