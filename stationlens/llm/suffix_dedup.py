"""Exact removal of repeated byte strings across documents, by suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts in a document with a
smaller id is removed. Strings are judged on the input; matches never cross documents.

Sorting all suffixes of a corpus would ship every byte many times, so only suffixes that
can matter are sorted:

1. Documents are put into blocks. In each window of ``length`` bytes the ``GRAM`` bytes
   with the least hash are its anchor; equal windows have equal anchors. A block sends
   the distinct hashes of its anchors to buckets, in sorted order, and gets back one
   number for each: whether it occurs in another block, too.
2. Of each anchor seen in more than one document the block sends its surroundings (the
   bytes of all windows around it), once per distinct content with the smallest id. A
   bucket sorts the suffixes from the anchors, and the reversed bytes before them, by
   deep-shallow sorting (``deep_shallow``). Common prefixes tell for each offset which
   windows are equal, and so which windows also start in a smaller document. The block
   gets back a bit for each offset.
3. The block marks the windows, takes their union and cuts it out of its texts.

An anchor in more than ``hot`` blocks is split: there the windows around it are sent to
buckets of their own, spread by the hash of the whole window, once per block. So a
passage that a third of all documents share is one entry per block, and its neighbours
do not meet in one task. Nothing is sampled and no group is cut off. Texts are shuffled
once; everything else that moves is compressed.

Null text is empty. Rows without id come after all ids: they lose what any document with
an id has, and take nothing from others. Rows with equal ids do not affect each other.
Empty and short texts stay as they are. Further columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlens.llm.common import give_back, given_back, utf8_buffers
from stationlens.llm.deep_shallow import deep_shallow
from stationlens.session import written

GRAM = 16
BLOCK_BYTES = 2 << 20
#: Windows hashed at once; some hundred bytes of arrays each.
AT_ONCE = 1 << 17
NO_ID = np.iinfo(np.int64).max
_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def _sliding(values: np.ndarray, width: int, combine) -> np.ndarray:
    """``combine`` (min or max) over every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = combine(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return combine(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, row_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows inside rows, and the hashes of their grams.

    Where several grams of a window have its least hash, all are anchors.
    """
    size, span = len(data), length - GRAM + 1
    found, hashes = [], []
    for begin in range(0, max(0, size - length + 1), AT_ONCE):
        part = data[begin : begin + AT_ONCE + length - 1]
        windows = len(part) - length + 1
        padded = np.zeros(len(part) + 8, np.uint8)
        padded[: len(part)] = part
        words = np.ndarray((len(part),), np.uint64, padded, strides=(1,))
        grams = len(part) - GRAM + 1
        h = _mix(words[:grams] * _M[0] ^ _mix(words[8 : 8 + grams])) | np.uint64(1)
        least = _sliding(h, span, np.minimum)
        # Windows that leave their row have no anchor (0 is below all hashes).
        ends = row_ends[np.searchsorted(row_ends, np.arange(begin, begin + windows), side="right").clip(max=len(row_ends) - 1)]
        least[np.arange(begin, begin + windows) + length > ends] = 0
        border = np.zeros(span - 1, np.uint64)
        most = _sliding(np.concatenate([border, least, border]), span, np.maximum)
        at = np.flatnonzero(h == most)
        found.append(at + begin)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    positions, first = np.unique(np.concatenate(found), return_index=True)
    return positions, np.concatenate(hashes)[first]


class Block:
    """Rows of one block with their bytes laid end to end."""

    def __init__(self, payload: bytes):
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)) as stream:
            self.rows = stream.read_next_batch()
        self.ids = self.rows.column(0).fill_null(NO_ID).to_numpy()
        self.data, self.offsets = utf8_buffers(self.rows.column(1))

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes and rows of all anchors."""
        ends = self.offsets[1:]
        position, h = anchors(self.data, ends, length)
        return position, h, np.searchsorted(ends, position, side="right")


def pack_block(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def _table(block, bucket, blobs) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blobs, pa.binary())})


MESSAGE = "block long, bucket int, blob binary"


def _distinct_grams(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, their rows, the distinct hashes, each anchor's place there, and which occur in several rows."""
    position, h, row = block.anchors(length)
    distinct, place = np.unique(h, return_inverse=True)
    low, high = np.full(len(distinct), len(block.ids)), np.full(len(distinct), -1)
    np.minimum.at(low, place, row)
    np.maximum.at(high, place, row)
    return position, row, distinct, place, low != high


def seen_elsewhere(table: pa.Table, hot: int) -> pa.Table:
    """Bucket of gram hashes: per block and hash 0, 1 (in another block, too) or 2 (in more than ``hot``)."""
    blobs = [np.frombuffer(b, np.uint64) for b in table.column("blob").to_pylist()]
    _, place, count = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    answer = ((count > 1).astype(np.uint8) + (count > hot))[place]
    parts = np.split(answer, np.cumsum([len(b) for b in blobs])[:-1])
    press = zstandard.ZstdCompressor(level=1).compress
    return _table(table.column("block"), table.column("bucket"), [press(p.astype(np.uint8).tobytes()) for p in parts])


class Surroundings:
    """Distinct surroundings of the surviving anchors of a block, and where they occur."""

    def __init__(self, block: Block, length: int, buckets: int, answers: dict[int, np.ndarray]):
        position, row, distinct, place, several = _distinct_grams(block, length)
        state = several.astype(np.uint8)
        for b, pick in _by_bucket(_bucket(distinct, buckets), buckets):
            state[pick] = np.maximum(state[pick], answers[b])
        state = state[place]
        start, end = block.offsets[:-1][row], block.offsets[1:][row]
        reach = length - GRAM
        normal, hot = state == 1, np.flatnonzero(state == 2)
        at, owner = position[normal], row[normal]
        before = np.minimum(at - start[normal], reach)
        after = np.minimum(end[normal] - at, length)
        key = distinct[place[normal]]
        if len(hot):
            # Every window around a hot anchor stands for itself.
            first = np.maximum(position[hot] - reach, start[hot])
            last = np.minimum(position[hot], end[hot] - length)
            spots = [np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist())]
            spots, which = np.unique(np.concatenate(spots), return_index=True)
            rows = np.repeat(row[hot], last - first + 1)[which]
            at, owner = np.concatenate([at, spots]), np.concatenate([owner, rows])
            before = np.concatenate([before, np.zeros(len(spots), np.int64)])
            after = np.concatenate([after, np.full(len(spots), length)])
            key = np.concatenate([key, _window_hash(block.data, spots, length)])
        self.at, self.owner, self.before, self.after = at, owner, before, after
        self.width = reach + length
        content = np.empty((len(at), self.width + 2), np.uint8)
        padded = np.concatenate([block.data, np.zeros(self.width, np.uint8)])
        content[:, :-2] = sliding_window_view(padded, self.width)[at - before]
        content[:, :-2][np.arange(self.width) >= (before + after)[:, None]] = 0
        content[:, -2], content[:, -1] = before, after
        whole = np.ascontiguousarray(content).view(f"V{self.width + 2}").ravel()
        _, first, self.entry = np.unique(whole, return_index=True, return_inverse=True)
        self.content, self.key = content[first], key[first]
        self.least = np.full(len(first), NO_ID)
        np.minimum.at(self.least, self.entry, block.ids[owner])


def _window_hash(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for byte in range(length):
        h = (h ^ data[at + byte]) * _M[0]
        h ^= h >> np.uint64(29)
    return _mix(h)


def covered_windows(ids: np.ndarray, content: np.ndarray, before: np.ndarray, after: np.ndarray, length: int, shallow: int) -> np.ndarray:
    """For each entry a bit per offset: the window that far before the anchor also starts in a smaller document."""
    reach = length - GRAM
    bits = np.zeros(len(ids), np.uint64)
    if len(ids) == 0:
        return bits
    width = content.shape[1]
    start = np.arange(len(ids)) * width
    flat = np.concatenate([np.ascontiguousarray(content).ravel(), np.zeros(length, np.uint8)])
    right = np.empty((len(ids), length + 1), np.uint8)
    right[:, :-1] = sliding_window_view(flat, length)[start + before]
    right[:, :-1][np.arange(length) >= after[:, None]] = 0
    right[:, -1] = after
    rights, right_of = np.unique(np.ascontiguousarray(right).view(f"V{length + 1}").ravel(), return_inverse=True)
    rights = np.frombuffer(rights.tobytes(), np.uint8).reshape(-1, length + 1)
    order, prefix = deep_shallow(rights[:, :-1], rights[:, -1].astype(np.int64), np.zeros(len(rights), np.int64), shallow)
    rank = np.empty(len(rights), np.int64)
    rank[order] = np.arange(len(rights))
    rank = rank[right_of]
    # Entries whose anchors are the same gram form a group.
    group = np.cumsum(prefix < GRAM)[rank]
    flat = np.concatenate([np.zeros(reach, np.uint8), flat])
    left = np.empty((len(ids), reach + 9), np.uint8)
    left[:, :reach] = sliding_window_view(flat, reach)[start + before][:, ::-1]
    left[:, :reach][np.arange(reach) >= before[:, None]] = 0
    left[:, reach] = before
    left[:, reach + 1 :] = group.astype("<u8").view(np.uint8).reshape(-1, 8)
    lefts, left_of = np.unique(np.ascontiguousarray(left).view(f"V{reach + 9}").ravel(), return_inverse=True)
    lefts = np.frombuffer(lefts.tobytes(), np.uint8).reshape(-1, reach + 9)
    left_group = np.ascontiguousarray(lefts[:, reach + 1 :]).view("<u8").ravel().astype(np.int64)
    order, left_prefix = deep_shallow(lefts[:, :reach], lefts[:, reach].astype(np.int64), left_group, 8)
    left_rank = np.empty(len(lefts), np.int64)
    left_rank[order] = np.arange(len(lefts))
    left_rank = left_rank[left_of]
    for offset in range(reach + 1):
        fit = np.flatnonzero((before >= offset) & (after >= length - offset))
        if not len(fit):
            continue
        right_class = np.cumsum(prefix < length - offset)[rank[fit]]
        left_class = np.cumsum(left_prefix < offset)[left_rank[fit]]
        key = right_class * (len(lefts) + 1) + left_class
        by_key = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.diff(key[by_key], prepend=-1))
        least = np.minimum.reduceat(ids[fit][by_key], begin)
        size = np.diff(np.append(begin, len(fit)))
        smaller = np.repeat(least, size) < ids[fit][by_key]
        bits[fit[by_key[smaller]]] |= np.uint64(1 << offset)
    return bits


def judge_bucket(table: pa.Table, length: int, shallow: int) -> pa.Table:
    """Bucket of surroundings: per block and entry the offsets of windows in smaller documents."""
    unpress = zstandard.ZstdDecompressor().decompress
    width = 2 * length - GRAM + 2
    ids, contents = [], []
    for blob in table.column("blob").to_pylist():
        raw = unpress(blob)
        n = len(raw) // (8 + width)
        ids.append(np.frombuffer(raw, np.int64, n))
        contents.append(np.frombuffer(raw, np.uint8, offset=8 * n).reshape(n, width))
    content = np.concatenate(contents)
    bits = covered_windows(
        np.concatenate(ids), content[:, :-2], content[:, -2].astype(np.int64), content[:, -1].astype(np.int64), length, shallow
    )
    press = zstandard.ZstdCompressor(level=1).compress
    parts = np.split(bits, np.cumsum([len(i) for i in ids])[:-1])
    return _table(table.column("block"), table.column("bucket"), [press(p.tobytes()) for p in parts])


def removed_bytes(block: Block, around: Surroundings, bits: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of the block are covered by a window to remove."""
    reach = length - GRAM
    start = np.zeros(len(block.data) + 1, bool)
    own = bits[around.entry]
    later = around.least[around.entry] < block.ids[around.owner]
    for offset in range(reach + 1):
        take = (own >> np.uint64(offset) & np.uint64(1)).astype(bool)
        take |= later & (around.before >= offset) & (around.after >= length - offset)
        start[around.at[take] - offset] = True
    total = np.cumsum(start[:-1], dtype=np.int32)
    gone = total > 0
    gone[length:] = total[length:] > total[:-length]
    return gone


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    hot: int = 500,
    buckets: int | None = None,
    shallow: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with the remaining text, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans.

    ``removed`` lists start and end of each run in bytes of the input text. A character of
    which a part is removed is dropped from the remaining text; ``kept_sha256`` is taken
    of the remaining bytes as they are. ``with_text=False`` leaves text and spans out.
    """
    if length < GRAM or 2 * length - GRAM > 255:
        raise ValueError(f"length must be from {GRAM} to {(255 + GRAM) // 2}")
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
    others = [c for c in docs.columns if c not in (id_col, text_col, *added)]
    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias(text_col), *[F.col(f"`{c}`") for c in others]
    )
    schema = T.StructType([f for f in source.schema.fields if with_text or f.name != text_col])
    schema = schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("removed", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))

    def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def close():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([size], pa.int64()), pa.array([pack_block(rows)], pa.binary())], names=["block", "bytes", "payload"]
            )

        for batch in batches:
            if len(batch) == 0:
                continue
            offsets = utf8_buffers(batch.column(1))[1]
            first = 0
            for row in range(len(batch)):
                size += int(offsets[row + 1] - offsets[row]) + 64
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(first, row + 1 - first))
                    yield close()
                    held, size, first, number = [], 0, row + 1, number + 1
            if first < len(batch):
                held.append(batch.slice(first))
        if held:
            yield close()
        held = []
        give_back()

    blocks = written(source.mapInArrow(make_blocks, "block long, bytes long, payload binary"), "repeat-blocks")
    if buckets is None:
        total = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 << 20)))

    def send_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                distinct = _distinct_grams(Block(payload), length)[2]
                sent = [(number, b, distinct[pick].tobytes()) for b, pick in _by_bucket(_bucket(distinct, buckets), buckets)]
                if sent:
                    yield _table(*zip(*sent)).combine_chunks().to_batches()[0]
                give_back()

    grams = blocks.select("block", "payload").mapInArrow(send_grams, MESSAGE)
    elsewhere = grams.groupBy("bucket").applyInArrow(given_back(lambda t: seen_elsewhere(t, hot)), MESSAGE)
    elsewhere = written(elsewhere, "repeat-grams").withColumn("step", F.lit(1))

    def answers_of(table: pa.Table, step: int, dtype) -> dict[int, np.ndarray]:
        unpress = zstandard.ZstdDecompressor().decompress
        rows = zip(table.column("step").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist())
        return {b: np.frombuffer(unpress(blob), dtype) for s, b, blob in rows if s == step}

    def send_surroundings(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.column("payload")[0].as_py())
        around = Surroundings(block, length, buckets, answers_of(right, 1, np.uint8))
        press = zstandard.ZstdCompressor(level=3).compress
        sent = [
            (left.column("block")[0].as_py(), b, press(around.least[pick].tobytes() + around.content[pick].tobytes()))
            for b, pick in _by_bucket(_bucket(around.key, buckets), buckets)
        ]
        return _table(*zip(*sent)) if sent else _table([], [], [])

    texts = blocks.select("block", "payload")
    around = texts.groupBy("block").cogroup(elsewhere.groupBy("block")).applyInArrow(given_back(send_surroundings, 2), MESSAGE)
    judged = around.groupBy("bucket").applyInArrow(given_back(lambda t: judge_bucket(t, length, shallow)), MESSAGE)
    answers = elsewhere.unionByName(judged.withColumn("step", F.lit(2)))
    names = schema.names

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.column("payload")[0].as_py())
        near = Surroundings(block, length, buckets, answers_of(right, 1, np.uint8))
        verdict = answers_of(right, 2, np.uint64)
        bits = np.zeros(len(near.key), np.uint64)
        for b, pick in _by_bucket(_bucket(near.key, buckets), buckets):
            bits[pick] = verdict[b]
        gone = removed_bytes(block, near, bits, length)
        out = {name: [] for name in ("text", *added)}
        for a, b in zip(block.offsets.tolist(), block.offsets[1:].tolist()):
            lost = gone[a:b]
            kept = block.data[a:b][~lost].tobytes()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]]))).tolist()
            out["n_bytes"].append(b - a)
            out["n_removed"].append(int(lost.sum()))
            out["n_spans"].append(len(edges) // 2)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["text"].append(kept.decode(errors="ignore"))
                out["removed"].append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
        columns = {name: block.rows.column(name) for name in (id_col, *others)}
        kinds = {"kept_sha256": pa.string(), "text": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        columns |= {text_col if n == "text" else n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items() if v or n not in ("text", "removed")}
        return pa.table([columns[n] for n in names], names=names)

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(given_back(cut, 2), schema)


def oracle(length: int = 50) -> str:
    """The query's rows in DuckDB, from all windows of all texts in hexadecimal."""
    return f"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
  select r, id, p, substr(h, 2 * p + 1, {2 * length}) as w
  from (select r, id, h, unnest(range(len(h) // 2 - {length - 1})) as p from docs)),
least as (select w, min(id) as least from windows group by w having count(*) > 1),
starts as (
  select r, p, p - lag(p, 1, -{2 * length}) over (partition by r order by p) > {length} as fresh
  from windows join least using (w) where least < id),
spans as (
  select r, min(p) as a, max(p) + {length} as b
  from (select r, p, sum(fresh::int) over (partition by r order by p) as span from starts) group by r, span),
pieces as (
  select r, a, b, substr(h, 2 * lag(b, 1, 0) over (partition by r order by a) + 1, 2 * (a - lag(b, 1, 0) over (partition by r order by a))) as before
  from spans join docs using (r)),
cut as (
  select r, sum(b - a) as n_removed, count(*) as n_spans, string_agg(before, '' order by a) as kept, max(b) as last from pieces group by r)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) as kept_sha256
from docs left join cut using (r)
"""
