"""Interpolated modified Kneser-Ney model of any order: counted in Spark, memory-mapped by workers.

Tokens are words (runs of characters other than space and U+0009-U+000D, A-Z lower-cased)
and one end token per text. A token's context are the ``order - 1`` tokens before it, with
beginnings in front of the text.

    p_m(w | c) = max(a(cw) - D_m(a(cw)), 0) / A(c) + g_m(c) p_m-1(w | c without its first token)
    p_1(w)     = max(a(w) - D_1(a(w)), 0) / A      + g_1 / (V + 1)

At the highest order a(cw) is the count of the sequence, below it the number of different
tokens seen before it. A(c) is their sum over w, D_m are the discounts for values 1, 2 and
3 or more, from how many values are 1 to 4, and g_m(c) gives the discounted mass back.
A context never seen passes on to the shorter one. V + 1 counts the unknown token, so
everything has a probability.

Sequences are chained numbers: that of m tokens is known by the number of its first m - 1
tokens and that of its last word, and has a number itself, its place among all shards. So
a level needs one pass over the texts, which looks up the levels below. What a sequence
ends with, one token less, is found in its shard by the same numbers.

The model is a folder in the shared directory, made of flat arrays in shards:

* level 1 – sorted 64-bit hashes and counts of words,
* level m – sorted keys (number of the context, number of the word),
* for each entry its value a, up to 254 in a byte, larger ones in a short second array,
* and below the highest level for each entry as context how many entries with values 1, 2
  and more follow it, and the sum of their values, again in bytes where they fit.

Tasks count in their own memory and send sorted, compressed arrays with one entry per
word or sequence to the shards, so a frequent word is one entry per task and no group grows
with its frequency. Shards are spread by hash, one for each ``SHARD_BYTES`` of text. Files
are put in place by renaming, and their contents do not depend on the attempt, so lost
tasks may run again. Workers map the files and look up sorted keys; nothing of the model
passes through the driver but one row of totals per shard and level.

The shared directory must be one that workers can open as files. A key has 64 bits; more
sequences than the bits left over by the word numbers can tell apart end with an error.

Null text is empty: its end token alone. Rows with null id are learned from. Repeated ids
and rows count as often as they occur. Without any text to learn from every token is
unknown, with probability 1 under the model.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import slices, utf8_buffers
from stationlens.session import new_path, written

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
#: Hash of the end token; words have other hashes but for chance.
END = np.uint64(0xD1B54A32D192ED03)
#: Entries a task gathers before it sends them.
GATHER = 3_000_000
#: Bytes of text looked up at once; each shard is asked once for them.
SLICE = 4 << 20
#: Bytes of text for each shard of a level.
SHARD_BYTES = 16 << 20
OVER = 255
SCORE_SCHEMA = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _byte_values() -> np.ndarray:
    """A random number for each byte of a word, the same for A-Z and a-z, zero for blanks."""
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    values[[0x20, 9, 10, 11, 12, 13]] = 0
    return values


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2 ** 64."""
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, out=powers)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows (end tokens included) and the number of tokens of each row."""
    rows = len(offsets) - 1
    values = _byte_values()[data]
    visible = values != 0
    start = visible.copy()
    start[1:] &= ~visible[:-1]
    row_start = offsets[:-1][np.diff(offsets) > 0]
    start[row_start] = visible[row_start]
    starts = np.flatnonzero(start)
    words = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    counts = words + 1
    out = np.full(len(starts) + rows, END, np.uint64)
    if len(starts):
        # Powers go on through all words; what is in front of a word is taken off and divided out.
        values *= _powers(_PRIME, len(data))
        np.cumsum(values, out=values)
        sums = np.append(values[starts[1:] - 1], values[-1])
        sums[1:] -= sums[:-1].copy()
        sums *= _powers(_INVERSE, int(starts[-1]) + 1)[starts]
        sums ^= sums >> np.uint64(31)
        sums *= np.uint64(0xBF58476D1CE4E5B9)
        sums ^= sums >> np.uint64(29)
        out[np.arange(len(starts)) + np.repeat(np.arange(rows), words)] = sums
    return out, counts


def _pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences, and columns, as compressed byte planes."""
    steps = np.diff(keys, prepend=np.uint64(0))
    parts = [len(keys).to_bytes(8, "little")]
    for column in (steps, *[c.astype("<u8") for c in columns]):
        parts.append(np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    if n == 0:
        return []
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, 8, n)
    columns = [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]


def _merge(blobs: list[bytes]) -> list[np.ndarray]:
    """Entries of all blobs by ascending key, the columns of equal keys added up."""
    parts = [p for b in blobs if (p := _unpack(b))]
    if not parts:
        return []
    return _added(*[np.concatenate(column) for column in zip(*parts)])


def _added(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Entries by ascending key, the columns of equal keys added up; a stable sort only merges what is sorted in pieces."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _first(keys)
    return [keys[first], *[np.add.reduceat(c[order], first) for c in columns]]


def _first(ascending: np.ndarray) -> np.ndarray:
    """Places where another value begins."""
    new = np.ones(len(ascending), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
    return np.flatnonzero(new)


def _parted(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard, and where each shard begins and the last ends; short numbers are sorted digit by digit."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _spread(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = keys * np.uint64(_PRIME)
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % shards


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards of words are ranges of their hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _store(path: str, array: np.ndarray) -> None:
    """Put a file in place by renaming; attempts of one task write the same bytes."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as file:
        file.write(array.tobytes())
        file.flush()
        os.fsync(file.fileno())
    os.replace(own, path)


def _map(path: str, dtype) -> np.ndarray:
    if os.path.getsize(path) == 0:
        return np.zeros(0, dtype)
    return np.asarray(np.memmap(path, dtype, "r"))


def _send(entries: list[tuple[np.ndarray, np.ndarray]], shard_of: Callable, shards: int) -> Iterator[pa.RecordBatch]:
    """One row (shard, blob) per shard for entries (keys, counts) gathered so far."""
    keys, counts = _added(*[np.concatenate(column) for column in zip(*entries)])
    order, edges = _parted(shard_of(keys, shards), shards)
    numbers, blobs = [], []
    for s in np.flatnonzero(np.diff(edges)).tolist():
        pick = order[edges[s] : edges[s + 1]]
        numbers.append(s)
        blobs.append(_pack(keys[pick], counts[pick]))
    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _counted(batches: Iterator[pa.RecordBatch], keys_of: Callable, shard_of: Callable, shards: int) -> Iterator[pa.RecordBatch]:
    entries, size = [], 0
    for batch in batches:
        data, offsets = utf8_buffers(batch.column(0))
        for a, b in slices(offsets, SLICE):
            part = offsets[a : b + 1]
            keys, counts = np.unique(keys_of(data[part[0] : part[-1]], part - part[0]), return_counts=True)
            entries.append((keys, counts.astype(np.uint64)))
            size += len(keys)
            if size > GATHER:
                yield from _send(entries, shard_of, shards)
                entries, size = [], 0
    if entries:
        yield from _send(entries, shard_of, shards)


#: By shard, which keys were found there and at what places.
Found = list[tuple[int, np.ndarray, np.ndarray]]


class Level:
    """The mapped shards of the words (level 1) or of the sequences of some tokens."""

    def __init__(self, path: str, level: int, bases: list[int]):
        self.path, self.level = f"{path}/{level}", level
        self.bases, self.shards = np.array(bases, np.int64), len(bases) - 1
        self.shard_of = _word_shard if level == 1 else _spread
        self.mapped: dict[tuple[str, int], np.ndarray] = {}

    @property
    def size(self) -> int:
        return int(self.bases[-1])

    def held(self, name: str, shard: int, dtype) -> np.ndarray:
        if (name, shard) not in self.mapped:
            self.mapped[name, shard] = _map(f"{self.path}/{shard}.{name}", dtype)
        return self.mapped[name, shard]

    def find(self, keys: np.ndarray) -> Found:
        """Where the known ones of ``keys`` are; they may come in any order and repeat."""
        order, edges = _parted(self.shard_of(keys, self.shards), self.shards)
        found = []
        for s in np.flatnonzero(np.diff(edges)).tolist():
            held = self.held("keys", s, np.uint64)
            if len(held):
                pick = order[edges[s] : edges[s + 1]]
                asked = keys[pick]
                # In ascending order, as neighbours are found in the same memory.
                up = np.argsort(asked)
                asked = asked[up]
                at = np.searchsorted(held, asked)
                at[at == len(held)] = 0
                known = held[at] == asked
                found.append((s, pick[up[known]], at[known]))
        return found

    def numbers(self, found: Found, n: int) -> np.ndarray:
        """Numbers of ``n`` keys, -1 for unknown ones."""
        out = np.full(n, -1, np.int64)
        for s, pick, at in found:
            out[pick] = self.bases[s] + at
        return out

    def column(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Values of a column for ascending numbers; zero for those outside."""
        out = np.zeros(len(numbers), np.uint64)
        edges = np.searchsorted(numbers, self.bases)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            out[edges[s] : edges[s + 1]] = self.held(name, s, np.uint64)[numbers[edges[s] : edges[s + 1]] - self.bases[s]]
        return out

    def counts(self, found: Found, n: int) -> np.ndarray:
        """The counts of ``n`` keys, zero for unknown ones."""
        out = np.zeros(n, np.uint64)
        for s, pick, at in found:
            out[pick] = self.held("count", s, np.uint64)[at]
        return out

    def values(self, found: Found, n: int) -> np.ndarray:
        """The values of ``n`` keys, zero for unknown ones."""
        out = np.zeros(n, np.int64)
        for s, pick, at in found:
            value = self.held("value", s, np.uint8)[at].astype(np.int64)
            over = np.flatnonzero(value == OVER)
            if len(over):
                value[over] = self._large("large", s, at[over], 2)[:, 0]
            out[pick] = value
        return out

    def following(self, found: Found, n: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mass that discounts ``d`` leave behind ``n`` keys as contexts, and the sum of the values there; zero for unknown ones."""
        left, size = np.zeros(n), np.zeros(n)
        for s, pick, at in found:
            rows = self.held("follow", s, np.uint8).reshape(-1, 4)[at].astype(np.int64)
            over = np.flatnonzero((rows == OVER).any(axis=1))
            if len(over):
                rows[over] = self._large("more", s, at[over], 5)
            left[pick], size[pick] = discounted(rows, d)
        return left, size

    def _large(self, name: str, shard: int, at: np.ndarray, width: int) -> np.ndarray:
        """The rows of a shard's short array for the entries ``at``."""
        table = self.held(name, shard, np.uint64).reshape(-1, width)
        return table[np.searchsorted(table[:, 0], at.astype(np.uint64)), 1:]


class Chain:
    """Numbers of the tokens of texts and of the sequences that end with them."""

    def __init__(self, path: str, bases: list[list[int]]):
        self.levels = [Level(path, m + 1, b) for m, b in enumerate(bases)]
        self.bits = max(1, self.levels[0].size.bit_length())

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[Found], np.ndarray, np.ndarray]:
        """Tokens per row; the place of each token among the distinct ones; for each level where
        those (level 1) or the sequences that end with each token (level 2 on) are; the number
        of each token's word (-1: unknown) and of its context one level above the highest.

        The context in front of a text is the number behind the last one of its level.
        """
        hashes, counts = token_hashes(data, offsets)
        begin = np.cumsum(counts) - counts
        coded = pa.array(hashes).dictionary_encode()
        distinct, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        found = [self.levels[0].find(distinct)]
        word = number = self.levels[0].numbers(found[0], len(distinct))[place]
        for level, above in zip(self.levels, [*self.levels[1:], None]):
            context = behind(number, begin, level.size)
            if above:
                found.append(self.find(above, context, word))
                number = above.numbers(found[-1], len(word))
        return counts, place, found, word, context

    def keys(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return context.astype(np.uint64) << np.uint64(self.bits) | word.astype(np.uint64)

    def suffixes(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers, at the highest level held, of what the sequences (context, word) of the next level end with; ``context`` ascends."""
        if len(self.levels) == 1:
            return word
        below = self.levels[-1]
        first = _first(context)
        distinct = context[first]
        if len(self.levels) == 2:
            shorter = below.column("keys", distinct) & np.uint64((1 << self.bits) - 1)
        else:
            shorter = below.column("suffix", distinct)
        shorter = shorter.astype(np.int64)
        shorter[distinct == below.size] = self.levels[-2].size  # in front of a text
        shorter = np.repeat(shorter, np.diff(first, append=len(context)))
        return below.numbers(self.find(below, shorter, word), len(word))

    def find(self, level: Level, context: np.ndarray, word: np.ndarray) -> Found:
        """Where the sequences (context, word) are at ``level``; -1 is unknown."""
        known = np.flatnonzero((context >= 0) & (word >= 0))
        return [(s, known[pick], at) for s, pick, at in level.find(self.keys(context[known], word[known]))]


def behind(values: np.ndarray, begin: np.ndarray, first: float) -> np.ndarray:
    """For each token what the one in front of it has, ``first`` where a text begins."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[begin] = first
    return out


def discounted(following: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of mass that discounts leave in contexts with so many values 1, 2 and more, and with the sum of them last."""
    one, two, more, size = following.astype(float).T
    return (one * d[1] + two * d[2] + more * d[3]) / np.maximum(size, 1), size


def discounts(counts_of: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    n = counts_of.astype(float)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [0.0]
    for i in range(3):
        d.append(i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.0)
    return np.clip(np.array(d), 0.0, [0, 1, 2, 3])


def _shared_folder(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name).removeprefix("file://")
    if "://" in path:
        raise RuntimeError("the language model needs a shared folder that workers can open as files")
    return path


#: Rows that shards send to the level below: what they know of its entries, and their own totals.
_NOTES = "kind string, shard int, blob binary"


def _class_counts(values: np.ndarray) -> np.ndarray:
    """How many values are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(values, 5).astype(np.int64), minlength=6)[1:5]


def _store_values(folder: str, shard: int, values: np.ndarray) -> None:
    large = np.flatnonzero(values >= OVER)
    _store(f"{folder}/{shard}.value", np.minimum(values, OVER).astype(np.uint8))
    _store(f"{folder}/{shard}.large", np.column_stack([large.astype(np.uint64), values[large].astype(np.uint64)]))


def _store_following(folder: str, shard: int, following: np.ndarray) -> None:
    large = np.flatnonzero((following >= OVER).any(axis=1))
    _store(f"{folder}/{shard}.follow", np.minimum(following, OVER).astype(np.uint8))
    _store(f"{folder}/{shard}.more", np.column_stack([large.astype(np.uint64), following[large]]))


def _notes_on_contexts(context: np.ndarray, values: np.ndarray, below: list[int]) -> list[tuple[str, int, bytes]]:
    """For each context how many values 1, 2 and more follow, and their sum; ``context`` ascends."""
    if not len(context):
        return []
    begin = np.flatnonzero(np.diff(context, prepend=np.uint64(1 << 63)))
    classes = np.minimum(values, 3)
    columns = [np.add.reduceat((classes == c).astype(np.uint64), begin) for c in (1, 2, 3)]
    columns.append(np.add.reduceat(values.astype(np.uint64), begin))
    return _notes("follow", context[begin], columns, below)


def _notes(kind: str, numbers: np.ndarray, columns: list[np.ndarray], below: list[int]) -> list[tuple[str, int, bytes]]:
    """Sorted numbers and columns for the shards of the level below; the beginning goes to the driver."""
    cut = np.searchsorted(numbers, np.array(below, np.uint64))
    rows = []
    for s in np.flatnonzero(np.diff(cut)).tolist():
        part = slice(cut[s], cut[s + 1])
        rows.append((kind, s, _pack(numbers[part], *[c[part] for c in columns])))
    if cut[-1] < len(numbers):
        rows.append(("begin", 0, np.array([int(c[-1]) for c in columns], "<i8").tobytes()))
    return rows


def _note_table(rows: list[tuple[str, int, bytes]]) -> pa.Table:
    kinds, targets, blobs = zip(*rows) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kinds, pa.string()), "shard": pa.array(targets, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def learn(docs: DataFrame, order: int = 3, shards: int | None = None, text_col: str = "text") -> dict:
    """Count the texts and write the model; returns its description (a few numbers per shard and level)."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    path = _shared_folder(docs, "kneser-ney")
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_texts, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = shards or max(1, -(-size // SHARD_BYTES))
    model = {"path": path, "order": order, "shards": shards, "texts": n_texts, "bases": [], "classes": {}, "begin": {}}

    def store_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        hashes, counts = _merge(table.column("blob").to_pylist())
        _store(f"{path}/1/{shard}.keys", hashes)
        _store(f"{path}/1/{shard}.count", counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(hashes)], "total": [int(counts.sum())]})

    def count_words(batches):
        return _counted(batches, lambda d, o: (token_hashes(d, o)[0],), _word_shard, shards)

    sent = texts.mapInArrow(count_words, "shard int, blob binary").repartition(shards, "shard")
    found = {r["shard"]: r for r in sent.groupBy("shard").applyInArrow(store_words, "shard int, n long, total long").collect()}
    model["bases"].append(_bases(path, 1, found, shards, ("keys", "count")))
    model["tokens"], model["words"] = sum(r["total"] for r in found.values()), model["bases"][0][-1]
    bits = max(1, model["words"].bit_length())
    notes = []
    for level in range(2, order + 1):
        if model["bases"][-1][-1] + 1 >= 1 << (64 - bits):
            raise ValueError(f"{model['bases'][-1][-1]} sequences of {level - 1} tokens are too many for keys of 64 bits")
        made = _count_level(texts, model, level, bits)
        own = made.filter("kind = 'size'").collect()  # a row per shard
        sizes = {r["shard"]: {"n": int.from_bytes(r["blob"], "little")} for r in own}
        model["bases"].append(_bases(path, level, sizes, shards, ("keys", "value", "large") if level == order else ("keys", "suffix")))
        notes.append(made)
    for level in range(order - 1, 0, -1):
        # What the level above told about its contexts, and what lies before the entries of this one.
        above = notes[level - 1].filter("kind = 'left'")
        follow = notes[level - 1] if level == order - 1 else finished
        told = above.union(follow.filter("kind = 'follow'")) if level < order else above
        _gather(model, level + 1, follow)
        finished = _finish_level(told, model, level, bits)
    _gather(model, 1, finished)
    return model


def _bases(path: str, level: int, found: dict, shards: int, files: tuple[str, ...]) -> list[int]:
    """Number of the first entry of each shard; shards without entries get empty files."""
    for shard in set(range(shards)) - set(found):
        for name in files:
            _store(f"{path}/{level}/{shard}.{name}", np.zeros(0, np.uint8))
    return np.concatenate([[0], np.cumsum([found[s]["n"] if s in found else 0 for s in range(shards)])]).tolist()


def _gather(model: dict, level: int, notes: DataFrame) -> None:
    """The numbers of values of a level and what follows the beginning; one short row per shard."""
    rows = notes.filter("kind in ('classes', 'begin')").collect()
    add = lambda kind, n: sum((np.frombuffer(r["blob"], "<i8") for r in rows if r["kind"] == kind), np.zeros(n, np.int64)).tolist()
    model["classes"][level], model["begin"][level] = add("classes", 6), add("begin", 4)


def _count_level(texts: DataFrame, model: dict, level: int, bits: int) -> DataFrame:
    """Counts the sequences of ``level`` tokens, writes their keys and returns notes for the level below."""
    path, shards, top = model["path"], model["shards"], level == model["order"]
    bases = [list(b) for b in model["bases"]]

    def count(batches):
        chain = Chain(path, bases)

        def keys(data, offsets):
            *_, word, context = chain(data, offsets)
            return chain.keys(context, word)

        return _counted(batches, keys, _spread, shards)

    def store(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merge(table.column("blob").to_pylist())
        _store(f"{path}/{level}/{shard}.keys", keys)
        rows = [("size", shard, len(keys).to_bytes(8, "little"))]
        # Each entry is one more token seen before its last level - 1 tokens.
        context, word = (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        suffix = Chain(path, bases).suffixes(context, word).astype(np.uint64)
        if 2 < level < model["order"]:
            _store(f"{path}/{level}/{shard}.suffix", suffix)
        found, times = np.unique(suffix, return_counts=True)
        rows += _notes("left", found, [times.astype(np.uint64)], bases[-1])
        if top:
            _store_values(f"{path}/{level}", shard, counts)
            rows += _notes_on_contexts(keys >> np.uint64(bits), counts, bases[-1])
            rows.append(("classes", 0, _totals(counts)))
        return _note_table(rows)

    sent = texts.mapInArrow(count, "shard int, blob binary").repartition(shards, "shard")
    return written(sent.groupBy("shard").applyInArrow(store, _NOTES), f"kneser-ney-{level}")


def _totals(values: np.ndarray) -> bytes:
    """How many values are 1 to 4 and above 2, and their sum."""
    return np.array([*_class_counts(values), int((values > 2).sum()), int(values.sum(dtype=np.uint64))], "<i8").tobytes()


def _finish_level(told: DataFrame, model: dict, level: int, bits: int) -> DataFrame:
    """Writes what is known of the entries of a level below the highest; returns notes for the level below."""
    path, bases = model["path"], model["bases"][level - 1]
    below = model["bases"][level - 2] if level > 1 else None
    sizes = np.diff(bases).tolist()

    def finish(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        left, following = np.zeros(sizes[shard], np.uint64), np.zeros((sizes[shard], 4), np.uint64)
        for kind in ("left", "follow"):
            merged = _merge([b for k, b in zip(kinds, blobs) if k == kind])
            if merged:
                at = merged[0].astype(np.int64) - bases[shard]
                if kind == "left":
                    left[at] = merged[1]
                else:
                    following[at] = np.stack(merged[1:], axis=1)
        folder = f"{path}/{level}"
        _store_values(folder, shard, left)
        _store_following(folder, shard, following)
        rows = [("classes", 0, _totals(left))]
        if below is not None:
            rows += _notes_on_contexts(_map(f"{folder}/{shard}.keys", np.uint64) >> np.uint64(bits), left, below)
        return _note_table(rows)

    done = told.repartition(model["shards"], "shard").groupBy("shard").applyInArrow(finish, _NOTES)
    done = written(done, f"kneser-ney-finished-{level}")
    for shard in np.flatnonzero(np.array(sizes) == 0).tolist():
        for name in ("value", "large", "follow", "more"):
            _store(f"{path}/{level}/{shard}.{name}", np.zeros(0, np.uint8))
    return done


class Scorer:
    """Probabilities from the mapped arrays of a model."""

    def __init__(self, model: dict):
        self.model = model
        self.chain = Chain(model["path"], model["bases"][: model["order"] - 1])
        self.top = Level(model["path"], model["order"], model["bases"][-1])
        self.d = {m: discounts(np.array(c[:4])) for m, c in model["classes"].items()}
        one, two, _, _, more, self.k_total = model["classes"][1]
        self.back = (self.d[1][1:] * [one, two, more]).sum() / self.k_total if self.k_total else 1.0

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each row."""
        counts, place, found, word, context = self.chain(data, offsets)
        begin = np.cumsum(counts) - counts
        total, vocabulary, order = self.model["tokens"], self.model["words"], self.model["order"]
        levels, distinct = [*self.chain.levels, self.top], int(place.max()) + 1
        word_count = levels[0].counts(found[0], distinct).astype(float)
        base = np.log10((word_count + 1) / (total + vocabulary + 1))
        k = levels[0].values(found[0], distinct)
        p = (self.back / (vocabulary + 1) + np.maximum(k - self.d[1][np.minimum(k, 3)], 0) / max(1, self.k_total))[place]
        found.append(self.chain.find(self.top, context, word))
        for m in range(2, order + 1):
            d = self.d[m]
            if m == 2:
                left, size = (column[place] for column in levels[0].following(found[0], distinct, d))
            else:
                left, size = levels[m - 2].following(found[m - 2], len(word), d)
            left_first, size_first = discounted(np.array([self.model["begin"][m]]), d)
            left, size = behind(left, begin, left_first[0]), behind(size, begin, size_first[0])
            value = levels[m - 1].values(found[m - 1], len(word))
            p = np.where(size > 0, np.maximum(value - d[np.minimum(value, 3)], 0) / np.maximum(size, 1) + left * p, p)
        logs = np.log10(p)
        seen = (word_count > 0)[place].astype(np.int64)
        return counts, np.add.reduceat(seen, begin), np.add.reduceat(base[place], begin), np.add.reduceat(logs, begin)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score (those names are replaced)."""
    added = [c.split()[0] for c in SCORE_SCHEMA.split(", ")]
    names = [c for c in docs.columns if c not in added and c != text_col]
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("_kn_text"), *[F.col(f"`{c}`") for c in names])
    schema = source.drop("_kn_text").schema
    for field in SCORE_SCHEMA.split(", "):
        schema = schema.add(*field.split())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(0))
            parts = [scorer(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, SLICE)]
            tokens, known, base, logs = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0)] * 4
            arrays = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(tokens), model["tokens"]), pa.int64()), pa.array(base, pa.float64()), pa.array(logs, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=schema.names)

    return source.mapInArrow(task, schema)
