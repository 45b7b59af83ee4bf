"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: bit i is set if it is set in more than half of the XXH64
hashes (seed 42) of the word shingles, repeats included. Words are runs of characters
other than space, tab, line feed, vertical tab, form feed and carriage return, with
A-Z lower-cased. Fewer words than a shingle are one shingle; no words give zero.

Two fingerprints at most ``max_bits`` apart agree in one of ``segments`` segments up to
``max_bits // segments`` bits. So each distinct fingerprint is put into a table per
segment, enumerates the small Hamming ball around each of its segments, fetches the
table matches and verifies the complete distance. The exchange carries distinct
fingerprints only, as (segment value, fingerprint) pairs sorted by value; a task goes
through its values and links the fingerprints of each by comparing 64-bit words in
blocks. From a value with many matches it returns the links of a spanning forest, not
the pairs. A value shared by more than ``hot`` fingerprints is split: a pair that agrees
there up to the ball's radius differs in at most ``max_bits`` of the other bits, so it
agrees exactly in one of ``max_bits + 1`` parts of those, and each part is a key of its
own (spread over as many tasks as it has values).

Null text has the fingerprint zero and is linked like any other. A component is a set of
linked fingerprints; ``component_id`` is its smallest id, null where none of its rows has
one. So rows of one id with unrelated texts stay in components of their own. Repeated ids
and rows each give their own row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlens.llm.common import utf8_buffers
from stationlens.llm.components import components
from stationlens.session import written

_BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_SHIFTS = np.arange(64, dtype=np.uint64)
#: Hashes turned into bits at once.
_BITS_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z only, and exactly the six blanks
    if len(words) < width:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    shifted = [words[i:] for i in range(width)]
    return np.fromiter((digest(s, 42) for s in map(b" ".join, zip(*shifted))), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, as an unsigned number."""
    if len(hashes) == 0:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + _BITS_AT_ONCE].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << _SHIFTS).sum())


def with_fingerprint(docs: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the column ``simhash`` (the 64 bits as a signed long)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("simhash", text_col)]
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("_simhash_text"), *others)
    schema = T.StructType([*source.schema.fields[1:], T.StructField("simhash", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(0))
            raw = data.tobytes()
            bounds = offsets.tolist()
            prints = [fingerprint(shingle_hashes(raw[s:e], width)) for s, e in zip(bounds, bounds[1:])]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], signed], names=schema.names)

    return source.mapInArrow(task, schema)


def balls(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``bits`` bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)]


def _segment_bounds(segments: int) -> list[tuple[int, int]]:
    edges = [64 * i // segments for i in range(segments + 1)]
    return list(zip(edges, edges[1:]))


def _keyed(prints: DataFrame, segments: int, radius: int) -> DataFrame:
    """Table rows (``probe`` false) and ball rows of all segments: (segment, value, probe, fp)."""
    def ball(number: int, low: int, high: int) -> Column:
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        flips = F.array(*[F.lit(m).cast("long") for m in balls(high - low, radius)])
        fields = lambda m: F.struct(F.lit(number).alias("segment"), value.bitwiseXOR(m).alias("value"), (m != 0).alias("probe"))
        return F.transform(flips, fields)

    rows = [ball(number, low, high) for number, (low, high) in enumerate(_segment_bounds(segments))]
    every = prints.select("fp", F.explode(F.concat(*rows)).alias("e"))
    return every.select("e.segment", "e.value", "e.probe", "fp")


def _link(table: np.ndarray, probes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs near enough of one value."""
    nodes, place = np.unique(np.concatenate([table, probes]), return_inverse=True)
    root = np.arange(len(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    step = max(1, (1 << 22) // max(1, len(nodes)))
    for at in range(0, len(table), step):
        near = np.bitwise_count(table[at : at + step, None] ^ nodes[None, :]) <= max_bits
        left, right = np.nonzero(near)
        left = place[at + left]
        while len(left):
            a, b = _roots(root, left), _roots(root, right)
            keep = a != b
            left, right, a, b = left[keep], right[keep], a[keep], b[keep]
            if not len(left):
                break
            _, first = np.unique(a, return_index=True)  # one link of each tree, then look again
            for i in first.tolist():
                x, y = find(int(a[i])), find(int(b[i]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(nodes[left[i]]), int(nodes[right[i]])))
    return links


def _roots(root: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    up = root[nodes]
    while True:
        further = root[up]
        if np.array_equal(further, up):
            return up
        up = further


def _links(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Near pairs that hold the fingerprints of each key together, from rows sorted by key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] = []
        done = False
        source = iter(batches)
        while not done:
            batch = next(source, None)
            done = batch is None
            if not done:
                columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                carry = [np.concatenate(c) for c in zip(carry, columns)] if carry else columns
            if not carry or not len(carry[0]):
                continue
            segment, value, probe, fp = carry
            edge = np.flatnonzero((segment[1:] != segment[:-1]) | (value[1:] != value[:-1])) + 1
            starts = np.concatenate([[0], edge, [len(fp)] if done else []]).astype(np.int64)
            if len(starts) > 1:
                # Only keys with a table row and another row can hold a link.
                size = np.diff(starts)
                tables = np.add.reduceat(~probe[: starts[-1]], starts[:-1])
                links: list[tuple[int, int]] = []
                for i in np.flatnonzero((size > 1) & (tables > 0)).tolist():
                    part = slice(starts[i], starts[i + 1])
                    prints, probing = fp[part].view(np.uint64), probe[part]
                    links += _link(prints[~probing], prints[probing], max_bits)
                if links:
                    pairs = np.array(links, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])
            carry = [c[starts[-1] :] for c in carry]

    keys = [c for c in keyed.columns if c not in ("probe", "fp")]
    rows = keyed.select(F.xxhash64(*keys[:-1]).alias("segment"), F.col(keys[-1]).alias("value"), "probe", "fp")
    return rows.repartition("segment", "value").sortWithinPartitions("segment", "value").mapInArrow(task, "x long, y long")


def similar_prints(prints: DataFrame, max_bits: int = 3, segments: int = 2, hot: int = 8192) -> DataFrame:
    """(x, y): near pairs of the distinct fingerprints ``fp``, enough of them to connect all near ones."""
    radius = max_bits // segments
    counts = []
    for number, (low, high) in enumerate(_segment_bounds(segments)):
        mask = (1 << (high - low)) - 1
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask))
        counts.append(prints.groupBy(F.lit(number).alias("segment"), value.alias("value")).count().filter(F.col("count") > hot))
    crowded = counts[0]
    for more in counts[1:]:
        crowded = crowded.union(more)
    crowded = written(crowded.select("segment", "value"), "crowded-segments")
    keyed = _keyed(prints, segments, radius)
    if crowded.isEmpty():
        return _links(keyed, max_bits)
    # A crowded value has more than `hot` of the distinct fingerprints, so few values are crowded.
    marked = keyed.join(crowded.withColumn("crowded", F.lit(True)), ["segment", "value"], "left")
    calm = marked.filter("crowded is null").select("segment", "value", "probe", "fp")
    parts = []
    for number, (low, high) in enumerate(_segment_bounds(segments)):
        rest = [b for b in range(64) if not low <= b < high]
        cuts = [rest[len(rest) * i // (max_bits + 1) : len(rest) * (i + 1) // (max_bits + 1)] for i in range(max_bits + 1)]
        masks = [sum(1 << b for b in cut) for cut in cuts]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        parts.append(F.when(F.col("segment") == number, F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])))
    split = marked.filter("crowded").withColumn("e", F.explode(F.coalesce(*parts)))
    split = split.select("segment", F.col("value").alias("base"), "e.part", F.col("e.bits").alias("value"), "probe", "fp")
    return _links(calm, max_bits).union(_links(split, max_bits))


def near_duplicates(
    docs: DataFrame,
    width: int = 3,
    max_bits: int = 3,
    segments: int = 2,
    hot: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, the columns ``keep``, and as signed longs
    simhash and group_print (the smallest fingerprint of the component)."""
    kept = [F.col(f"`{c}`") for c in keep if c not in (id_col, "doc_id")]
    text = F.col(f"`{text_col}`").cast("string").alias("_print_text")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text, *kept)
    prints = written(with_fingerprint(source, width, "_print_text"), "simhash")
    # Equal fingerprints are one node; a component is known by its smallest fingerprint.
    nodes = written(prints.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-nodes")
    links = written(similar_prints(nodes.select("fp"), max_bits, segments, hot).distinct(), "simhash-links")
    reached = components(links.withColumnsRenamed({"x": "a", "y": "b"})).withColumnRenamed("node", "fp")
    found = nodes.join(reached, "fp", "left").withColumn("group_print", F.coalesce("component", "fp"))
    least = found.groupBy("group_print").agg(F.min("least").alias("component_id"))
    named = found.join(least, "group_print").select(F.col("fp").alias("simhash"), "group_print", "component_id")
    return prints.join(named, "simhash").select(
        "doc_id", *kept, F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id", "simhash", "group_print"
    )
