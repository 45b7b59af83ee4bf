"""MinHash near-duplicates verified through odd sketches.

A document's set are its distinct shingles of ``width`` words. Words are runs of
characters other than space, tab, line feed, vertical tab, form feed and carriage return,
A-Z lower-cased; fewer words are one shingle, no words give the empty set, which is linked
with nothing. Two documents are linked when the intersection of their sets has at least
``percent`` hundredths of the union. Shingles stand as their XXH64 (seed 42).

* Equal sets are one node, so copies are never compared.
* ``SAMPLES`` MinHash samples of a set are folded into an odd sketch: each sample flips one
  of ``SKETCH_BITS`` bits, so a bit says whether an odd number of samples fell on it. Common
  samples cancel in the XOR of two sketches, and its population count tells how many
  samples differ: precise exactly where the similarity is high.
* The first samples also make ``BANDS`` bands of ``BAND_ROWS``; sets that share a band are
  candidates. A band value returns a spanning forest of its candidates whose sketches are
  near enough, never all pairs. The candidate groups are the components of those forests.
* Within a group the full sets are compared, only where the sketches are near enough and
  the two sets are not connected yet. A group is dealt into blocks of bounded rows and
  bytes. First every block is compared with itself and with the group's first block. Only
  sets that are then outside the largest class of their group are compared with all
  blocks. So a dense group of any size costs work in proportion to its rows; what grows
  faster is the number of its sets that resemble it, but are not linked to it.

A pair at exactly the wanted similarity shares no band with a probability of
(1 - 0.8^3)^24 = 3e-8, and its sketches differ in more than ``_most_bits`` bits with one
below 1e-6; pairs of higher similarity are missed less often still. Links are always
confirmed on the full sets.

Null text counts as empty. Rows keep their number; repeated ids and rows each give a row,
and a row without id has the component of its set, null where no row of the component has
an id. No documents give no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationlens.llm.common import utf8_buffers
from stationlens.llm.components import components
from stationlens.llm.simhash import shingle_hashes
from stationlens.operators.skew import BROADCAST_ROWS
from stationlens.session import written

SAMPLES = 192
SKETCH_BITS = 256
BANDS, BAND_ROWS = 24, 3
#: Shingles hashed at once, and the bounds of a block: sets, and bytes of their shingles.
_AT_ONCE = 1 << 15
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
#: Sets of one band value compared within a task; a larger value makes one group as it is.
HOT = 4096

_SETS = "doc_id long, key long, key2 long, n long, s0 long, s1 long, s2 long, s3 long, bands array<long>, shingles binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12)
    draw = lambda: rng.integers(0, 1 << 64, SAMPLES, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row for each (non-empty) set."""
    factors, offsets = _factors()
    out = np.full((len(sets), SAMPLES), np.iinfo(np.uint64).max, np.uint64)
    # Sets go through in runs of bounded length; a longer set in several parts.
    parts = [(i, s[at : at + _AT_ONCE]) for i, s in enumerate(sets) for at in range(0, len(s), _AT_ONCE)]
    first = 0
    while first < len(parts):
        last, size = first, 0
        while last < len(parts) and (last == first or size + len(parts[last][1]) <= _AT_ONCE):
            size += len(parts[last][1])
            last += 1
        rows = np.array([i for i, _ in parts[first:last]])
        values = _mix(np.concatenate([p for _, p in parts[first:last]]))
        starts = np.concatenate([[0], np.cumsum([len(p) for _, p in parts[first : last - 1]])]).astype(np.int64)
        least = np.empty((SAMPLES, len(rows)), np.uint64)
        for k in range(SAMPLES):
            least[k] = np.minimum.reduceat((values ^ offsets[k]) * factors[k], starts)
        np.minimum.at(out, rows, least.T)
        first = last
    return out


def sketches(minima: np.ndarray) -> np.ndarray:
    """Odd sketches as rows of four words."""
    place = np.arange(SAMPLES, dtype=np.uint64)
    bit = (_mix(minima + place * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.zeros((len(minima), SKETCH_BITS), np.uint8)
    rows = np.repeat(np.arange(len(minima)), SAMPLES)
    np.add.at(odd, (rows, bit.ravel()), 1)
    return np.packbits(odd & 1, axis=1, bitorder="little").view(np.uint64)


def bands(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, its number included."""
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(minima), axis=0)
    for r in range(BAND_ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ minima[:, r : BANDS * BAND_ROWS : BAND_ROWS])
    return key


def _most_bits(percent: int) -> int:
    """Bits in which the sketches of two sets of that similarity differ, five deviations included."""
    apart = 1 - percent / 100
    differing = SAMPLES * apart + 5 * np.sqrt(SAMPLES * apart * (1 - apart))
    odd = 0.5 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing))
    return int(np.ceil(SKETCH_BITS * odd + 3 * np.sqrt(SKETCH_BITS * odd * (1 - odd))))


def document_sets(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The set of each row with its key, sketch and bands; empty sets have null instead."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch may hold long texts: its rows leave in parts of bounded size.
            data, offsets = utf8_buffers(batch.column(1))
            at = 0
            while at < batch.num_rows:
                sets: list[np.ndarray] = []
                size, end = 0, at
                while end < batch.num_rows and (end == at or size < 1 << 18):
                    sets.append(np.unique(shingle_hashes(data[offsets[end] : offsets[end + 1]].tobytes(), width)))
                    size += len(sets[-1])
                    end += 1
                yield _set_rows(batch.column(0).slice(at, end - at), sets)
                at = end

    return source.mapInArrow(task, _SETS)


def _set_rows(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    minima = samples([sets[i] for i in full]) if len(full) else np.zeros((0, SAMPLES), np.uint64)
    place = np.full(len(sets), -1, np.int64)
    place[full] = np.arange(len(full))
    take = pa.array(place, mask=place < 0)
    signed = lambda a: pa.array(np.ascontiguousarray(a).view(np.int64))
    keys = np.array([(_mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s ^ np.uint64(len(s))))) for s in (sets[i] for i in full)], np.uint64)
    keys = keys.reshape(-1, 2)
    words, band = sketches(minima), bands(minima)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS), pa.int32()), signed(band.ravel()))
    columns = [
        ids, *[signed(keys[:, i]).take(take) for i in range(2)], pa.array([len(s) for s in sets], pa.int64()),
        *[signed(words[:, i]).take(take) for i in range(4)], lists.take(take),
        pa.array([s.astype("<u8").tobytes() if len(s) else None for s in sets], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "key2", "n", "s0", "s1", "s2", "s3", "bands", "shingles"])


def _apart(words: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ one).sum(axis=1, dtype=np.int64)


def _forest(ids: np.ndarray, words: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sketches at most ``most`` bits apart, each set visited once."""
    left = np.arange(len(ids))
    links = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _apart(words[left], words[x]) <= most
            links += [(int(ids[x]), int(y)) for y in ids[left[near]]]
            queue += left[near].tolist()
            left = left[~near]
    return links


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key (the first ``keys`` columns), from rows sorted by key."""
    carry: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and carry:
                yield pa.Table.from_batches(carry)
                carry = []
            carry.append(batch.slice(a, b - a))
            last = key
    if carry:
        yield pa.Table.from_batches(carry)


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def candidate_links(nodes: DataFrame, percent: int, hot: int = HOT) -> DataFrame:
    """(a, b): sets that share a band and have near sketches, enough links to connect all of them.

    ``nodes``: uid, s0..s3, bands. A band value of more than ``hot`` sets is one group
    without a look at the sketches, as links to its smallest set.
    """
    most = _most_bits(percent)
    rows = nodes.select(F.explode("bands").alias("band"), "uid", "s0", "s1", "s2", "s3")
    sizes = rows.groupBy("band").agg(F.count("*").alias("size"), F.min("uid").alias("least")).filter(F.col("size") > hot)
    crowded = written(sizes, "sketch-crowded-bands")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for run in _runs(batches, 1):
            if run.num_rows < 2:
                continue
            ids = run.column("uid").to_numpy()
            words = np.column_stack([run.column(f"s{i}").to_numpy() for i in range(4)]).view(np.uint64)
            links += _forest(ids, words, most)
            if len(links) > 1 << 16:
                yield _link_batch(links)
                links = []
        if links:
            yield _link_batch(links)

    if crowded.isEmpty():
        return rows.repartition("band").sortWithinPartitions("band").mapInArrow(task, "a long, b long")
    # At most (bands * sets / hot) values are crowded, and they are few columns wide.
    marked = rows.join(crowded, "band", "left")
    calm = marked.filter("least is null").drop("size", "least").repartition("band").sortWithinPartitions("band")
    stars = marked.filter("least is not null and least <> uid").selectExpr("least as a", "uid as b")
    return calm.mapInArrow(task, "a long, b long").union(stars)


def contracted(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes, each node of a partition linked to the smallest one it reaches there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        a, b = (np.concatenate(c) for c in zip(*held))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = place[: len(a)], place[len(a) :]
        root = np.arange(len(nodes))
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        yield _link_batch(list(zip(nodes[root[linked]].tolist(), nodes[linked].tolist())))

    return links.mapInArrow(task, "a long, b long")


class _Unit:
    """The sets of one unit of comparison."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("uid").to_numpy()
        self.label = table.column("label").to_numpy()
        self.asks = table.column("asks").to_numpy(zero_copy_only=False)
        self.n = table.column("n").to_numpy()
        self.words = np.column_stack([table.column(f"s{i}").to_numpy() for i in range(4)]).view(np.uint64)
        self.sets = [np.frombuffer(b.as_buffer(), "<u8") for b in table.column("shingles")]

    def linked(self, x: int, others: np.ndarray, percent: int, most: int) -> np.ndarray:
        """Those of ``others`` whose full sets are similar enough to that of ``x``."""
        n, size = self.n[x], self.n[others]
        others = others[(100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & (_apart(self.words[others], self.words[x]) <= most)]
        good = []
        step = max(1, (1 << 19) // max(1, int(n)))  # shingles looked up at once
        own = self.sets[x]
        for at in range(0, len(others), step):
            part = others[at : at + step]
            sizes = self.n[part]
            every = np.concatenate([self.sets[y] for y in part])
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
            common = np.add.reduceat((own[place] == every).astype(np.int64), starts)
            good.append(part[100 * common >= percent * (n + sizes - common)])
        return np.concatenate(good) if good else others[:0]

    def links(self, percent: int, most: int) -> list[tuple[int, int]]:
        """Links that connect all similar sets of which one asks, given what the labels connect already."""
        _, group = np.unique(self.label, return_inverse=True)
        members = np.argsort(group, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(group))])
        open_ = np.ones(len(self.ids), bool)  # sets not yet reached
        found = []
        for start in np.flatnonzero(self.asks).tolist():
            if not open_[start]:
                continue
            queue = members[bounds[group[start]] : bounds[group[start] + 1]].tolist()
            open_[queue] = False
            while queue:
                x = queue.pop()
                # A set that does not ask is compared with asking sets alone.
                others = np.flatnonzero(open_) if self.asks[x] else np.flatnonzero(open_ & self.asks)
                for y in self.linked(x, others, percent, most).tolist():
                    found.append((int(self.ids[x]), int(self.ids[y])))
                    if open_[y]:
                        whole = members[bounds[group[y]] : bounds[group[y] + 1]]
                        open_[whole] = False
                        queue += whole.tolist()
        return found


def _verified(units: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): confirmed links within each unit, enough of them to connect all similar sets."""
    most = _most_bits(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, len(keys)):
            if run.num_rows > 1:
                links = _Unit(run.combine_chunks()).links(percent, most)
                if links:
                    yield _link_batch(links)

    rows = units.select(*keys, "uid", "label", "asks", "n", "s0", "s1", "s2", "s3", "shingles")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "uid").mapInArrow(task, "a long, b long")


def similar_sets(sets: DataFrame, nodes: DataFrame, percent: int, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """(node, component) of the distinct sets ``nodes`` that are linked with another.

    ``sets`` holds the rows ``uid, n, s0..s3, shingles`` the nodes are taken from.
    """
    groups = components(contracted(written(candidate_links(nodes, percent, hot), "sketch-candidates")))
    groups = written(groups.select(F.col("node").alias("uid"), F.col("component").alias("grp")), "sketch-members")
    # Two numbers a row: counted, and broadcast up to the bound, so that the sets stay where they are.
    members = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    held = written(sets.select("uid", "n", "s0", "s1", "s2", "s3", "shingles").join(members, "uid"), "sketch-groups")
    sizes = held.groupBy("grp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles_held"))
    blocks = F.ceil(F.greatest(F.col("rows") / block_rows, F.col("shingles_held") * 8 / block_bytes)).cast("int")
    large = written(sizes.withColumn("blocks", blocks).filter("blocks > 1").select("grp", "blocks"), "sketch-large-groups")
    own = F.pmod(F.xxhash64("uid"), "blocks").cast("int")
    # Few groups are large; a member of one knows its block, the others have one block.
    dealt = held.join(large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", own)
    first = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    units = dealt.withColumn("unit", F.explode(first)).withColumn("label", F.col("uid")).withColumn("asks", F.lit(True))
    links = written(_verified(units, ["grp", "unit"], percent), "sketch-links")
    if not large.isEmpty():
        more = _second_pass(held.join(large, "grp"), links, percent, block_rows, block_bytes, own)
        links = links.union(written(more, "sketch-more-links"))
    return components(contracted(links))


def _second_pass(held: DataFrame, links: DataFrame, percent: int, block_rows: int, block_bytes: int, own) -> DataFrame:
    """Links of the sets outside the largest class of their (large) group with all others of the group."""
    reached = components(contracted(links)).select(F.col("node").alias("uid"), F.col("component").alias("label"))
    named = held.join(reached, "uid", "left").withColumn("label", F.coalesce("label", "uid")).withColumn("block", own)
    named = written(named, "sketch-labelled")
    classes = named.groupBy("grp", "label").agg(F.count("*").alias("rows"))
    largest = classes.groupBy("grp").agg(F.max_by("label", F.struct("rows", -F.col("label"))).alias("largest"))
    marked = named.join(largest, "grp").withColumn("asks", F.col("label") != F.col("largest"))
    asking = marked.filter("asks").groupBy("grp").agg(
        F.ceil(F.greatest(F.count("*") / block_rows, F.sum("n") * 8 / block_bytes)).cast("int").alias("ask_blocks")
    )
    marked = marked.join(asking, "grp")
    ask_block = F.pmod(F.xxhash64("uid", F.lit(1)), "ask_blocks").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A unit holds an asking block as askers and another block as the sets they are compared with.
    askers = marked.filter("asks").withColumn("ask_block", ask_block).withColumn("unit", every("blocks"))
    others = marked.withColumn("unit", F.col("block")).withColumn("ask_block", every("ask_blocks"))
    others = others.filter(~F.col("asks") | (ask_block != F.col("ask_block"))).withColumn("asks", F.lit(False))
    return _verified(askers.unionByName(others), ["grp", "ask_block", "unit"], percent)


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
    hot: int = HOT,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable)."""
    made = document_sets(docs, width, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    sets = written(made, "sketch-sets")  # the numbers are fixed by writing them
    full = sets.filter("n > 0")
    keys = written(full.groupBy("key", "key2", "n").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least")), "sketch-keys")
    nodes = full.select("uid", "s0", "s1", "s2", "s3", "bands").join(keys.select("uid"), "uid")
    reached = similar_sets(full, nodes, percent, block_rows, block_bytes, hot).withColumnRenamed("node", "uid")
    classes = keys.join(reached, "uid", "left").withColumn("class", F.coalesce("component", "uid")).drop("component")
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = written(classes.join(least, "class").select("key", "key2", F.col("n").alias("size"), "component_id"), "sketch-classes")
    same = (F.col("d.key") == F.col("c.key")) & (F.col("d.key2") == F.col("c.key2")) & (F.col("d.n") == F.col("c.size"))
    rows = sets.select("doc_id", "n", "key", "key2").alias("d")
    return rows.join(named.alias("c"), same, "left").select(
        "d.doc_id", F.col("d.n").alias("n_shingles"), F.when(F.col("d.n") > 0, F.col("c.component_id")).otherwise(F.col("d.doc_id")).alias("component_id")
    )


def oracle(width: int = 4, percent: int = 80) -> str:
    """The query's rows in DuckDB, by comparing all documents that share a shingle."""
    return rf"""
with recursive docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i : i + {width} - 1], ' '))) end as s
  from docs),
named as (select r, doc_id, node from sets left join (select r as r2, min(r) over (partition by list_sort(s)) as node from sets where len(s) > 0) on r2 = r),
nodes as (select r as node, len(s) as n, unnest(s) as shingle from sets where r in (select node from named)),
links as (
  select a.node as a, b.node as b from nodes a join nodes b on a.shingle = b.shingle and a.node <> b.node
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach as (
  select distinct node, node as other from named where node is not null
  union
  select reach.node, links.b from reach join links on links.a = reach.other),
least as (select node, min(other) as class from reach group by node),
classes as (select class, min(doc_id) as component_id from named join least using (node) group by class)
select named.doc_id, len(s)::bigint as n_shingles, case when named.node is null then named.doc_id else component_id end as component_id,
  named.doc_id is not distinct from (case when named.node is null then named.doc_id else component_id end) as kept
from named join sets using (r) left join least using (node) left join classes using (class)
"""
