"""Hard negatives by Kronecker-packed products.

Components become whole numbers, floor(scale * x). The scores of an anchor with a whole
block of candidates come from one multiplication per component: the candidates' k-th
components, raised by a bias so that none is negative, lie in separated fields of one wide
integer W_k, and sum_k (a_k + bias) * W_k holds in each field the product sum of one
candidate, with no carry between fields, as a field is wide enough for the largest sum.
Taking off the share of the bias leaves the exact scores.

Blocks are packed once, from rows of few labels each. A task owns one block of anchors and
one of ``streams`` parts of the packed blocks; the blocks stream through it and only the
best rows of each anchor stay, so the rows that leave it grow with the anchors alone. The
first pass looks at blocks that hold an anchor's label and finds its positives, the second
at blocks that hold other labels and finds the negatives between the two bounds.

Rows with a null id, label or vector, or a component that is null, not finite, or 2^56 and
more after scaling, take no part. An anchor meets only vectors of its own length. Scores
are compared as they are, of any size, and returned within the range of a long. Equal rows
(id, label and vector) each count: an anchor's copies are other rows than itself, and each
copy of an anchor has its own result. Ties go to the smaller id. An anchor without
positives, or a positive without negatives in its bounds, has no rows, and no vectors give
none. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationlens.session import written

_LIMIT = 1 << 56
_PACKED = "dim int, part long, ids array<long>, rows array<long>, labels array<string>, sums array<string>, fields array<binary>"
_BEST = "anchor long, goal int, row long, vec_id long, score string"


class Fields:
    """How numbers up to ``top`` in absolute value lie in a wide integer: ``size`` bytes for each candidate."""

    def __init__(self, top: int, dim: int):
        self.bias, self.dim = top, dim
        need = max(1, (dim * (2 * top) ** 2).bit_length())
        self.size = 4 if need <= 32 else 8 if need <= 63 else -(-need // 8)

    def pack(self, values: list[int]) -> bytes:
        """The fields of one component, lowest candidate first."""
        if self.size <= 8:
            return (np.array(values, np.int64) + self.bias).astype(f"<u{self.size}").tobytes()
        return b"".join((v + self.bias).to_bytes(self.size, "little") for v in values)

    def scores(self, anchor: list[int], wide: list[int], sums: np.ndarray) -> np.ndarray:
        """Exact inner products of ``anchor`` with all candidates of a block; ``sums`` are theirs over components."""
        total = sum(map(operator.mul, [a + self.bias for a in anchor], wide))
        raw = total.to_bytes(self.size * len(sums), "little")
        shift = self.bias * sum(anchor) + self.dim * self.bias**2
        if self.size <= 8:
            return np.frombuffer(raw, f"<u{self.size}").astype(np.int64) - self.bias * sums - shift
        found = [int.from_bytes(raw[i : i + self.size], "little") for i in range(0, len(raw), self.size)]
        return np.array([f - self.bias * int(s) - shift for f, s in zip(found, sums)] or [], object)


def _usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v, copies): each distinct row once, ``v`` as whole numbers."""
    named = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("x"),
    ).filter("vec_id is not null and label is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < float(_LIMIT)))
    whole = F.transform("x", lambda c: F.floor(c * scale)).alias("v")
    return named.filter(finite).select("vec_id", "label", whole).groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"))


def _packed(rows: DataFrame, top: int, block_rows: int) -> DataFrame:
    """Packed blocks of about ``block_rows`` rows of one length; a label with that many rows has blocks of its own."""
    sizes = rows.groupBy("dim", "label").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") < block_rows).groupBy("dim").agg(F.sum("n").alias("n"))
    own = sizes.filter(F.col("n") >= block_rows).select("dim", "label", F.ceil(F.col("n") / block_rows).alias("own_parts"))
    mixed = small.select("dim", F.ceil(F.col("n") / block_rows).alias("mixed_parts"))
    # Rows of small labels stay with their label; a label holds fewer rows than one block.
    part = (
        F.when(F.col("own_parts").isNotNull(), F.xxhash64("label", F.pmod(F.xxhash64("row"), "own_parts")))
        .otherwise(F.xxhash64(F.lit(""), F.pmod(F.xxhash64("label"), "mixed_parts")))
    )
    dealt = rows.join(F.broadcast(mixed), "dim", "left").join(own, ["dim", "label"], "left").withColumn("part", part)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
        vectors = table.column("v").to_pylist()
        dim = table.column("dim")[0].as_py()
        fields = Fields(top, dim)
        cells = [fields.pack(list(c)) for c in zip(*vectors)] if dim else []
        one = lambda v, t: pa.array([v], pa.list_(t))
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int64()),
                "ids": one(table.column("vec_id").to_pylist(), pa.int64()), "rows": one(table.column("row").to_pylist(), pa.int64()),
                "labels": one(table.column("label").to_pylist(), pa.string()),
                "sums": one([str(sum(v)) for v in vectors], pa.string()), "fields": one(cells, pa.binary()),
            }
        )

    return dealt.select("dim", "part", "vec_id", "row", "label", "v").groupBy("dim", "part").applyInArrow(pack, _PACKED)


class _Best:
    """The first ``k`` rows seen: higher scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.rows) == self.k:
            worth = scores >= -self.rows[-1][0]
            scores, ids, rows = scores[worth], ids[worth], rows[worth]
        if len(scores) > 4 * self.k and scores.dtype != object:
            worth = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, rows = scores[worth], ids[worth], rows[worth]
        if len(scores):
            more = zip((-scores).tolist(), ids.tolist(), rows.tolist())
            self.rows = sorted([*self.rows, *more])[: self.k]


def _scan(anchors: DataFrame, packed: DataFrame, top: int, k: int, same: bool, percent: tuple[int, int], streams: int) -> DataFrame:
    """The best ``k`` rows of each anchor and goal in each stream.

    ``anchors``: dim, block, anchor (row number), vec_id, label, v, goals. Without goals
    (``same``) rows of the anchor's label count; a goal is a positive score, for which rows
    of other labels between ``percent`` of it count.
    """
    blocks = F.broadcast(anchors.groupBy("dim").agg(F.max("block").alias("last")))  # one row for each vector length
    empty = lambda t: F.lit(None).cast(t)
    left = anchors.withColumn("stream", F.explode(F.sequence(F.lit(0), F.lit(streams - 1)))).select(
        "dim", "block", "stream", F.lit(0).alias("kind"), F.col("anchor").alias("part"), "vec_id", "label", "v", "goals",
        *[empty(t).alias(n) for n, t in (("ids", "array<long>"), ("rows", "array<long>"), ("labels", "array<string>"), ("sums", "array<string>"), ("fields", "array<binary>"))],
    )
    right = packed.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        "dim", "block", F.pmod("part", F.lit(streams)).cast("int").alias("stream"), F.lit(1).alias("kind"), "part",
        empty("long").alias("vec_id"), empty("string").alias("label"), empty("array<long>").alias("v"), empty("array<string>").alias("goals"),
        "ids", "rows", "labels", "sums", "fields",
    )
    low, high = percent

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, []

        def results() -> Iterator[pa.RecordBatch]:
            found = [(a, g, row, vec, str(-s)) for a, _, _, goals in asked for g, (_, b) in enumerate(goals) for s, vec, row in b.rows]
            if found:
                columns = list(zip(*found))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "goal", "row", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                line = {n: batch.column(n)[at] for n in batch.schema.names}
                here = (line["dim"].as_py(), line["block"].as_py(), line["stream"].as_py())
                if here != key:
                    yield from results()
                    key, asked = here, []
                if line["kind"].as_py() == 0:
                    goals = [None] if same else [int(g) for g in line["goals"].as_py()]
                    best = [(g, _Best(k)) for g in goals]
                    asked.append((line["part"].as_py(), line["label"].as_py(), line["v"].as_py(), best))
                    continue
                fields = Fields(top, here[0])
                wide = [int.from_bytes(f.as_py(), "little") for f in line["fields"]]
                ids, rows = (line[n].values.to_numpy() for n in ("ids", "rows"))
                labels = np.array(line["labels"].as_py(), object)
                names = set(labels.tolist())
                sums = np.array([int(s) for s in line["sums"].as_py()], np.int64 if fields.size <= 8 else object)
                picks = {n: np.flatnonzero((labels == n) if same else (labels != n)) for n in {a[1] for a in asked}}
                for anchor, label, v, goals in asked:
                    pick = picks[label]
                    if not len(pick) or not goals:
                        continue
                    scores = fields.scores(v, wide, sums)
                    if len(pick) < len(rows):
                        scores, near, own = scores[pick], ids[pick], rows[pick]
                    else:
                        near, own = ids, rows
                    for goal, best in goals:
                        if same:
                            other = own != anchor
                            best.add(scores[other], near[other], own[other])
                        elif goal >= 0:
                            # low * goal <= 100 * score <= high * goal, as bounds of whole scores
                            fits = (scores >= -(-low * goal // 100)) & (scores <= high * goal // 100)
                            if fits.any():
                                best.add(scores[fits], near[fits], own[fits])
                del names
        yield from results()

    both = left.unionByName(right).repartition("dim", "block", "stream")
    return both.sortWithinPartitions("dim", "block", "stream", "kind", "part").mapInArrow(task, _BEST)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "goal").orderBy(F.desc(F.col("score").cast("decimal(38,0)")), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(
    vectors: DataFrame,
    anchors: Column | None = None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    block_rows: int = 1024,
    block_anchors: int = 512,
    streams: int = 8,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``vec_id`` (by default divisible by 50). Each anchor has
    its first ``positives`` other rows of the same label, and each of those the first
    ``negatives`` rows of other labels whose score lies within ``percent`` of the positive's.
    """
    anchors = (F.col("vec_id") % 50 == 0) if anchors is None else anchors
    distinct = _usable(vectors, id_col, label_col, vector_col, scale)
    # More copies of a row than these can never be returned.
    most = max(positives + 1, negatives)
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(most)).cast("int")))
    rows = distinct.withColumn("copy", copies).select(
        F.xxhash64("vec_id", "label", "v", "copy").alias("row"), "vec_id", "label", "v", F.size("v").alias("dim"), "copy", "copies"
    )
    rows = written(rows, "negatives-rows")
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    top = int(largest or 0)
    packed = written(_packed(rows, top, block_rows), "negatives-packed")
    chosen = rows.filter(anchors & (F.col("copy") == 1))
    blocks = F.broadcast(chosen.groupBy("dim").agg(F.ceil(F.count("*") / block_anchors).alias("blocks")))
    chosen = chosen.join(blocks, "dim").select(
        "dim", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), F.col("row").alias("anchor"), "vec_id", "label", "v", "copies"
    )
    chosen = written(chosen, "negatives-anchors")
    no_goals = F.lit(None).cast("array<string>").alias("goals")
    asked = chosen.select("dim", "block", "anchor", "vec_id", "label", "v", no_goals)
    close = written(_first(_scan(asked, packed, top, positives, True, percent, streams), positives), "negatives-positives")
    close = close.select("anchor", F.col("place").alias("order"), F.col("vec_id").alias("positive_id"), F.col("score").alias("goal"))
    goals = close.groupBy("anchor").agg(F.array_sort(F.collect_set("goal")).alias("goals"))  # `positives` at most
    seeking = chosen.join(goals, "anchor").select("dim", "block", "anchor", "vec_id", "label", "v", "goals")
    far = _first(_scan(seeking, packed, top, negatives, False, percent, streams), negatives)
    scored = far.join(goals, "anchor").select(
        "anchor", F.col("goals")[F.col("goal")].alias("goal"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "score"
    )
    # A score beyond a long is returned as the nearest long.
    within = lambda c: F.greatest(F.least(F.col(c).cast("decimal(38,0)"), F.lit(2**63 - 1)), F.lit(-(2**63))).cast("long")
    ids = chosen.select("anchor", F.col("vec_id").alias("anchor_id"), "copies")
    return (
        close.join(scored, ["anchor", "goal"]).join(ids, "anchor")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("anchor_id", "positive_id", "rank", "negative_id", within("goal").alias("positive_score"), within("score").alias("negative_score"))
    )


def oracle() -> str:
    """The query's rows in DuckDB."""
    return """
with whole as (
  select row_number() over () as r, vec_id,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
flat as (select r, generate_subscripts(v, 1) as k, unnest(v) as c from whole),
scores as (
  select a.r as a, b.r as b, sum(x.c * y.c)::bigint as score
  from whole a join flat x on x.r = a.r join flat y on y.k = x.k and y.r <> x.r join whole b on b.r = y.r
  where a.vec_id % 50 = 0 and len(a.v) = len(b.v) group by a.r, b.r),
named as (
  select a, b, score, p.vec_id as anchor_id, c.vec_id as other_id, p.label = c.label as same
  from scores join whole p on p.r = a join whole c on c.r = b),
positives as (
  select a, anchor_id, b as positive, other_id as positive_id, score as positive_score
  from named where same qualify row_number() over (partition by a order by score desc, other_id, b) <= 5),
negatives as (
  select p.anchor_id, positive_id, positive_score, n.other_id as negative_id, n.score as negative_score,
    row_number() over (partition by p.a, positive order by n.score desc, n.other_id, n.b) as rank
  from positives p join named n on n.a = p.a and not n.same
    and 50 * positive_score <= 100 * n.score and 100 * n.score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= 3
"""
