"""Nearest neighbours by largest inner product with a hierarchical k-means tree.

Vectors get one more component, so that the largest inner product becomes the least
distance; a tree of k-means splits is made of a bounded sample (``sample_rows``), and
every row is led down to a leaf. A query goes through the tree best bin first: a priority
queue holds all branches seen but not taken, nearest centre first. It goes on until it
has visited the calibrated number of leaves and these hold more than ``k`` rows.

How many leaves that are is calibrated: for ``calibration`` queries the true neighbours
are found among all rows, and the visits are set to the least number with which those of
one half reach ``recall``. The other half tells the recall reached on queries that were
not used for it (``report``).

Rows are packed into blocks of one leaf. Queries are dealt into blocks; a task owns one
block of queries and one of ``streams`` parts of the leaves. The leaves its queries visit
stream through it, each is compared at once with all queries that visit it, and only the
best ``k`` rows of each query stay. So what leaves the tasks grows with the queries, not
with the visits, and a leaf or a set of queries of any size is spread. Equal vectors are
one entry with their ``k + 1`` smallest ids, all that any query can need of them.

Vectors that are null, zero, hold null or non-finite components, or have another length
than most, take no part, nor do rows without id. A query's own row is every row with its
id. Where one id has several vectors, all are candidates and the least is the query.
Fewer than ``k`` candidates give fewer rows; no rows give none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stationlens.session import written

HIT = "query_id long, vec_id long, score double"


class Tree:
    """Centres and children of all nodes; nodes without children are leaves."""

    @classmethod
    def of(cls, matrix: np.ndarray, first: np.ndarray, count: np.ndarray) -> Tree:
        """The tree of the arrays of :meth:`arrays`."""
        tree = cls.__new__(cls)
        tree.matrix = matrix
        tree.children = [np.arange(f, f + n) if n else None for f, n in zip(first.tolist(), count.tolist())]
        return tree

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, and the first child and number of children of each node."""
        first = np.array([0 if c is None else c[0] for c in self.children], np.int64)
        return self.matrix, first, np.array([0 if c is None else len(c) for c in self.children], np.int64)

    def __init__(self, sample: np.ndarray, leaf_rows: int, branch: int, seed: int = 3):
        self.centres: list[np.ndarray] = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[np.ndarray | None] = [None]
        rng = np.random.default_rng(seed)
        todo = [(0, sample)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            centres, group = k_means(rows, branch, rng)
            if len(centres) < 2:
                continue  # all rows are equal
            first = len(self.centres)
            self.children[node] = np.arange(first, first + len(centres))
            self.centres += list(centres)
            self.children += [None] * len(centres)
            todo += [(first + c, rows[group == c]) for c in range(len(centres))]
        self.matrix = np.array(self.centres)

    @property
    def leaves(self) -> int:
        return sum(c is None for c in self.children)

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest centre again and again."""
        at = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, members = todo.pop()
            below = self.children[node]
            if below is None or not len(members):
                at[members] = node
                continue
            nearest = _nearest(rows[members], self.matrix[below])
            todo += [(int(below[c]), members[nearest == c]) for c in range(len(below))]
        return at

    def visit(self, query: np.ndarray, most: int, held: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first leaves in best-bin-first order: ``most``, and more until they hold ``rows`` rows (``held`` by node)."""
        queue, leaves, covered = [(0.0, 0)], [], 0
        while queue and (len(leaves) < most or covered < rows):
            _, node = heapq.heappop(queue)
            while (below := self.children[node]) is not None:
                distance = ((self.matrix[below] - query) ** 2).sum(1)
                order = np.argsort(distance, kind="stable")
                for c in order[1:].tolist():
                    heapq.heappush(queue, (float(distance[c]), int(below[c])))
                node = int(below[order[0]])
            leaves.append(node)
            covered += int(held[node]) if held is not None else 0
        return leaves


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres that have rows, and the number of each row's centre."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        group = _nearest(rows, centres)
        used, group = np.unique(group, return_inverse=True)
        centres = np.array([rows[group == c].mean(0) for c in range(len(used))])
    return centres, group


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lifted(rows: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that makes all norms ``top``."""
    rest = np.sqrt(np.maximum(top * top - (rows * rows).sum(1), 0))
    return np.column_stack([rows, rest])


def _lifted_query(query: np.ndarray, top: float) -> np.ndarray:
    """A query in the direction of its vector, as long as the rows."""
    return np.append(query * (top / max(np.sqrt((query * query).sum()), 1e-300)), 0.0)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Nearest:
    """The best ``k`` rows so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.length = np.sqrt((queries * queries).sum(1))
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), NO_ROW)

    def add(self, asking: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Compare the queries at ``asking`` with ``rows``."""
        norm = np.sqrt((rows * rows).sum(1)).max(initial=0)
        for at in range(0, len(asking), 256):
            part = asking[at : at + 256]
            rough = self.queries[part] @ rows.T
            rough[self.ids[part][:, None] == ids[None, :]] = -np.inf
            least = self.scores[part, -1]
            if self.k < len(ids):
                least = np.maximum(least, np.partition(rough, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            slack = 1e-9 * (norm * self.length[part] + 1e-300)
            query, row = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
            if not len(query):
                continue
            # One order of addition for all pairs, so that equal vectors have equal scores.
            score = (rows[row] * self.queries[part[query]]).sum(1)
            touched, query = np.unique(query, return_inverse=True)
            held = part[touched]
            query = np.concatenate([query, np.repeat(np.arange(len(held)), self.k)])
            score = np.concatenate([score, self.scores[held].ravel()])
            found = np.concatenate([ids[row], self.found[held].ravel()])
            order = np.lexsort([found, -score, query])
            start = np.searchsorted(query[order], np.arange(len(held)))
            best_ = order[start[:, None] + np.arange(self.k)]
            self.scores[held], self.found[held] = score[best_], found[best_]

    def batch(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.found != NO_ROW)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[query]), pa.array(self.found[query, place]), pa.array(self.scores[query, place])],
            names=["query_id", "vec_id", "score"],
        )


#: Stands for no row; no vector has this id, as ids of that value are left out of the search.
NO_ROW = np.iinfo(np.int64).max


def search(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 20,
    recall: float = 0.97,
    sample_rows: int = 16384,
    leaf_rows: int = 512,
    branch: int = 8,
    calibration: int = 256,
    block_rows: int = 2048,
    block_queries: int = 512,
    streams: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: dict | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows of ``vectors`` nearest to each of ``queries``.

    ``queries`` has the same columns; by default every row whose id is divisible by 20.
    ``report`` receives the number of leaves and of visits, and the recall on the queries
    used for calibration and on those held out from it.
    """

    def usable(df: DataFrame) -> DataFrame:
        vector = F.col(f"`{vector_col}`").cast("array<double>")
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("v")).filter(f"vec_id < {NO_ROW} and v is not null")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.filter(finite & F.exists("v", lambda x: x != 0))

    rows = usable(vectors)
    queries = rows.filter("vec_id % 20 = 0") if queries is None else usable(queries)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dimension = size["n"] if size else 0
    same = W.partitionBy("v").orderBy("vec_id")
    distinct = rows.filter(F.size("v") == dimension).distinct().withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1)
    rows = written(distinct.drop("copy"), "ann-rows")
    queries = written(queries.filter(F.size("v") == dimension).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, top = rows.agg(F.count("*"), F.coalesce(F.max(F.sqrt(norm)), F.lit(0.0))).first()
    n_queries = queries.count()

    def thinned(df: DataFrame, count: int, wanted: int) -> list:
        """About ``wanted`` rows by hash of the id, twice that at most."""
        share = max(1, count // wanted)
        return df.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).limit(2 * wanted).collect()

    sample = np.array([r["v"] for r in thinned(rows, n, sample_rows)]).reshape(-1, max(1, dimension))
    sample = sample[np.lexsort(sample.T)]  # the order of arrival does not matter
    tree = Tree(_lifted(sample, top), max(8, leaf_rows * len(sample) // max(1, n)), branch)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(tree.arrays())  # plain arrays, at most as large as the sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree.of(*shared.value)
        for batch in batches:
            leaf = own.route(_lifted(_matrix(batch.column(1)), top)) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "v", "leaf"])

    indexed = written(rows.mapInArrow(index, "vec_id long, v array<double>, leaf long"), "ann-index")
    sizes = indexed.groupBy("leaf").agg(F.count("*").alias("n"))
    held = np.zeros(len(tree.matrix), np.int64)
    for r in sizes.collect():  # a row per leaf, which the tree bounds
        held[r["leaf"]] = r["n"]
    chosen = thinned(queries, n_queries, calibration)
    visits, reached, held_out = _calibrated(indexed, tree, held, top, k, recall, chosen)
    if report is not None:
        report |= {"leaves": tree.leaves, "visits": visits, "recall_calibrated": reached, "recall_held_out": held_out}
    counts = spark.sparkContext.broadcast(held)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree.of(*shared.value)
        for batch in batches:
            paths = [own.visit(_lifted_query(q, top), visits, counts.value, k + 1) for q in _matrix(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.int64()))], names=["query_block", "vec_id", "v", "leaves"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        values = _matrix(table.column("v").chunk(0)).tobytes()
        return pa.table(
            {
                "leaf": table.column("leaf").slice(0, 1), "part": table.column("part").slice(0, 1),
                "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())), "data": pa.array([values], pa.binary()),
            }
        )

    # One row per leaf, as many as the tree has.
    parts = F.broadcast(sizes.select("leaf", F.ceil(F.col("n") / block_rows).cast("int").alias("parts")))
    dealt = indexed.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).drop("parts")
    packed = written(dealt.groupBy("leaf", "part").applyInArrow(pack, "leaf long, part int, ids array<long>, data binary"), "ann-packed")

    blocks = max(1, -(-n_queries // block_queries))
    own_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("query_block")
    asked = queries.select(own_block, "vec_id", "v").repartition(blocks, "query_block")
    asked = written(asked.mapInArrow(walk, "query_block int, vec_id long, v array<double>, leaves array<long>"), "ann-visits")
    every = F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("stream")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("data", "binary"))]
    left = asked.select("query_block", every, F.lit(-1).cast("long").alias("leaf"), F.lit(0).alias("part"), "vec_id", "v", "leaves", *nothing)
    # The leaves a block of queries visits, each once: lists of a bounded number of queries.
    visited = asked.groupBy("query_block").agg(F.array_distinct(F.flatten(F.collect_list("leaves"))).alias("leaves"))
    wanted = visited.select("query_block", F.explode("leaves").alias("leaf"))
    no_query = [F.lit(None).cast(t).alias(c) for c, t in (("vec_id", "long"), ("v", "array<double>"), ("leaves", "array<long>"))]
    right = packed.join(wanted, "leaf").select(
        "query_block", F.pmod("leaf", F.lit(streams)).cast("int").alias("stream"), "leaf", "part", *no_query, "ids", "data"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, asks, paths, nearest, by_leaf = None, [], [], [], None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                line = {c: batch.column(c)[at] for c in batch.schema.names}
                here = (line["query_block"].as_py(), line["stream"].as_py())
                if here != key:
                    if nearest is not None:
                        yield nearest.batch()
                    key, ids, asks, paths, nearest = here, [], [], [], None
                if line["leaf"].as_py() < 0:
                    ids.append(line["vec_id"].as_py())
                    asks.append(line["v"].values.to_numpy())
                    paths.append(line["leaves"].values.to_numpy())
                    continue
                if nearest is None:
                    nearest = _Nearest(np.array(ids), np.array(asks), k)
                    leaf, order = np.concatenate(paths), np.repeat(np.arange(len(paths)), [len(p) for p in paths])
                    by = np.argsort(leaf, kind="stable")
                    edges = np.flatnonzero(np.diff(leaf[by], prepend=-2))
                    by_leaf = dict(zip(leaf[by][edges].tolist(), np.split(order[by], edges[1:])))
                found = line["ids"].values.to_numpy()
                nearest.add(by_leaf[line["leaf"].as_py()], found, np.frombuffer(line["data"].as_buffer()).reshape(len(found), -1))
        if nearest is not None:
            yield nearest.batch()

    both = left.unionByName(right).repartition(blocks * streams, "query_block", "stream")
    hits = both.sortWithinPartitions("query_block", "stream", "leaf", "part").mapInArrow(compare, HIT)
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")


def _calibrated(
    indexed: DataFrame, tree: Tree, held: np.ndarray, top: float, k: int, recall: float, chosen: list
) -> tuple[int, float, float]:
    """The least number of leaf visits with which one half of ``chosen`` has the share ``recall`` of its true
    neighbours, that share, and the share of the other half."""
    if not chosen or tree.leaves < 2:
        return 1, 1.0, 1.0
    chosen = sorted(chosen, key=lambda r: r["vec_id"])
    ids, vectors = np.array([r["vec_id"] for r in chosen]), np.array([r["v"] for r in chosen])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _Nearest(ids, vectors, k)
        leaf_of: dict[int, int] = {}
        for batch in batches:
            if len(batch):
                near.add(np.arange(len(ids)), batch.column(0).to_numpy(), _matrix(batch.column(1)))
                leaf_of |= dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
                kept = set(near.found.ravel().tolist())
                leaf_of = {i: leaf for i, leaf in leaf_of.items() if i in kept}
        found = near.batch()
        leaves = pa.array([leaf_of[i] for i in found.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*found.columns, leaves], names=["query_id", "vec_id", "score", "leaf"])

    truth = _ranked(indexed.mapInArrow(brute, f"{HIT}, leaf long"), k).select("query_id", "leaf").collect()
    place = {}
    for query, vector in zip(ids.tolist(), vectors):
        order = tree.visit(_lifted_query(vector, top), tree.leaves)
        covered = np.concatenate([[0], np.cumsum(held[order])])
        # The walk goes on until it has seen enough rows, whatever the number of visits.
        least = int(np.searchsorted(covered, k + 1))
        place[query] = {leaf: 1 if i < least else i + 1 for i, leaf in enumerate(order)}
    half = {q: i % 2 for i, q in enumerate(ids.tolist())}
    needed = [np.array([place[r["query_id"]][r["leaf"]] for r in truth if half[r["query_id"]] == h]) for h in (0, 1)]
    reached = lambda visits, h=0: float((needed[h] <= visits).mean()) if len(needed[h]) else 1.0
    visits = 1
    while reached(visits) < recall:
        visits *= 2
    low = visits // 2
    while visits - low > 1:
        middle = (low + visits) // 2
        low, visits = (low, middle) if reached(middle) >= recall else (middle, visits)
    visits = min(visits, tree.leaves)
    return visits, reached(visits), reached(visits, 1)
