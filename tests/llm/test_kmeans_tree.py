import math

import numpy as np
import pytest

from stationlens.llm.kmeans_tree import Tree, search
from stationlens.llm.registry import QUERIES


def brute(rows, k=20):
    """rows: distinct (id, vector); the true neighbours as {query: [(id, score)]}."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 20 == 0 and i not in out:
            s = (x * np.array(v, float)).sum(1)
            order = [j for j in np.lexsort([ids, -s]) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def results(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert set(got) == {q for q, n in want.items() if n}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("leaf_rows", [16, 256])
def test_recall_on_the_table(spark, sf_dir, leaf_rows):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    report = {}
    got = results(search(table, leaf_rows=leaf_rows, block_rows=100, block_queries=60, streams=3, report=report).collect())
    want = brute(rows)
    assert recall(got, want) >= 0.9 and report["recall_held_out"] >= 0.9
    assert report["recall_calibrated"] >= 0.97 and 1 <= report["visits"] <= report["leaves"]
    vectors = dict(rows)
    for q, found in got.items():
        assert len(found) == 20 and q not in dict(found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        for i, s in found:
            assert s == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[i], float))), rel=1e-12)


def test_query(spark, sf_dir):
    got = results(QUERIES["op6_kmeans_tree"](spark, sf_dir).collect())
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert recall(got, brute(rows)) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(4).tolist()) for i in range(1, 300)]
    good += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300, 700)]  # one very common vector
    good += [(40, good[39][1])]  # a repeated row
    bad = [(None, [1.0] * 4), (1000, None), (1020, [0.0] * 4), (1040, [1.0, None, 1.0, 1.0]), (1060, [float("nan")] * 4),
           (1080, [float("inf"), 1.0, 1.0, 1.0]), (1100, [1.0] * 5), (1120, [])]
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in good + bad], "vec_id long, embedding array<double>, leaf string, score double")
    got = results(search(df, leaf_rows=20, block_rows=50, recall=1.0).collect())
    want = brute(list({(i, tuple(v)) for i, v in good}))
    assert recall(got, want) > 0.99
    full = results(search(df, leaf_rows=10_000, block_rows=50).collect())
    assert {q: [i for i, _ in f] for q, f in full.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert search(spark.createDataFrame([], schema)).collect() == []
    rows = results(search(spark.createDataFrame([(20, [1.0]), (3, [2.0]), (40, [-1.0])], schema)).collect())
    assert rows == {20: [(3, 2.0), (40, -1.0)], 40: [(20, -1.0), (3, -2.0)]}
    assert search(spark.createDataFrame([(20, [1.0])], schema)).collect() == []


def test_visits_reach_every_leaf_once():
    rng = np.random.default_rng(2)
    tree = Tree(rng.standard_normal((500, 5)), 10, 4)
    order = tree.visit(rng.standard_normal(5), tree.leaves + 5)
    assert len(order) == len(set(order)) == tree.leaves
    assert math.isclose(len({int(x) for x in tree.route(rng.standard_normal((4000, 5)))}), tree.leaves, rel_tol=0.1)


def test_clustered_rows_need_few_leaves(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 8)) * 10
    x = centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 8)) * 0.05
    report = {}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = results(search(df, leaf_rows=64, report=report).collect())
    assert recall(got, brute([(i, v.tolist()) for i, v in enumerate(x)])) >= 0.9
    assert report["visits"] < report["leaves"] / 5 and report["recall_held_out"] >= 0.9


def test_walk_goes_on_until_enough_rows_are_seen():
    rng = np.random.default_rng(4)
    tree = Tree(rng.standard_normal((500, 5)), 10, 4)
    held = np.full(len(tree.matrix), 3)
    query = rng.standard_normal(5)
    assert len(tree.visit(query, 2, held, 21)) == 7 and len(tree.visit(query, 9, held, 21)) == 9
    again = Tree.of(*tree.arrays())
    assert again.visit(query, 30) == tree.visit(query, 30) and again.leaves == tree.leaves
