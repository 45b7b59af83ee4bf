import random

import numpy as np
import pytest
import xxhash
from odd_tables import ROWS, empty, odd

from stationlens.llm.components import components
from stationlens.llm.registry import QUERIES
from stationlens.llm.simhash import _keyed, near_duplicates, similar_prints


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """prints: (doc_id, fingerprint) with ids; smallest id reachable of each row."""
    values = np.array([p for _, p in prints], np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3).tolist():
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return [least[find(i)] for i in range(len(prints))]


def test_odd_rows(spark):
    got = near_duplicates(odd(spark)).collect()
    assert len(got) == len(ROWS)
    with_id = [(r[0], brute_print(r[1])) for r in ROWS if r[0] is not None]
    want = sorted((d, f"{p:016x}", c) for (d, p), c in zip(with_id, brute_groups(with_id)))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_empty(spark):
    assert near_duplicates(empty(spark)).collect() == []


def test_whole_table(spark, sf_dir):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [(d["doc_id"], brute_print(d["text"])) for d in docs]
    assert got == {d: (f"{p:016x}", c) for (d, p), c in zip(prints, brute_groups(prints))}


@pytest.mark.parametrize("hot", [3, 8192])
def test_links_connect_all_near_prints(spark, hot):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(50)}
    for base in list(values)[:8]:
        for _ in range(60):
            base ^= sum(1 << rng.randrange(64) for _ in range(2))
            values.add(base)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = similar_prints(spark.createDataFrame([(v,) for v in signed], "fp long"), hot=hot).collect()
    index = {v: i for i, v in enumerate(signed)}
    assert all(bin((x ^ y) & (1 << 64) - 1).count("1") <= 3 for x, y in rows)
    got = components(spark.createDataFrame([(index[x], index[y]) for x, y in rows], "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in got}
    want = brute_groups(list(enumerate(values)))
    assert [got.get(i, i) for i in range(len(values))] == want


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


def test_keys_are_hamming_balls_of_the_segments(spark):
    got = {tuple(r)[:3] for r in _keyed(spark.createDataFrame([((7 << 32) + 5,)], "fp long"), 2, 1).collect()}
    want = {(s, v ^ m, m != 0) for s, v in ((0, 5), (1, 7)) for m in [0] + [1 << b for b in range(32)]}
    assert got == want
