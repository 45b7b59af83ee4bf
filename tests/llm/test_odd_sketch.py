import random

import numpy as np
import pytest
from compare import differences
from odd_tables import ROWS, empty, odd

from stationlens.llm import odd_sketch as sk
from stationlens.llm.registry import ORACLES, QUERIES


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def set_of(text, width=4):
    w = words_of(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, percent=80):
    """rows: (doc_id, text); (doc_id, size, smallest id reachable) by comparing all pairs."""
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows, **how):
    table = spark.createDataFrame([(*r, "n", 5) for r in rows], "doc_id long, text string, uid string, n long")
    return sorted((tuple(r) for r in sk.near_duplicates(table, **how).collect()), key=str)


def family(rng, base, edits, first):
    """Copies of a text with some words exchanged: similarities around the threshold."""
    rows = []
    for i, n in enumerate(edits):
        w = list(base)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"block_rows": 9}, {"block_bytes": 4000}, {"hot": 3, "block_rows": 16}])
def test_families_equal_brute_force(spark, bounds):
    rng = random.Random(4)
    rows = []
    for f in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 150]))]
        rows += family(rng, base, [rng.choice([0, 1, 1, 2, 3, 4, 5, 8]) for _ in range(40)], 1000 * f)
    rows += [(5000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for i in range(20)]
    rng.shuffle(rows)
    want = brute(rows)
    assert found(spark, rows, **bounds) == want
    assert 20 < len({c for _, _, c in want}) < 150


def test_odd_rows(spark):
    got = sorted((tuple(r) for r in sk.near_duplicates(odd(spark)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in ROWS])


def test_empty(spark):
    assert sk.near_duplicates(empty(spark)).collect() == []


def test_sketch_tells_similarity():
    rng = np.random.default_rng(1)
    for similar in (0.8, 0.9, 0.97):
        apart = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            new = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            k = int(1000 * (1 - similar) / (1 + similar))
            a, b = both.copy(), both.copy()
            a[:k], b[:k] = new[:k], new[1000 : 1000 + k]
            words = sk.sketches(sk.samples([np.sort(a), np.sort(b)]))
            apart.append(int(sk._apart(words[:1], words[1])[0]))
        odd = 0.5 * (1 - np.exp(-4 * sk.SAMPLES * (1 - similar) / sk.SKETCH_BITS)) * sk.SKETCH_BITS
        assert abs(np.mean(apart) - odd) < 6 and max(apart) <= sk._most_bits(80)


def test_samples_of_long_sets_in_parts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (5, 3 * sk._AT_ONCE + 7, 1, sk._AT_ONCE)]
    factors, offsets = sk._factors()
    want = [[((sk._mix(s) ^ offsets[k]) * factors[k]).min() for k in range(0, sk.SAMPLES, 37)] for s in sets]
    assert (sk.samples(sets)[:, ::37] == np.array(want)).all()


def test_query(spark, duck):
    n, problems = differences(QUERIES["op12_odd_sketch"](spark, "/root/testdata/sf0.01"), duck, ORACLES["op12_odd_sketch"])
    assert not problems and n == 1000


def test_contracted_links_connect_the_same_nodes(spark):
    from stationlens.llm.components import components

    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(3)
    fewer = sk.contracted(links)
    assert fewer.count() <= links.count()
    got, want = ({r["node"]: r["component"] for r in components(d).collect()} for d in (fewer, links))
    assert got == want
