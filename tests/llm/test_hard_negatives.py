import math

import numpy as np
import pytest
from compare import differences

from stationlens.llm.hard_negatives import Fields, mine
from stationlens.llm.registry import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label long, rank int, row string"


def brute(rows, every=50, positives=5, negatives=3):
    """rows: (id, vector, label); the rows of the operator, compared by plain Python integers."""
    good = [
        (i, [math.floor(256 * c) for c in v], n)
        for i, v, n in rows
        if None not in (i, v, n) and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for a, (anchor, v, label) in enumerate(good):
        if anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, n) for b, (i, w, n) in enumerate(good) if b != a and len(w) == len(v)]
        close = sorted((-s, i) for s, i, n in scored if n == label)[:positives]
        for minus, positive in close:
            p = -minus
            far = sorted((-s, i) for s, i, n in scored if n != label and 50 * p <= 100 * s <= 95 * p)[:negatives]
            out += [(anchor, positive, rank, i, p, -m) for rank, (m, i) in enumerate(far, 1)]
    return sorted(out)


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, v, n, 7, "x") for i, v, n in rows], SCHEMA)
    return sorted(tuple(r) for r in mine(table, **how).collect())


@pytest.mark.parametrize("size", [(1024, 512, 8), (7, 2, 3)])
def test_equals_brute_force(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0.3, 0.4, 6)).round(2).tolist(), int(rng.integers(0, 3))) for i in range(0, 600, 3)]
    rows += [(i, (rng.normal(0.3, 0.4, 4)).tolist(), 1) for i in range(1000, 1200, 10)]  # another length
    block_rows, block_anchors, streams = size
    got = found(spark, rows, block_rows=block_rows, block_anchors=block_anchors, streams=streams)
    assert got == brute(rows) and len(got) > 30


def test_odd_rows(spark):
    one, half = [1.0, 0.0], [0.75, 0.1]
    rows = [
        (50, one, 1), (50, one, 1), (1, one, 1), (1, one, 1), (None, one, 1), (2, None, 1), (3, one, None),
        (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, half, 2), (7, half, 2),
        (8, half, 2), (-50, one, 2), (100, [], 1), (150, [0.0, 0.0], 1), (9, [-1.0, 0.0], 1), (10, [-0.7, 0.0], 2),
    ]
    got = found(spark, rows)
    assert got == brute(rows)
    assert sum(r[0] == 50 for r in got) > 10  # both copies of the anchor, ties of copies


def test_large_numbers_are_exact(spark):
    rows = [(0, [2.0**34, 3.0], 1), (1, [2.0**10, 5.0], 1), (2, [2.0**9, 7.0], 2), (3, [1e300, 1.0], 2), (4, [2.0**9 + 2.0**-8, 7.0], 2)]
    want = [r for r in brute([r for r in rows if r[0] != 3]) if r[0] == 0]
    assert found(spark, rows) == want and len(want) == 2
    top = 2**63 - 1
    rows[0] = (0, [2.0**44, 3.0], 1)
    assert found(spark, rows) == [(0, 1, 1, 4, top, top), (0, 1, 2, 2, top, top)]


def test_empty_and_alone(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []


def test_fields_never_carry():
    for top, dim in [(1, 1), (255, 64), (2**15, 3), (2**40, 2)]:
        fields = Fields(top, dim)
        rng = np.random.default_rng(top % 97)
        rows = [[top] * dim, [-top] * dim, *rng.integers(-top, top, (5, dim)).tolist()]
        wide = [int.from_bytes(fields.pack(list(c)), "little") for c in zip(*rows)]
        sums = np.array([sum(r) for r in rows], object if fields.size > 8 else np.int64)
        for anchor in rows:
            assert fields.scores(anchor, wide, sums).tolist() == [sum(a * c for a, c in zip(anchor, r)) for r in rows]


def test_query(spark, duck):
    n, problems = differences(QUERIES["op11_hard_negatives"](spark, "/root/testdata/sf0.01"), duck, ORACLES["op11_hard_negatives"])
    assert not problems and n > 100
