import hashlib
import os
import random

import numpy as np
import pytest
from odd_tables import ROWS, empty, odd

from stationlens.llm.deep_shallow import deep_shallow, multikey_quicksort
from stationlens.llm.registry import QUERIES
from stationlens.llm.suffix_dedup import remove_repeats, removed_bytes


def brute(docs, length=50):
    """docs: (id, text); per document n_bytes, n_removed, n_spans, sha256 of the rest, rest."""
    far = float("inf")
    least = {}
    raws = [(far if i is None else i, (t or "").encode()) for i, t in docs]
    for i, raw in raws:
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            least[s] = min(least.get(s, far), i)
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


def compare(rows, docs, length=50):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    have = sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows], key=key)
    want = sorted([(d[0], *b[:4]) for d, b in zip(docs, brute(docs, length))], key=key)
    assert have == want


def test_deep_shallow_against_sorting():
    rng = random.Random(1)
    for _ in range(150):
        width = rng.choice([3, 8, 9, 20, 50])
        strings = set()
        for _ in range(rng.randint(0, 60)):
            text = bytearray(rng.choices([0, 97, 98], k=width) if rng.random() < 0.3 else [97] * rng.randint(0, width))
            if text and rng.random() < 0.6:
                text[rng.randrange(len(text))] = rng.choice([0, 1, 98, 255])
            strings.add((rng.randint(0, 2), bytes(text)))
        strings = sorted(strings, key=lambda _: rng.random())
        rows = np.zeros((len(strings), width), np.uint8)
        for i, (_, text) in enumerate(strings):
            rows[i, : len(text)] = list(text)
        lengths, groups = (np.array(c, np.int64) for c in zip(*[(len(t), g) for g, t in strings])) if strings else (np.zeros(0, np.int64),) * 2
        order, prefix = deep_shallow(rows, lengths, groups, rng.choice([8, 16]))
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        for i, (a, b) in enumerate(zip(got, got[1:])):
            assert prefix[i + 1] == (-1 if a[0] != b[0] else len(os.path.commonprefix([a[1], b[1]])))


def test_multikey_quicksort_keeps_the_order_of_equal_rows():
    rng = np.random.default_rng(2)
    for n, most, depth in [(0, 3, 2), (1, 3, 2), (5000, 3, 4), (5000, 10**6, 3), (3000, 1, 2)]:
        keys = rng.integers(0, most, (n, depth)).astype(np.uint64)
        assert (multikey_quicksort(keys) == np.lexsort(keys.T[::-1])).all()


def passages(seed, n=120):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abcdé ", k=rng.randint(20, 200))) for _ in range(12)] + ["x" * 120, "ab" * 80]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            piece = rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choices("abcdefghi ", k=rng.randint(0, 90)))
            if rng.random() < 0.3 and piece:
                cut = rng.randrange(len(piece))
                piece = piece[cut:] if rng.random() < 0.5 else piece[:cut]
            parts.append(piece)
        docs.append((rng.choice([i, i, i, rng.randrange(n), None]), "".join(parts)))
    return docs


@pytest.mark.parametrize("hot, length", [(500, 50), (0, 50), (1, 50), (500, 20)])
def test_random_passages(spark, monkeypatch, hot, length):
    import stationlens.llm.suffix_dedup as module

    monkeypatch.setattr(module, "BLOCK_BYTES", 3000)
    docs = passages(hot + length)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = remove_repeats(df, length, hot=hot, buckets=5).collect()
    compare(rows, docs, length)
    texts = {i: t for i, t in docs}
    for r in rows:
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert len(spans) == r["n_spans"] and sum(e - s for s, e in spans) == r["n_removed"]
    assert any(r["text"] != (texts[r["doc_id"]] or "") for r in rows)


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "1 as n_bytes", "2 as block")
    rows = remove_repeats(docs).collect()
    compare(rows, [(r[0], r[1]) for r in ROWS])
    assert {r["block"] for r in rows} == {2}


def test_empty(spark):
    assert remove_repeats(empty(spark)).collect() == []


def test_whole_table(spark, sf_dir):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare(QUERIES["op7_suffix_dedup"](spark, sf_dir).collect(), docs)


def test_marking_bytes_takes_little_memory():
    import tracemalloc
    from types import SimpleNamespace

    n = 1 << 20
    block = SimpleNamespace(data=np.zeros(n, np.uint8), ids=np.array([7]))
    at = np.array([100, 120, n - 50])
    around = SimpleNamespace(entry=np.arange(3), least=np.full(3, 7), owner=np.zeros(3, np.int64), at=at, before=np.zeros(3, np.int64), after=np.full(3, 50))
    tracemalloc.start()
    gone = removed_bytes(block, around, np.ones(3, np.uint64), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.flatnonzero(gone).tolist() == [*range(100, 170), *range(n - 50, n)]
    assert peak < 16 * n
