import collections
import zlib

import numpy as np
import pytest
from odd_tables import ROWS, empty, odd

from stationlens.llm.registry import QUERIES, _tokenizer
from stationlens.llm.packing import TIERS, pack


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(_tokenizer())
    t.encode_special_tokens = True
    return t


def check(rows, want):
    """want: a list of (doc_id, ids), one for each document."""
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        size = sum(r["length"] for r in pieces)
        assert size <= 1024 and size & (size - 1) == 0
        assert {r["sequence_tokens"] for r in pieces} == {size}
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    expected = collections.defaultdict(list)
    for doc, ids in want:
        expected[doc].append(ids)
    assert set(got) == set(expected)
    for doc, lists in expected.items():
        assert sum(p[1] for p in got[doc]) == sum(map(len, lists))
        assert {p[3] for p in got[doc]} == {len(ids) for ids in lists}
        if len(lists) == 1:
            at = 0
            for start, length, crc, _ in sorted(got[doc]):
                assert start == at
                assert crc == zlib.crc32(np.array(lists[0][at : at + length], "<u4").tobytes())
                at += length
            assert at == len(lists[0])


def test_odd_rows(spark, tokenizer):
    rows = pack(odd(spark).coalesce(1), _tokenizer(), pool_tokens=2000).collect()
    check(rows, [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in ROWS])
    assert b"".join(r["ids"] for r in rows if r["doc_id"] == 3) == bytes(4)


def test_empty(spark):
    assert pack(empty(spark), _tokenizer()).collect() == []


def test_whole_table_with_few_short_windows(spark, sf_dir, tokenizer):
    rows = QUERIES["op10_packing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check(rows, [(d["doc_id"], tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0]) for d in docs])
    sizes = collections.Counter({r["sequence_id"]: r["sequence_tokens"] for r in rows}.values())
    assert sum(n for size, n in sizes.items() if size not in TIERS) <= 10
    steps = collections.Counter()
    for sequence, size, step in {(r["sequence_id"], r["sequence_tokens"], r["step_group"]) for r in rows}:
        steps[step] += size
    assert max(steps.values()) <= 1 << 16


def test_tiers_are_powers_of_two(spark):
    with pytest.raises(ValueError):
        pack(empty(spark), _tokenizer(), tiers=(100,))
