import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import ROWS, empty, odd

from stationlens.llm.common import utf8_buffers
from stationlens.llm.prefix_bpe import PrefixEncoder, decode, encode_documents, encode_together, prefix_cache
from stationlens.llm.registry import QUERIES, TOKENIZER_RANKS

RANKS = open(TOKENIZER_RANKS).read()
VOCABULARY, CACHE = prefix_cache(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={}
)
# One pre-token whatever the bytes are.
WHOLE = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=VOCABULARY.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abthein gos\n\té 1日'!=-\x00\x1c　A"), max_size=40), max_size=5))
def test_texts_against_the_library(texts):
    data, offsets = utf8_buffers(pa.array(texts, pa.string()))
    ids, counts = CACHE(data, offsets)
    parts = np.split(ids, np.cumsum(counts)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert decode(VOCABULARY, ids).tobytes() == "".join(texts).encode()


def test_random_words_together():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("aeinrstho", k=rng.randint(1, 30))) for _ in range(3000)})
    ids, counts = encode_together(VOCABULARY, [w.encode() for w in words])
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [WHOLE.encode_ordinary(w) for w in words]


def test_appends_and_edits():
    rng = random.Random(4)
    text = "".join(rng.choices("aeinrstho ", k=300))
    encoder = PrefixEncoder(VOCABULARY)
    for i in range(0, len(text), 7):
        encoder.append(text[i : i + 7].encode())
        assert encoder.ids() == WHOLE.encode_ordinary(text[: i + 7])
    assert encoder.computed == len(text)
    for _ in range(30):
        a = rng.randrange(len(text))
        b = min(len(text), a + rng.randrange(6))
        new = "".join(rng.choices("aeinrstho ", k=rng.randrange(6)))
        text = text[:a] + new + text[b:]
        encoder.replace(a, b, new.encode())
        assert bytes(encoder.data).decode() == text
        assert encoder.ids() == WHOLE.encode_ordinary(text)


def test_edit_costs_little():
    text = " ".join(["thing"] * 2000)
    encoder = PrefixEncoder(VOCABULARY, text.encode())
    before = encoder.computed
    encoder.replace(50, 51, b"xy")
    assert encoder.computed - before < 3 * VOCABULARY.longest


def test_odd_rows(spark):
    got = encode_documents(odd(spark), RANKS, public_tokenizers.PATTERN).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = []
    for r in ROWS:
        ids = LIBRARY.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    have = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_empty(spark):
    assert encode_documents(empty(spark), RANKS, public_tokenizers.PATTERN).collect() == []


def test_whole_table(spark, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_prefix_bpe"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array(LIBRARY.encode_ordinary(r["text"]), "<u4").tobytes()
        digest = hashlib.sha256(r["text"].encode()).hexdigest()
        assert got[r["doc_id"]] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest)
