import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import ROWS, empty, odd

from stationlens.llm import language_id as li
from stationlens.llm.common import utf8_buffers
from stationlens.llm.registry import QUERIES


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    p = li.init(3, 4, 0)
    x = rng.integers(97, 105, (7, 5)).astype(np.int16)
    x[5:, 2] = li.PAD
    y = rng.integers(0, 3, 5)
    _, grads = li.loss_and_grads(p, x, y)
    for name in p:
        where = np.argwhere(np.abs(grads[name]) > 1e-3)
        for at in map(tuple, where[rng.permutation(len(where))[:6]]):
            old, eps = p[name][at], 1e-2
            p[name][at] = old + eps
            up, _ = li.loss_and_grads(p, x, y)
            p[name][at] = old - eps
            down, _ = li.loss_and_grads(p, x, y)
            p[name][at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-3)


def brute_cell(p, d, seq):
    h = np.zeros(p[f"u{d}"].shape[0])
    n = len(h)
    out = []
    for b in seq:
        a, v = p[f"x{d}"][b].astype(float), h @ p[f"u{d}"].astype(float)
        r, z = (1 / (1 + np.exp(-(a[k * n : k * n + n] + v[k * n : k * n + n]))) for k in (0, 1))
        h = (1 - z) * h + z * np.tanh(a[2 * n :] + r * v[2 * n :])
        out.append(h)
    return out


def test_pooling_against_one_cell_at_a_time():
    p = li.init(3, 4, 2)
    texts = ["hello wörld", "x" * 21, "", None, "ab"]
    data, offsets = utf8_buffers(pa.array(texts))
    got = li.pooled(p, data, offsets, 8)
    for row, text in enumerate(texts):
        raw = (text or "").encode()
        total = np.zeros(3)
        for at in range(0, len(raw), 8):
            seq = list(raw[at : at + 8])
            pad = seq + [li.PAD] * (8 - len(seq))
            f, b = brute_cell(p, "f", pad), brute_cell(p, "b", pad[::-1])[::-1]
            for t in range(len(seq)):
                e = np.exp(f[t] @ p["of"] + b[t] @ p["ob"] + p["bias"])
                total += e / e.sum()
        assert got[row] == pytest.approx(total / max(1, len(raw)), abs=1e-5)


def test_held_out_accuracy(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.97 and len(right) > 100
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    docs = odd(spark)
    got = li.identify(docs, li.learn(docs, hidden=4, epochs=1)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1 and (letters or r["score"] == 0)
    same = [r["score"] for r in got if r["doc_id"] == 1]
    assert same[0] == same[1]


def test_nothing_to_learn_from(spark):
    assert li.learn(empty(spark)) is None
    assert {r["lang_pred"] for r in li.identify(odd(spark), None).collect()} == {"und"}
    assert li.identify(empty(spark), None).collect() == []


def test_learns_from_behind_the_beginning_of_long_texts(spark):
    rng = np.random.default_rng(8)
    words = {"aa": ["kolibri", "pampelmuse", "dorf"], "bb": ["thwyx", "quezzal", "ybbsch"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, "0 1 2 3 " * 200 + text(lang, 600), lang) for i in range(60) for lang in words]
    model = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=60)
    asked = [(i, text(lang, 30), lang) for i in range(10) for lang in words]
    got = li.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
