import collections
import math
import re
import zlib

import numpy as np
import pytest
from odd_tables import ROWS, empty, odd
from pyspark.sql import functions as F

from stationlens.llm import kneser_ney
from stationlens.llm.kneser_ney import Scorer, learn, score, token_hashes
from stationlens.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


def formula(values):
    """Discounts for values 0, 1, 2, 3+ after Chen and Goodman, kept between 0 and the value."""
    n1, n2, n3, n4 = (sum(v == i for v in values) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0
    d2 = 2 - 3 * y * n3 / n2 if n2 else 0
    d3 = 3 - 4 * y * n4 / n3 if n3 else 0
    return [0, min(max(d1, 0), 1), min(max(d2, 0), 2), min(max(d3, 0), 3)]


class Brute:
    """The model with dictionaries of token tuples."""

    def __init__(self, texts, order=3):
        self.order = order
        grams = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            seq = ["<begin>"] * (order - 1) + tokens(t)
            for m in range(1, order + 1):
                grams[m].update(tuple(seq[i - m + 1 : i + 1]) for i in range(order - 1, len(seq)))
        self.c = {w: n for (w,), n in grams[1].items()}
        self.n, self.v = sum(self.c.values()), len(self.c)
        # Below the highest order the number of different tokens in front counts.
        self.value = [None] + [collections.Counter(g[1:] for g in grams[m + 1]) for m in range(1, order)] + [grams[order]]
        self.d = [None] + [formula(list(v.values())) for v in self.value[1:]]
        self.total, self.back = collections.Counter(), collections.Counter()
        for m in range(1, order + 1):
            for g, a in self.value[m].items():
                self.total[g[:-1]] += a
                self.back[g[:-1]] += self.d[m][min(a, 3)]

    def p(self, context, w):
        total = self.total[context]
        if not context:
            a = self.value[1][w,]
            rest = self.back[()] / total if total else 1
            return (max(a - self.d[1][min(a, 3)], 0) / total if total else 0) + rest / (self.v + 1)
        if not total:
            return self.p(context[1:], w)
        m = len(context) + 1
        a = self.value[m][(*context, w)]
        return max(a - self.d[m][min(a, 3)], 0) / total + self.back[context] / total * self.p(context[1:], w)

    def row(self, text):
        front = self.order - 1
        seq = ["<begin>"] * front + tokens(text)
        base = sum(math.log10((self.c.get(w, 0) + 1) / (self.n + self.v + 1)) for w in seq[front:])
        logs = sum(math.log10(self.p(tuple(seq[i - front : i]), seq[i])) for i in range(front, len(seq)))
        return len(seq) - front, sum(w in self.c for w in seq[front:]), self.n, base, logs


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_sum_to_one(order):
    model = Brute([r[1] for r in ROWS] + ["a b a b a b c a c"] * 4, order)
    for context in [["<begin>"] * 3, ["<begin>", "a", "b"], ["same"] * 3, ["c", "a", "c"], ["never", "seen", "a"]]:
        context = tuple(context[4 - order :])
        assert sum(model.p(context, w) for w in model.c) + model.p(context, "unknown") == pytest.approx(1)


def close(got, want):
    assert tuple(got[:3]) == want[:3]
    assert got[3] == pytest.approx(want[3], rel=1e-9) and got[4] == pytest.approx(want[4], rel=1e-9)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs}
    brute = Brute([d["text"] for d in docs if not held[d["doc_id"]]])
    got = {r["doc_id"]: r for r in QUERIES["op8_kneser_ney"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    base = logs = 0.0
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == held[d["doc_id"]]
        close([r[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")], brute.row(d["text"]))
        if r["held_out"]:
            base, logs = base + r["base_score"], logs + r["score"]
    assert logs > base


@pytest.mark.parametrize("order", [2, 3, 4])
def test_odd_rows(spark, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "GATHER", 50)
    docs = odd(spark).selectExpr("*", "7 as n_tokens")
    brute = Brute([r[1] for r in ROWS], order)
    got = score(docs, learn(docs, order, shards=3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    have = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], key=key)
    want = sorted([(r[0], *brute.row(r[1])) for r in ROWS], key=key)
    assert [h[0] for h in have] == [w[0] for w in want]
    for h, w in zip(have, want):
        close(h[1:], w[1:])


def test_frequent_sequences_keep_their_counts(spark):
    texts = ["a b c d"] * 700 + [f"x{i} b c e" for i in range(400)] + ["a b c f"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    brute = Brute(texts)
    model = learn(docs, shards=2)
    probes = ["a b c d", "x1 b c d", "b c e", "q b c f", "a q c d", ""]
    got = [r["score"] for r in score(spark.createDataFrame([(t,) for t in probes], "text string").coalesce(1), model).collect()]
    assert got == pytest.approx([brute.row(t)[4] for t in probes], rel=1e-9)
    assert max(brute.value[3].values()) > 255 and max(brute.value[2].values()) > 255


def test_a_longer_context_helps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    logs = [score(docs.filter(held), learn(docs.filter(~held), order)).agg(F.sum("score")).first()[0] for order in (2, 3)]
    assert logs[1] > logs[0]


def test_empty(spark):
    model = learn(empty(spark), shards=2)
    assert score(empty(spark), model).collect() == []
    assert {r["score"] for r in score(odd(spark), model).collect()} == {0.0}


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_hashes_are_polynomials_of_the_words():
    texts = ["", " a", "ab  Ab\tab ", "x" * 300 + " a", "\n", "b\u00e9 ab"]
    data, offsets = buffers(texts)
    values, mask = kneser_ney._byte_values().tolist(), (1 << 64) - 1

    def plain(word):
        h = sum(values[b] * pow(kneser_ney._PRIME, i, 1 << 64) for i, b in enumerate(word.encode())) & mask
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & mask
        return h ^ h >> 29

    hashes, counts = token_hashes(data, offsets)
    assert counts.tolist() == [len(tokens(t)) for t in texts]
    assert hashes.tolist() == [int(kneser_ney.END) if w is None else plain(w) for t in texts for w in tokens(t)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_a_level_sorts_its_tokens_by_shard_and_within(spark, order, monkeypatch):
    texts = [" ".join(f"w{i * j % 997}" for j in range(1, 200)) for i in range(1, 20)]
    brute = Brute(texts, order)
    scorer = Scorer(learn(spark.createDataFrame([(t,) for t in texts], "text string"), order, shards=3))
    sizes = []
    for name in ("argsort", "sort", "unique"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda a, *args, _plain=plain, **kw: (sizes.append(len(a)), _plain(a, *args, **kw))[1])
    counts, _, _, logs = scorer(*buffers(texts))
    monkeypatch.undo()
    assert logs.tolist() == pytest.approx([brute.row(t)[4] for t in texts], rel=1e-9)
    assert 0 < sum(sizes) <= 2 * order * counts.sum()
