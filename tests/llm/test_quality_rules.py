import collections
import re

import numpy as np
import pytest
from odd_tables import ROWS, empty, odd

from stationlens.llm import quality_rules as qr
from stationlens.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def brute_mcd(x, subset, steps):
    """The same concentration steps on one group, with plain numpy; the distances of any rows, and the scale."""

    def estimate(rows):
        m = rows.mean(0)
        c = rows.T @ rows / len(rows) - np.outer(m, m) + np.eye(qr.D) * qr.RIDGE**2
        return m, np.linalg.cholesky(c)

    def distances(p, rows=x):
        z = np.linalg.solve(p[1], (rows - p[0]).T)
        return (z * z).sum(0)

    def bins(d):
        return np.floor(np.log2(np.maximum(d, 2.0**-40)) * qr.BINS_PER_OCTAVE)

    q = np.percentile(x, [25, 50, 75], axis=0)
    fits = [(q[1], np.diag((q[2] - q[0]) / 1.349 + qr.RIDGE)), estimate(x)]
    found = []
    for p in fits:
        for _ in range(steps):
            b = bins(distances(p))
            p = estimate(x[b <= np.sort(b)[int(np.ceil(len(x) * subset)) - 1]])
        found.append(p)
    p = min(found, key=lambda f: np.log(np.diag(f[1])).sum())

    def scale(d):
        b = np.sort(bins(d))
        return 2.0 ** ((b[int(np.ceil(len(x) / 2)) - 1] + 1) / qr.BINS_PER_OCTAVE) / qr.CHI_MEDIAN

    d = distances(p)
    p = estimate(x[2.0 ** ((bins(d) + 1) / qr.BINS_PER_OCTAVE) <= qr.CHI_REWEIGHT * scale(d)])
    return lambda rows: distances(p, rows), scale(distances(p))


def brute_distances(rows, subset=0.75, steps=4, min_group=200):
    """rows: (key, counts); None where the base rule fails.

    A document is judged by the first of these that has ``min_group`` rows: its source in its
    language, the small sources of the language together, the language, everything.
    """
    stats = {}
    for i, (_, n) in enumerate(rows):
        if n[0] >= 20 and 100 * n[4] <= 30 * n[0]:
            w = n[0]
            v = [np.log(w) / 4, np.log(max(n[1], 1) / w), n[2] / w, n[3] * 8 / w, n[4] / w]
            stats[i] = np.floor(np.array(v) * qr.UNIT + 0.5)
    sizes = collections.Counter(rows[i][0] for i in stats)
    out = [None] * len(rows)
    judges = {}
    for i in stats:
        lang, source = rows[i][0]
        levels = [
            ("source", lang, source) if sizes[lang, source] >= min_group else ("rest", lang),
            ("lang", lang), ("all",),
        ]
        for level in levels:
            if level not in judges:
                member = {
                    "source": lambda k: k == level[1:], "rest": lambda k: k[0] == level[1] and sizes[k] < min_group,
                    "lang": lambda k: k[0] == level[1], "all": lambda k: True,
                }[level[0]]
                x = np.array([stats[j] for j in stats if member(rows[j][0])])
                enough = len(x) >= min_group or level == ("all",)
                judges[level] = brute_mcd(x, subset, steps) if enough else None
            if judges[level]:
                break
        distances, scale = judges[level]
        out[i] = distances(stats[i][None, :])[0] / (scale if len(stats) >= min_group else max(scale, 1))
    return out


@pytest.mark.parametrize("min_group", [30, 200])
def test_whole_table(spark, sf_dir, min_group):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in qr.verdicts(qr.base_counts(docs).drop("text"), min_group=min_group).collect()}
    rows = docs.collect()
    counts = [brute_counts(r["text"]) for r in rows]
    want = brute_distances([((r["lang"], r["source"]), c) for r, c in zip(rows, counts)], min_group=min_group)
    assert sum(d is not None and d > qr.LIMIT for d in want) > 10
    for r, c, d in zip(rows, counts, want):
        g = got[r["doc_id"]]
        assert tuple(g[b] for b in qr.BASE) == c
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        assert g["base_failed"] == failed
        assert (d is None) == failed
        assert g["kept"] == (not failed and d <= qr.LIMIT)
        if d is not None:
            assert g["distance"] == pytest.approx(d, rel=1e-6, abs=1e-9)


def test_query_keeps_good_documents(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_quality_rules"](spark, sf_dir).collect() if not r["base_failed"]]
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]
    bad = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "1 as kept", "2 as n_words", "3 as l00", "4 as d2")
    got = qr.verdicts(qr.base_counts(docs)).collect()
    assert len(got) == len(ROWS) and set(got[0].asDict()) >= {"l00", "d2", "text", "score"}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    have = sorted([(r["doc_id"], *[r[b] for b in qr.BASE]) for r in got], key=key)
    assert have == sorted([(r[0], *brute_counts(r[1])) for r in ROWS], key=key)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_empty(spark):
    assert qr.verdicts(qr.base_counts(empty(spark))).collect() == []


def test_plan_has_no_python(spark, sf_dir):
    plan = QUERIES["op3_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
