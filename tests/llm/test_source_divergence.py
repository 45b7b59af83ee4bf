import collections
import re

import pytest
from compare import differences
from odd_tables import empty, odd

from stationlens.llm import source_divergence as sd
from stationlens.llm.registry import ORACLES, QUERIES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least_docs, top=50):
    """rows: (text, lang, source); the rows of the audit with Python integers."""
    rows = [tuple(v or "" for v in r) for r in rows]
    docs, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        groups = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda f: (-f[0], f[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(32, 4096), (3, 50)])
def test_whole_table_equals_brute_force(spark, sf_dir, blocks):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 30)
    got = sd.audit(docs, block_groups=blocks[0], block_terms=blocks[1]).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 1000


@pytest.mark.parametrize("least_docs", [1, 3])
def test_odd_rows(spark, least_docs):
    docs = odd(spark).selectExpr("*", "1 as term", "2 as n", "3 as p")
    got = sorted(tuple(r) for r in sd.audit(docs, least_docs=least_docs, top_terms=7).collect())
    assert got == brute([(r["text"], r["lang"], r["source"]) for r in odd(spark).collect()], least_docs, 7)
    assert least_docs == 1 or all(r[4] == 0 for r in got if r[2] == "pair")


def test_empty(spark):
    assert sd.audit(empty(spark)).collect() == []


def test_long_text_in_pieces(spark, monkeypatch):
    text = " ".join(f"Wort{chr(228 + i % 7)}x{'é' * (i % 3)}" for i in range(2000))
    fold = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
    monkeypatch.setattr(sd, "_CUT", 100)
    pieces = list(sd._pieces(text.encode().translate(fold)))
    assert len(pieces) > 50 and [t for p in pieces for t in p.split()] == text.lower().encode().translate(fold).split()


def test_share_is_exact(spark):
    cases = [(0, 1), (5, 7), (10**13 + 3, 3 * 10**13 + 11), (9 * 10**15 - 1, 9 * 10**15), (5, 9 * 10**15), (1, 0)]
    df = spark.createDataFrame(cases, "n long, whole long")
    got = [r[0] for r in df.select(sd.share(df["n"], df["whole"])).collect()]
    assert got == [1 + 10**9 * n // max(whole, 1) for n, whole in cases]


def test_query(spark, duck):
    n, problems = differences(QUERIES["op13_source_divergence"](spark, "/root/testdata/sf0.01"), duck, ORACLES["op13_source_divergence"])
    assert not problems and n > 1000
