import numpy as np

from stationlens.llm import quality_rules as qr
from stationlens.llm.registry import QUERIES


def test_every_tested_document_has_a_distance(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_quality_rules"](spark, sf_dir).collect() if not r["base_failed"]]
    assert all(r["distance"] is not None for r in rows)
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]
    bad = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


NAMES = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def test_outliers_of_small_groups_are_rejected(spark):
    groups = [
        ("large", "a", 300), ("large", "b", 9),  # b by the whole language
        ("rest", "a", 120), ("rest", "b", 130),  # by the leftover sources together
        ("small", "b", 9),  # by all languages
    ]
    rng = np.random.default_rng(3)
    rows = [
        (lang, source, n, int(n * rng.normal(5, 0.5)), *(int(n * rng.uniform(0, most)) for most in (0.3, 0.02, 0.25)))
        for lang, source, many in groups
        for n in rng.integers(100, 400, many).tolist()
    ]
    planted = [(lang, "b", 200, 1000, 4000, 0, 0) for lang in ("large", "rest", "small")]
    got = qr.verdicts(spark.createDataFrame(rows + planted, NAMES)).collect()
    assert len(got) == len(rows) + 3 and all(r["distance"] is not None for r in got)
    assert sorted((r["lang"], r["n_symbols"]) for r in got if not r["kept"]) == [(p[0], 4000) for p in planted]


def test_small_table_keeps_what_differs_a_little(spark):
    rows = [("l", "s", 100, 500, 0, 0, 0)] * 8 + [("l", "s", 103, 520, 0, 0, 0)]
    assert all(r["kept"] for r in qr.verdicts(spark.createDataFrame(rows, NAMES)).collect())
