import collections

import pytest
from odd_tables import empty, odd
from test_packing import check
from test_simhash import brute_groups, brute_print
from test_suffix_dedup import brute

import corpus_pipeline as cp
from stationlens.llm import language_id, quality_rules
from stationlens.llm.registry import QUERIES, _tokenizer
from stationlens.session import written


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*cp.COLUMNS).collect()), key=repr)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        before = docs.collect()
        if name == "packing":
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(_tokenizer())
            t.encode_special_tokens = True
            check(out.collect(), [(d["doc_id"], t.encode(d["text"] or "", add_special_tokens=False).ids + [0]) for d in before])
            break
        docs = written(out, f"test-{name}")
        assert docs.columns == list(cp.COLUMNS)
        after = rows_of(docs)
        if name == "language":
            judged = language_id.identify(spark.createDataFrame(before), language_id.learn(spark.createDataFrame(before))).collect()
            want = [r for r in judged if r["lang_pred"] != "und" and r["score"] >= cp.MIN_SCORE]
            assert after == sorted((tuple(r[c] for c in cp.COLUMNS) for r in want), key=repr)
            assert len(after) > 0.98 * len(before)
        elif name == "quality":
            judged = quality_rules.verdicts(quality_rules.base_counts(spark.createDataFrame(before))).collect()
            assert after == sorted((tuple(r[c] for c in cp.COLUMNS) for r in judged if r["kept"]), key=repr)
        elif name == "near_duplicates":
            prints = [(d["doc_id"], brute_print(d["text"])) for d in before]
            stay = {d for (d, _), c in zip(prints, brute_groups(prints)) if d == c}
            assert after == sorted((tuple(d) for d in before if d["doc_id"] in stay), key=repr)
            assert len(after) < len(before)
        elif name == "repeats":
            texts = [b[4].decode(errors="ignore") for b in brute([(d["doc_id"], d["text"]) for d in before])]
            assert after == sorted(((d["doc_id"], t, d["lang"], d["source"], len(t)) for d, t in zip(before, texts)), key=repr)


def test_run_is_the_stages_in_order(spark, sf_dir):
    rows = QUERIES["pipeline"](spark, sf_dir).collect()
    assert rows and {"doc_id", "sequence_id", "ids_crc32"} <= set(rows[0].asDict())
    sizes = collections.Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) == 1024


def test_odd_rows_pass_every_stage(spark):
    docs = odd(spark)
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, "").collect()
        assert all(len(r) == len(cp.COLUMNS) for r in kept), name
    groups = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, "").collect()]
    assert len(groups) == len(set(groups)) and (None, "text without id") in groups
    assert sum(i == 1 for i, _ in groups) == 1


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_empty(spark, name, stage):
    assert stage(spark, empty(spark), "").collect() == []


def test_unrelated_texts_of_one_id_stay(spark):
    one, other = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(1, one), (1, other), (1, other), (2, one), (3, other), (None, one), (None, "nobody knows this one at all")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, one), (1, other), (None, "nobody knows this one at all")], key=str)
