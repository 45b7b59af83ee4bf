import zlib

import numpy as np
import pytest
from odd_tables import ROWS, empty, odd

from stationlens.llm.registry import QUERIES, _tokenizer
from stationlens.llm.token_store import read_store, write_store


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(_tokenizer())
    t.encode_special_tokens = True
    return t


def expected(docs, tokenizer):
    start, rows = 0, []
    for doc, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        rows.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return rows


def test_round_trip_of_odd_rows(spark, tokenizer, tmp_path):
    write_store(odd(spark), str(tmp_path / "s"), _tokenizer(), block_docs=3)
    got = [tuple(r)[:4] for r in read_store(spark, str(tmp_path / "s")).collect()]
    want = expected(sorted([(r[0], r[1]) for r in ROWS], key=lambda r: (r[0] is not None, r[0])), tokenizer)
    key = lambda r: (r[1],)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_single_documents(spark, tokenizer, tmp_path):
    write_store(odd(spark), str(tmp_path / "s"), _tokenizer(), block_docs=2)
    rows = read_store(spark, str(tmp_path / "s"), only=[5, 8]).collect()
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows}
    texts = {r[0]: r[1] for r in ROWS}
    assert ids == {k: tokenizer.encode(texts[k], add_special_tokens=False).ids + [0] for k in (5, 8)}


def test_other_dictionary_is_refused(spark, tmp_path):
    write_store(odd(spark), str(tmp_path / "s"), _tokenizer())
    head = spark.read.parquet(str(tmp_path / "s/dictionary")).first()
    changed = spark.createDataFrame([(head["sha256"], b"x" * 100, head["header"])], "sha256 string, dictionary binary, header string")
    changed.write.mode("overwrite").parquet(str(tmp_path / "s/dictionary"))
    with pytest.raises(Exception, match="hash the store names"):
        read_store(spark, str(tmp_path / "s")).collect()


def test_empty(spark, tmp_path):
    write_store(empty(spark), str(tmp_path / "s"), _tokenizer())
    assert read_store(spark, str(tmp_path / "s")).collect() == []


def test_whole_table(spark, sf_dir, tokenizer):
    got = QUERIES["op1_token_store"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    assert sorted(tuple(r) for r in got) == expected([(d["doc_id"], d["text"]) for d in docs], tokenizer)
