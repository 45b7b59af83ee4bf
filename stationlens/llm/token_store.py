"""Token ids of documents in files, each document compressed alone with a shared dictionary.

A store is a folder of three Parquet tables that Spark writes and commits:

* ``blocks`` – documents in ascending id order. A row holds about ``block_bytes`` of
  zstandard frames, one frame per document, with the offset index (``frame_ends``), the
  documents' ids and token counts, and the hash of the dictionary the frames need. The
  columns ``first_doc`` and ``last_doc`` let a reader of few documents skip blocks, and
  the offset index lets it decompress only their frames.
* ``shards`` – for each writing task, the ids of all documents before it.
* ``dictionary`` – the dictionary and its sha256. Readers refuse another one.

The dictionary is trained on a bounded sample (about ``sample_docs`` documents by hash of
their id, twice that at most, ``sample_chars`` characters of each); it only affects the size of the files. With too
few documents for training, the sample itself serves as dictionary.

Ids are serialized little-endian with 16 bits where the vocabulary allows, else 32.
Null text is an empty document (the end id alone); null ids come first; documents with
the same id stay separate and adjacent. No rows give an empty store.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlens.llm.chunk_cache import library_cache
from stationlens.llm.common import slices, utf8_buffers, worker_memo

BLOCK_FIELDS = [
    ("shard", "long", pa.int64()), ("block", "long", pa.int64()),
    ("first_doc", "long", pa.int64()), ("last_doc", "long", pa.int64()),
    ("doc_ids", "array<long>", pa.list_(pa.int64())), ("n_tokens", "array<long>", pa.list_(pa.int64())),
    ("frame_ends", "array<long>", pa.list_(pa.int64())), ("frames", "binary", pa.binary()),
    ("block_start", "long", pa.int64()), ("block_tokens", "long", pa.int64()),
    ("id_bytes", "int", pa.int32()), ("dictionary_sha256", "string", pa.string()),
]
BLOCK_SCHEMA = ", ".join(f"{name} {kind}" for name, kind, _ in BLOCK_FIELDS)
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def train_dictionary(
    docs: DataFrame, tokenizer_json: str, end_id: int, dict_bytes: int, sample_docs: int, sample_chars: int
) -> bytes:
    """A zstandard dictionary from the serialized ids of a sample of documents."""
    share = max(1, docs.count() // max(1, sample_docs))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).limit(2 * sample_docs)
    rows = chosen.select(F.substring("text", 1, sample_chars).alias("text")).collect()
    encode = library_cache(tokenizer_json)
    data, offsets = utf8_buffers(pa.array([r["text"] for r in rows], pa.string()))
    ids, counts = encode(data, offsets)
    raw = ids.astype(f"<u{encode.dtype().itemsize}")
    samples = [np.append(x, raw.dtype.type(end_id)).tobytes() for x in np.split(raw, np.cumsum(counts)[:-1])] if rows else []
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-dict_bytes:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_json: str,
    end_id: int = 0,
    level: int = 3,
    dict_bytes: int = 1 << 16,
    sample_docs: int = 2000,
    sample_chars: int = 4096,
    block_bytes: int = 1 << 20,
    block_docs: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode all documents and write them to a new store at ``path``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(docs, tokenizer_json, end_id, dict_bytes, sample_docs, sample_chars)
    digest = hashlib.sha256(dictionary).hexdigest()
    shared = spark.sparkContext.broadcast((tokenizer_json, dictionary))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_memo("library_cache", lambda: library_cache(shared.value[0]))
        size = encode.dtype().itemsize
        known = _dictionary(shared.value[1])
        compress = (zstandard.ZstdCompressor(level=level, dict_data=known) if known else zstandard.ZstdCompressor(level=level)).compress
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{size}").tobytes()
        block, begun, held = 0, 0, ([], [], [])
        held_bytes = 0

        def close() -> pa.RecordBatch:
            names, counts, frames = held
            real = [n for n in names if n is not None]
            row = [
                shard, block, min(real, default=None), max(real, default=None), list(names), list(counts),
                np.cumsum([len(f) for f in frames]).tolist(), b"".join(frames), begun, sum(counts), size, digest,
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kind) for v, (_, _, kind) in zip(row, BLOCK_FIELDS)], names=[f[0] for f in BLOCK_FIELDS]
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = utf8_buffers(batch.column(1))
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                ids, counts = encode(data[part[0] : part[-1]], part - part[0])
                raw = ids.astype(f"<u{size}").tobytes()
                upto = (np.cumsum(counts) * size).tolist()
                before = 0
                for row, now in enumerate(upto):
                    frame = compress(raw[before:now] + end)
                    held[0].append(names[first + row])
                    held[1].append((now - before) // size + 1)
                    held[2].append(frame)
                    held_bytes += len(frame)
                    before = now
                    if held_bytes >= block_bytes or len(held[0]) >= block_docs:
                        yield close()
                        block, begun, held_bytes = block + 1, begun + sum(held[1]), 0
                        for column in held:
                            column.clear()
        if held[0]:
            yield close()

    # One shuffle, of the texts: tasks own ranges of ids and write their documents in order.
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = ordered.mapInArrow(task, BLOCK_SCHEMA)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    # One row per writing task reaches the driver.
    totals = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("block_tokens").alias("n"))
    base, rows = 0, []
    for shard, n in sorted((r["shard"], r["n"]) for r in totals.collect()):
        rows.append((shard, base))
        base += n
    spark.createDataFrame(rows, "shard long, shard_start long").coalesce(1).write.parquet(f"{path}/shards")
    head = [(digest, dictionary, json.dumps({"end_id": end_id, "level": level}))]
    spark.createDataFrame(head, "sha256 string, dictionary binary, header string").coalesce(1).write.parquet(f"{path}/dictionary")


def read_store(spark: SparkSession, path: str, only: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of a store: place among all ids, number, crc32 and (on request) the ids, 32 bits each.

    ``only`` names a few documents; other blocks and frames are skipped.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    digest = head["sha256"]
    shared = spark.sparkContext.broadcast(bytes(head["dictionary"]))
    wanted = None if only is None else set(only)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    if only is not None:
        near = F.lit(False)
        for doc in only:
            near = near | ((F.col("first_doc") <= doc) & (F.col("last_doc") >= doc))
        blocks = blocks.filter(near)
    # One row per writing task, so short enough to broadcast at any size of the store.
    shards = F.broadcast(spark.read.schema("shard long, shard_start long").parquet(f"{path}/shards"))
    blocks = blocks.join(shards, "shard").select(
        "doc_ids", "n_tokens", "frame_ends", "frames", (F.col("shard_start") + F.col("block_start")).alias("start"),
        "id_bytes", "dictionary_sha256",
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.value
        if hashlib.sha256(dictionary).hexdigest() != digest:
            raise ValueError("the dictionary does not have the hash the store names")
        known = _dictionary(dictionary)
        decompress = (zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()).decompress
        for batch in batches:
            for block in batch.to_pylist():
                if block["dictionary_sha256"] != digest:
                    raise ValueError(f"block needs dictionary {block['dictionary_sha256']}, not {digest}")
                rows, start, begin = [], block["start"], 0
                for doc, n, end in zip(block["doc_ids"], block["n_tokens"], block["frame_ends"]):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(decompress(block["frames"][begin:end]), f"<u{block['id_bytes']}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"document {doc} holds {len(ids)} ids, its index says {n}")
                        raw = ids.tobytes()
                        rows.append((doc, start, n, zlib.crc32(raw), raw if with_ids else None))
                    start, begin = start + n, end
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.binary()]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    documents = blocks.mapInArrow(task, DOC_SCHEMA)
    return documents if with_ids else documents.drop("ids")
