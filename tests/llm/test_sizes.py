"""Texts longer than a piece of the suffix index, and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lettermill.llm import bktree, packing, pieces, simhash, suffix, token_counts, toxicity

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    long = " ".join(f"{r.getrandbits(48):x}" for _ in range(90_000))
    assert len(long) > suffix.PIECE
    return [long, "own beginning " + long[5000:] + " own end", "short"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_long_texts_lose_what_repeats(docs, texts):
    got = by_id(suffix.dedup(docs))
    assert got[0]["n_removed"] == got[2]["n_removed"] == 0
    assert (got[1]["n_spans"], got[1]["n_removed"]) == (1, len(texts[0]) - 5000)
    assert got[1]["kept_sha256"] == hashlib.sha256(b"own beginning  own end").hexdigest()


def test_long_texts_are_encoded_whole(docs, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got, counts = by_id(pieces.encode_decode(docs, MODEL)), by_id(token_counts.token_counts(docs, MODEL))
    for i, t in enumerate(texts):
        ids = sp.encode(t)
        assert got[i]["n_tokens"] == counts[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_long_texts_are_packed_whole(docs, texts):
    t, want = Tokenizer.from_file(WORDS), set()
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want |= {(i, s // 4096, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)}
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packing.pack(docs, WORDS).collect()} == want


def test_long_texts_are_fingerprinted_and_grouped(docs, texts):
    got = by_id(simhash.edited_likeness(docs))
    assert [got[i]["n_chars"] for i in range(3)] == [len(t) for t in texts]
    before = docs.filter("doc_id < 2").withColumn("text", F.when(F.col("doc_id") == 1, F.lit(texts[0])).otherwise(F.col("text")))
    assert len({r["fingerprint"] for r in simhash.edited_likeness(before).collect()}) == 1
    assert {r["id"]: r["component"] for r in bktree.near_groups(docs).collect()} == {1: 0}
    assert bktree.near_dedup(docs).count() == 3


def test_empty_tables(none, spark):
    assert simhash.edited_likeness(none).isEmpty() and suffix.dedup(none).isEmpty() and packing.pack(none, WORDS).isEmpty()
    for kept in (suffix.without_repeats(none), bktree.one_of_each(none), toxicity.without_toxic(none, toxicity.Model())):
        assert kept.isEmpty() and kept.columns == none.columns


def test_pipeline_on_empty_tables(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
