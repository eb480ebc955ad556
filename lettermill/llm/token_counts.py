"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, count) in shared storage. A run joins the digests of
its texts to the cache, encodes one text for each digest that is missing, and appends those counts.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import NULL_ID, cut, in_arrow, shared_folder, text_bytes, tune, worker_state
from lettermill.llm.pieces import piece_table

CACHE = "content binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Of the tokenizer's file and of the library that reads it: counts of another version are other counts."""
    h = hashlib.sha256(open(path, "rb").read())  # noqa: SIM115
    h.update(version("sentencepiece" if path.endswith(".model") else "tokenizers").encode())
    return h.hexdigest()


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """As the library gives them, without begin, end or added special tokens, truncation or padding."""
    if path.endswith(".model"):
        t = piece_table(path)
        return [t.count(x) for x in texts]
    return [len(e.ids) for e in worker_state("token_counts", path, lambda: _library(path)).encode_batch(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    tokenizer: path of a .model (sentencepiece) or .json (tokenizers) file, the same on every node. cache: path of the
    cache; None begins a new one in the shared folder. A text's normalised content is its UTF-8 bytes, null as empty:
    both libraries see every byte, so any wider equality could merge texts of different counts. A text shared by many
    rows, of one id or several, is encoded once. Repeated rows give repeated results, a null doc_id stays
    null, other columns are not looked at, an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    mark = tokenizer_digest(tokenizer)
    cache = cache or f"{shared_folder(spark)}/lettermill/token-counts-{uuid.uuid4().hex}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), text_bytes().alias("bytes"))
    rows = rows.withColumn("content", F.unhex(F.sha2("bytes", 256)))
    keys = cut(rows.select("id", "content", F.octet_length("bytes").cast("long").alias("n_bytes")))
    stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == mark)
    misses = keys.groupBy("content").agg(F.min("id").alias("id")).join(stored.select("content"), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[bytes] = set()
        for b in batches:
            # rows of one id and text all match, and the join puts them in a row: the first of them is encoded
            content = b.column("content").to_pylist()
            first = [k for k, c in enumerate(content) if c not in last and (not k or c != content[k - 1])]
            last = set(content)
            some = b.take(pa.array(first, pa.int64()))
            n = count_tokens(tokenizer, [x.decode() for x in some.column("bytes").to_pylist()])
            yield pa.RecordBatch.from_arrays([some.column("content"), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    fresh = in_arrow(rows.join(misses, ["id", "content"]).select("content", "bytes"), "pieces" if tokenizer.endswith(".model") else "token_counts", encode, "content binary, n_tokens long")
    fresh.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).select("content", F.lit(mark).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # two runs may have appended the same text: one row a digest. Written, so that the join reads both sides as they are and can split a digest that very many rows share
    counts = cut(spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == mark).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    own = F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id")
    return keys.join(counts, "content").select(own, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
