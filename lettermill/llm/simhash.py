"""Document fingerprints: 128-bit SimHash with permuted block tables.

The terms of a text are its pairs of neighbouring words, lower case (the word, if there is but one). A term weighs
1 + ln(occurrences) and votes with that weight on each bit, for 1 or against it by the bit of its hash. Weights are
rounded to sixteenths, so votes are exact and equal texts have equal fingerprints on any machine.

Block tables: 128 bits fall into radius + 2 blocks; each pair of blocks is a permutation that puts these two in front
and the table's key. Two fingerprints within the radius agree on both blocks in at least one table (pigeonhole).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import NULL_ID, U64, cut, in_arrow, mix64, parts, tune, worker_state

BITS = 128
#: Entries of a worker's table of word hashes.
TABLE_ROWS = 400_000

def term_hashes(text: str) -> np.ndarray:
    words = text.lower().split()
    known = worker_state("simhash", "words", dict)
    try:
        h = [known[w] for w in words]
    except KeyError:
        if len(known) > TABLE_ROWS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = [known[w] for w in words]
    h = np.array(h, U64)
    return mix64(h[:-1] * U64(0xC2B2AE3D27D4EB4F) + (h[1:] ^ (h[1:] >> U64(33)))) if len(h) > 1 else h


def fingerprint(text: str) -> bytes:
    """16 bytes; zeros for a text without words."""
    terms, n = np.unique(term_hashes(text), return_counts=True)
    weights = np.rint(16 * (1 + np.log(n))).astype(np.float32)
    votes = np.zeros(BITS)
    for at in range(0, len(terms), 4096):
        some = terms[at : at + 4096]
        both = np.stack([some, mix64(some + U64(0x9E3779B97F4A7C15))], axis=1)
        bits = np.unpackbits(both.view(np.uint8), axis=1)
        votes += weights[at : at + 4096] @ bits.astype(np.float32)
    return np.packbits(2 * votes > float(weights.sum(dtype=np.float64))).tobytes()


def likeness(a, b):
    """Share of equal bits of two columns of (hi, lo) structs."""
    return 1 - (F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))) / F.lit(float(BITS))


def as_hex(fp):
    return F.lower(F.concat(F.lpad(F.hex(fp["hi"]), 16, "0"), F.lpad(F.hex(fp["lo"]), 16, "0")))


_FP = "struct<hi: long, lo: long>"


def _fps(texts: list[str]) -> pa.StructArray:
    x = np.frombuffer(b"".join(map(fingerprint, texts)), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["hi", "lo"])


def edited(text: str, after: str) -> str:
    """The text with the last half of its characters, rounded down, replaced by as many from the head of the next, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of docs; fp is a struct of two longs. Null text: as empty, all bits 0."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _fps(b.column("text").to_pylist())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_arrow(rows, "simhash", run, f"doc_id long, fp {_FP}")


def within(queries: DataFrame, stored: DataFrame, radius: int) -> DataFrame:
    """(query, fp, distance) for each pair of a distinct query fingerprint (fp) and a distinct stored one within the radius."""
    n = radius + 2
    edges = [BITS * i // n for i in range(n + 1)]
    block = [sum(1 << (BITS - 1 - i) for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [(signed((x | y) >> 64), signed((x | y) & (2**64 - 1))) for x, y in combinations(block, 2)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        fp = F.col("fp")
        keys = F.array(*[F.xxhash64(F.lit(t), fp["hi"].bitwiseAND(F.lit(h)), fp["lo"].bitwiseAND(F.lit(m))) for t, (h, m) in enumerate(masks)])
        return df.select("fp").distinct().select(fp.alias(name), F.posexplode(keys).alias("t", "key"))

    q, s = tables(queries, "query"), tables(stored, "fp").withColumnRenamed("t", "t2")
    hi, lo = F.col("query.hi").bitwiseXOR(F.col("fp.hi")), F.col("query.lo").bitwiseXOR(F.col("fp.lo"))
    # a pair counts in the first table that brings it together
    agrees = [(hi.bitwiseAND(F.lit(h)) == 0) & (lo.bitwiseAND(F.lit(m)) == 0) for h, m in masks]
    first = reduce(lambda e, tc: F.when(tc[1], F.lit(tc[0])).otherwise(e), reversed(list(enumerate(agrees))), F.lit(-1))
    distance = F.bit_count(hi) + F.bit_count(lo)
    on = (q["key"] == s["key"]) & (F.col("t") == F.col("t2")) & (distance <= radius) & (F.col("t") == first)
    return q.join(s.hint("merge"), on).select("query", "fp", distance.alias("distance"))


def edited_likeness(docs: DataFrame, radius: int = 3, query_step: int = 50) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, within_radius) for every row.

    The edited text ends in the head of the next document's text instead of its own last floor(n_chars / 2) characters;
    next: descending doc_id, after the last the first. Rows of one doc_id follow one another in a fixed order of their
    texts. A lone document is its own next. Texts of any length are read whole; a task holds 512 of them at a time. Null text: as empty. Null doc_id: after all others. within_radius: for ids
    divisible by query_step the number of other rows whose fingerprint lies within the radius, else null. Columns other
    than doc_id and text are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc("id"), F.desc(F.xxhash64("text"))]
    ranged = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row edited by the one after it; the range's last row waits for the next range's first text (head)."""
        part = TaskContext.get().partitionId()
        ids: list[int] = []
        texts: list[str] = []
        begun = False

        def batch(after: str | None, first: bool) -> pa.RecordBatch:
            nexts = [*texts[1:], after]
            done = [None if y is None else edited(x, y) for x, y in zip(texts, nexts, strict=True)]
            fp = _fps(texts + [x for x in (after, *done) if x is not None])
            n = len(texts)
            own, rest = fp.slice(0, n), fp.slice(n)
            of_next = own.slice(1) if after is None else pa.concat_arrays([own.slice(1), rest.slice(0, 1)])
            of_edit = rest if after is None else rest.slice(1)
            none = pa.nulls(int(after is None), own.type)
            cols = [
                pa.array([part] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), own,
                pa.concat_arrays([of_next, none]), pa.array([None if x is None else _sha(x) for x in done], pa.string()), pa.concat_arrays([of_edit, none]),
                pa.array([texts[0] if first else None, *[None] * (n - 1)], pa.string()), pa.array([*[None] * (n - 1), texts[-1] if after is None else None], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["part", "id", "n_chars", "fp", "next_fp", "edited_sha256", "edited_fp", "head", "tail"])

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if len(ids) >= 512:
                    yield batch(t, not begun)
                    begun = True
                    ids.clear()
                    texts.clear()
                ids.append(i)
                texts.append(t)
        if ids:
            yield batch(None, not begun)

    found = cut(in_arrow(ranged, "simhash", pair, f"part int, id long, n_chars long, fp {_FP}, next_fp {_FP}, edited_sha256 string, edited_fp {_FP}, head string, tail string"))
    seams = found.filter("tail IS NOT NULL").select("part", "id", "n_chars", "fp", F.col("tail").alias("text"))
    heads = found.filter("head IS NOT NULL").select("part", F.col("head").alias("next"))
    there = sorted(r["part"] for r in heads.select("part").collect())  # a number for each partition that has rows
    after = spark.createDataFrame(list(zip(there, [*there[1:], *there[:1]], strict=True)), "part int, other int")

    def sew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nexts = b.column("next").to_pylist()
            done = [edited(x, y) for x, y in zip(b.column("text").to_pylist(), nexts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_chars"), b.column("fp"), _fps(nexts), pa.array(list(map(_sha, done)), pa.string()), _fps(done)], names=["id", "n_chars", "fp", "next_fp", "edited_sha256", "edited_fp"])

    sewn = seams.join(after, "part").join(heads.withColumnRenamed("part", "other"), "other").select("id", "n_chars", "fp", "text", "next")
    sewn = cut(in_arrow(sewn, "simhash", sew, f"id long, n_chars long, fp {_FP}, next_fp {_FP}, edited_sha256 string, edited_fp {_FP}"))
    found = found.filter("tail IS NULL").drop("part", "head", "tail").unionByName(sewn)
    classes = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    asks = found.filter((F.col("id") != NULL_ID) & (F.col("id") % query_step == 0)).select("fp")
    # written, so that both sides of the join are plain exchanges and a fingerprint that very many rows share can be split
    near = cut(within(asks, classes, radius).join(classes.hint("merge"), "fp").groupBy("query").agg(F.sum("n").alias("n")))
    found = found.join(near.withColumnRenamed("query", "fp").hint("merge"), "fp", "left")
    fp, edited_fp, next_fp = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    own = F.when(F.col("id") != NULL_ID, F.col("id"))
    return found.select(
        own.alias("doc_id"), "n_chars", "edited_sha256", as_hex(fp).alias("fingerprint"), as_hex(edited_fp).alias("edited_fingerprint"),
        likeness(fp, edited_fp).alias("near_edited"), likeness(fp, next_fp).alias("near_next"),
        F.when(own % query_step == 0, F.col("n") - 1).alias("within_radius"),
    )
