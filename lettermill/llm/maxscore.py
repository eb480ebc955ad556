"""Exact top-k search by MaxScore over sharded postings.

A vector is a bag of terms: coordinate d gives term `2d` with weight x_d if x_d > 0, or `2d + 1` with weight -x_d if
x_d < 0. A query's weight for `2d` is q_d and for `2d + 1` is -q_d, so the inner product is the sum over shared terms.
A term's bound is the most that it can add in a shard: the query's weight times the largest posting, or 0 if that is
negative. Terms in ascending bound are non-essential as long as the sum of their bounds stays below the threshold (the
k-th best score so far): a row in none of the other, essential lists can't get in. Essential postings are traversed and
summed; the non-essential terms are probed, largest bound first, only for rows whose sum and the bounds still to come
reach the threshold. Rows at the threshold stay in, as ties go to the smaller id.

Rows become shards where they are read and are written once. Queries come in blocks of a bounded size, which are broadcast;
a block meets the shards in waves, each WAVE times as many as before: a wave starts at the threshold that the waves before
it have reached over all shards, so that later shards hardly give a row and no pair of vectors is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import cut, in_arrow, tune

#: Rows of a shard; components (8 bytes each) and rows of a block of queries at most; by how much waves grow.
SHARD_ROWS, BLOCK_COMPONENTS, BLOCK_ROWS, WAVE = 4096, 1 << 22, 1 << 16, 64
#: Rows that a shard scores at once while there is no threshold; it rises from one run to the next.
RUN_ROWS = 1024
NO_SCORE = -(2**63)


class Postings:
    """A shard's rows in runs of ascending id; per run and term the rows and weights, and the largest weight."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, run_rows: int = RUN_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        self.runs = []
        for at in range(0, len(ids), run_rows):
            x = vectors[at : at + run_rows]
            lists = []
            for d in range(x.shape[1]):
                for sign in (1, -1):
                    rows = np.flatnonzero(sign * x[:, d] > 0)
                    w = sign * x[rows, d]
                    lists.append((rows, w, int(w.max()) if len(w) else 0))
            self.runs.append((self.ids[at : at + run_rows], x, lists, np.array([most for *_, most in lists], np.int64)))


def search(postings: Postings, query_id: int, q: np.ndarray, k: int, best: list[tuple[int, int]] | None = None, floor: int = NO_SCORE) -> list[tuple[int, int]]:
    """(-score, id) of the k best of `best` and the shard's rows but query_id itself, in order; rows below `floor` may be left out."""
    weights = np.stack([q, -q], axis=1).ravel()
    best = best or []
    for ids, x, lists, most in postings.runs:
        threshold = max(floor, -best[-1][0] if len(best) == k else NO_SCORE)
        bound = np.maximum(weights * most, 0)
        order = np.argsort(bound, kind="stable")
        ahead = np.cumsum(bound[order])  # the most that the terms up to here can add
        loose = 0 if threshold == NO_SCORE else int(np.searchsorted(ahead, threshold))
        total = np.zeros(len(ids), np.int64)
        reached = np.zeros(len(ids), bool)
        if threshold <= 0:
            reached[:] = True  # a row that shares no term scores 0
        for t in order[loose:]:
            rows, w, _ = lists[t]
            if weights[t] and len(rows):
                total[rows] += weights[t] * w
                reached[rows] = True
        alive = np.flatnonzero(reached & (ids != query_id))
        for n in range(loose - 1, -1, -1):
            alive = alive[total[alive] + ahead[n] >= threshold]
            if not len(alive):
                break
            t = order[n]
            if weights[t]:
                d, sign = divmod(int(t), 2)
                w = x[alive, d] * (-1 if sign else 1)
                total[alive] += weights[t] * np.maximum(w, 0)
        alive = alive[total[alive] >= threshold]
        if len(alive) > 4 * k:  # only what can be among the k best, ties at the edge too
            edge = np.partition(total[alive], len(alive) - k)[len(alive) - k]
            alive = alive[total[alive] >= edge]
        if len(alive):
            best = sorted(best + [(-int(total[i]), int(ids[i])) for i in alive])[:k]
    return best


def _shards(rows: DataFrame, shard_rows: int) -> DataFrame:
    """(u, n, ids, vectors): a row for each shard; u: a hash in 0 .. 2**31; vectors: n rows of 64-bit integers, padded to one width."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(ids: list[int], vs: list[list[int]]) -> pa.RecordBatch:
            x = _matrix(vs)
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["n", "ids", "vectors"])

        ids: list[int] = []
        vs: list[list[int]] = []
        for b in batches:
            ids += b.column("vec_id").to_pylist()
            vs += b.column("v").to_pylist()
            while len(ids) >= shard_rows:
                yield shard(ids[:shard_rows], vs[:shard_rows])
                ids, vs = ids[shard_rows:], vs[shard_rows:]
        if ids:
            yield shard(ids, vs)

    made = in_arrow(rows.select("vec_id", "v"), "maxscore", build, "n int, ids binary, vectors binary")
    return cut(made.select(F.shiftrightunsigned(F.xxhash64("ids"), 33).alias("u"), "n", "ids", "vectors"))


def _matrix(vs: list[list[int]], width: int | None = None) -> np.ndarray:
    x = np.zeros((len(vs), width or max(map(len, vs))), np.int64)
    for i, v in enumerate(vs):
        x[i, : len(v)] = v
    return x


def _wave(shards: DataFrame, held: Broadcast, k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's best for a block of queries (ids, vectors, floors), at their floors or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, floors = held.value
        best: list[list[tuple[int, int]]] = [[]] * len(ids)
        for b in batches:
            for n, own, vectors in zip(*(b.column(c).to_pylist() for c in ("n", "ids", "vectors")), strict=True):
                x = np.frombuffer(vectors, np.int64).reshape(n, -1)
                width = min(x.shape[1], queries.shape[1])  # beyond it one side is zero
                postings = Postings(np.frombuffer(own, np.int64), x[:, :width], RUN_ROWS if floors[0] == NO_SCORE else max(n, 1))
                for i, q in enumerate(queries):
                    best[i] = search(postings, int(ids[i]), q[:width], k, best[i], int(floors[i]))
        for at in range(0, len(ids), 4096):
            found = np.array([(ids[i], v, -s) for i in range(at, min(at + 4096, len(ids))) for s, v in best[i]], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, c].copy()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return in_arrow(shards, "maxscore", run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k best rows of vectors, all if fewer, ties to the smaller id.

    Both: (vec_id long, v array<bigint>); a shorter vector counts as padded with zeros, an empty one as all zeros. A query's own
    id is no candidate. Vectors that are null or hold nulls take no part, nor do null ids. Repeated rows are candidates each for
    itself; of queries of one id the least vector asks. An empty side gives no rows. Exact as long as inner products fit 64 bits.
    """
    spark = vectors.sparkSession
    tune(spark)
    sound = lambda df: df.select("vec_id", "v").filter("vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    shards = _shards(sound(vectors), shard_rows)
    asks = cut(sound(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    n_asks, width = asks.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_shards = shards.count()
    blocks = max(-(-n_asks // block_rows), -(-n_asks * max(width, 1) // BLOCK_COMPONENTS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done = []
    for block in range(blocks if n_shards else 0):
        mine = asks.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()  # about block_rows
        if not mine:
            continue
        ids, x = np.array([r["vec_id"] for r in mine], np.int64), _matrix([r["v"] for r in mine], max(width, 1))
        floors, best, lo, share = np.full(len(ids), NO_SCORE), None, 0, 1
        while lo < 1 << 31:
            hi = min(1 << 31, (share << 31) // n_shards + 1)
            held = spark.sparkContext.broadcast((ids, x, floors))  # BLOCK_COMPONENTS at most
            found = _wave(shards.filter((F.col("u") >= lo) & (F.col("u") < hi)), held, k)
            found = found if best is None else found.unionByName(best.drop("rank"))
            best = cut(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
            held.destroy()
            lo, share = hi, share * WAVE
            if lo < 1 << 31:
                reached = {r["query_id"]: r["score"] for r in best.filter(F.col("rank") == k).select("query_id", "score").collect()}  # one for each query of the block
                floors = np.array([reached.get(int(i), NO_SCORE) for i in ids], np.int64)
        done.append(best.select("query_id", "rank", "vec_id", "score"))
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, done)


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 * x) of each component as a double; null, NaN or infinite components make v null."""
    x = F.transform("embedding", lambda e: F.floor(F.lit(1024.0) * e.cast("double")))
    odd = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(~odd, x).alias("v"))


def oracle_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
