"""Centroid clustering of integer vectors, exact to the last bit.

Squared distances are |x|^2 - 2 x.c + |c|^2: one matrix product in float64 for a block of vectors. While no sum of its terms can reach 2^53 every step of it is an exact
integer, whatever the order of the additions. Rows beyond that bound are computed in 64-bit, rows beyond 2^62 in Python's integers. Each task sums its vectors up by cluster, and
`treeAggregate` combines these sums, so the driver gets k sums, never vectors.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import cut, in_arrow, tune

#: Below this, sums of integers in float64, and in 64 bits, are exact.
FLOAT_BOUND, LONG_BOUND = 2**53, 2**62
LARGEST_LONG = 2**63 - 1


def finite_vectors(rows: DataFrame, column: str, dims: int) -> DataFrame:
    """(vec_id, vector) of the rows whose vector has `dims` components, none null or non-finite; components as doubles."""
    v = F.col(column).cast("array<double>")
    good = F.size(F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))) == dims
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(F.coalesce(F.size("vector") == dims, F.lit(False)) & good)


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, scale a power of two: float64 if all are below FLOAT_BOUND, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(vectors * scale)
    if not y.size or np.abs(y).max() < FLOAT_BOUND:
        return y
    return np.array([[math.floor(x * scale) if abs(x) < FLOAT_BOUND else int(x) * scale for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(len(x), len(c)): exact squared distances of whole numbers; in float64 where the bound allows, else int64, else Python's integers."""
    bound = x.shape[1] * (_largest(x) + _largest(c)) ** 2
    if bound < FLOAT_BOUND:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    kind = np.int64 if bound < LONG_BOUND else object
    x = x.astype(np.int64).astype(kind) if x.dtype != object else x.astype(kind)
    c = c.astype(kind)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, whole numbers, cluster, distance) of vectors (float64) in up to two groups, small and large ones; small ones meet small centroids in float64. Ties: the smaller number."""
    small = math.isqrt(FLOAT_BOUND // vectors.shape[1]) // 2 - 1
    with np.errstate(over="ignore"):
        plain = np.abs(vectors).max(axis=1, initial=0.0) * scale < small
    near = np.array([_largest(c) < small for c in centroids])
    for rows in (np.flatnonzero(plain), np.flatnonzero(~plain)):
        if len(rows):
            x = whole_numbers(vectors[rows], scale)
            kinds = [np.flatnonzero(m) for m in (near, ~near) if m.any()]
            d = np.concatenate([distances(x, centroids[k]) if len(kinds) == 1 else distances(x, centroids[k]).astype(object) for k in kinds], axis=1)[:, np.argsort(np.concatenate(kinds))]
            cluster = d.argmin(axis=1)
            yield rows, x, cluster, d[np.arange(len(rows)), cluster]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: np.ndarray, scale: int) -> tuple[list[int], np.ndarray, list[int]]:
    """Of each cluster the number of its vectors, their sum by component and their distances' sum."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, far = [0] * k, np.zeros((k, dims), object), [0] * k
        for b in batches:
            for _, x, cluster, d in nearest(_matrix(b.column("vector"), dims), centroids, scale):
                for j in np.unique(cluster).tolist():
                    mine = cluster == j
                    n, rows, dist = int(mine.sum()), x[mine], d[mine]
                    if rows.dtype == object or n * _largest(rows) >= FLOAT_BOUND:
                        rows = np.array([[int(v) for v in row] for row in rows.tolist()], object)
                    part = rows.sum(axis=0)
                    count[j] += n
                    total[j] += np.array([int(v) for v in part.tolist()], object)
                    far[j] += sum(int(v) for v in dist.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((count, total.tolist(), far))], pa.binary())], names=["sums"])

    def add(a: tuple | None, b: tuple | None) -> tuple | None:
        if a is None or b is None:
            return a or b
        return [p + q for p, q in zip(a[0], b[0], strict=True)], [[p + q for p, q in zip(x, y, strict=True)] for x, y in zip(a[1], b[1], strict=True)], [p + q for p, q in zip(a[2], b[2], strict=True)]

    parts = in_arrow(vectors.select("vector"), "centroids", run, "sums binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    count, total, far = parts.treeAggregate(None, add, add)
    return count, np.array(total, object).reshape(k, dims), far


def _first(vectors: DataFrame, k: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `1:` and their id; ties by the components, null ids last."""
    digest = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    found = vectors.orderBy(digest.asc_nulls_last(), "vector").select("vector").limit(k).collect()
    return np.array([r[0] for r in found], np.float64)


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each row whose vector takes part.

    Vectors of exactly `dims` components, none null or non-finite, become whole numbers floor(scale * x), scale a power of two. The first centroids are the k vectors with the smallest digest
    of their id (fewer vectors: fewer centroids). Each round assigns every vector to the nearest (ties: smaller number) and replaces every non-empty centroid by
    the floor of its vectors' mean, componentwise; then vectors are assigned once more. All sums are exact. Distances and inertias beyond a long come out as the largest
    long. Equal ids are rows of their own, null ids are kept and start no centroid while others are left, extra columns are not looked at, without vectors there are no rows.
    """
    spark = rows.sparkSession
    tune(spark)
    names, schema = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = cut(finite_vectors(rows, column, dims))
    centroids = whole_numbers(_first(vectors, k, scale), scale)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    centroids = np.array([[int(v) for v in row] for row in centroids.tolist()], object)
    for _ in range(rounds):
        count, total, _ = _sums(vectors, centroids, scale)
        centroids = np.array([[s // n for s in t] if n else c for n, t, c in zip(count, total.tolist(), centroids.tolist(), strict=True)], object)
    far = _sums(vectors, centroids, scale)[2]
    inertia = np.array([min(f, LARGEST_LONG) for f in far], np.int64)
    everything = min(sum(far), LARGEST_LONG)
    digest = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster_ = np.zeros(b.num_rows, np.int32)
            distance = np.zeros(b.num_rows, np.int64)
            for at, _, c, d in nearest(_matrix(b.column("vector"), dims), centroids, scale):
                cluster_[at] = c
                distance[at] = [min(int(v), LARGEST_LONG) for v in d.tolist()] if d.dtype == object else d.astype(np.int64)
            columns = [b.column("vec_id"), pa.array(cluster_), pa.array(distance), pa.array(inertia[cluster_]), pa.array(np.full(b.num_rows, everything, np.int64)), pa.array(digest[cluster_], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(vectors, "centroids", run, schema)


def oracle_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """The rows of `cluster` over embeddings in DuckDB's SQL, with plain differences instead of the matrix product."""
    square = "CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM (SELECT * FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {k}))",
    ]
    near = lambda r: f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d
  FROM (SELECT x.vec_id, x.v, c.c, {square} AS d FROM kept x, c{r} c) GROUP BY vec_id)"""  # noqa: E731
    for r in range(rounds):
        steps += [
            near(r),
            f"""m{r + 1} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT c, i, sum(y) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)""",
            f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r + 1} m ON m.c = o.c)",
        ]
    steps.append(near(rounds))
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""
