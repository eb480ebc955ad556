"""Clusters by Python's integers, and by DuckDB's SQL."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lettermill.llm import centroids

KIND = "vec_id long, embedding array<double>, label int, vector int, cluster string, sums int"


def brute_force(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "g"
    c = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    near = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        c = [[sum(col) // of.count(j) for col in zip(*(v for (_, v), o in zip(kept, of, strict=True) if o == j), strict=True)] if j in of else m for j, m in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    top = 2**63 - 1
    inertia = [sum(d for _, j, d in found if j == m) for m in range(len(c))]
    return [(i, j, min(d, top), min(inertia[j], top), min(sum(inertia), top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "c", 3) for i, v in rows], KIND).repartition(3)


def made(n, dims, seed=3, spread=1.0):
    r = random.Random(seed)
    middle = [[r.uniform(-2, 2) for _ in range(dims)] for _ in range(6)]
    return [(i, [spread * (x + r.gauss(0, 0.3)) for x in r.choice(middle)]) for i in range(n)]


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e9, 1e300])
def test_equals_integers_at_every_magnitude(spark, spread):
    rows = made(60, 8, spread=spread)
    same(centroids.cluster(frame(spark, rows), k=5, rounds=3, dims=8, scale=64), brute_force(rows, 5, 3, 8, 64))


def test_odd_rows(spark):
    rows = made(40, 4)
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [math.nan, 1.0, 2.0, 3.0]), (104, [1.0, math.inf, 2.0, 3.0]), (105, [1.0] * 5), (106, [1e308, -1e308, 5e-324, -0.0]), (None, [0.1] * 4), (None, [0.2] * 4), (7, [9.0] * 4), (7, [9.0] * 4), (7, [8.0] * 4), (2**53 + 1, [2.0**47, 0.5, 1.0, -1.0])]
    got = centroids.cluster(frame(spark, rows), k=6, rounds=3, dims=4, scale=64)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same(got, brute_force(rows, 6, 3, 4, 64))


def test_ties_and_empty_clusters(spark):
    rows = [(i, [0.0, 0.0]) for i in range(30)] + [(i, [1.0, 1.0]) for i in range(30, 33)]
    same(centroids.cluster(frame(spark, rows), k=16, rounds=3, dims=2, scale=64), brute_force(rows, 16, 3, 2, 64))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = made(3, 4)
    same(centroids.cluster(frame(spark, rows), k=16, rounds=3, dims=4, scale=64), brute_force(rows, 16, 3, 4, 64))
    assert centroids.cluster(frame(spark, [(1, None)]), dims=4).isEmpty() and centroids.cluster(frame(spark, []), dims=4).isEmpty()


def test_bound_decides_between_floats_and_integers():
    x = np.array([[2.0**20, 1.0], [3.0, 4.0]])
    near, wide = centroids.distances(x, np.array([[1, 1]], object)), centroids.distances(x * 2**8, np.array([[1, 1]], object))
    assert near.dtype == np.float64 and wide.dtype == np.int64 and centroids.distances(x * 2**20, np.array([[1, 1]], object)).dtype == object
    assert near[:, 0].tolist() == [(2**20 - 1) ** 2, 13] and wide[:, 0].tolist() == [(2**28 - 1) ** 2 + 255**2, 767**2 + 1023**2]


def test_equals_sql(spark, tmp_path):
    rows = made(400, 64, seed=9)
    rows[5:8] = [(5, None), (6, [1.0] * 63), (7, [1.0] * 63 + [math.nan])]
    frame(spark, rows).select("vec_id", "embedding").coalesce(1).write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    same(centroids.cluster(spark.read.parquet(f"{tmp_path}/e")), con.execute(centroids.oracle_sql()).fetchall())
