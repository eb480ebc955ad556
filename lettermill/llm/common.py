"""What the corpus operators share: table access, session settings, worker state."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.tables import cut, discard, shared_folder, spread  # noqa: F401  the operators have them from here

#: Stands for a null document id inside the operators; nulls sort before every id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: a Python worker holds one at a time, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str = "text"):
    """A text's UTF-8 bytes, a null's as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


_held: dict = {}


def release(operator: str) -> None:
    """Give up what a reused Python worker still holds for other operators."""
    if _held and next(iter(_held))[0] != operator:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def worker_state(operator: str, key, make, most: int = 2):
    """What a Python worker keeps between batches and tasks: only the present operator's, and at most so many of them, so that workers stay small."""
    release(operator)
    if (operator, key) not in _held:
        if len(_held) >= most:
            _held.clear()
        _held[operator, key] = make()
    return _held[operator, key]


def in_arrow(rows: DataFrame, operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """rows.mapInArrow(run, schema) in a worker that holds no other operator's tables."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(operator)
        yield from run(batches)

    return rows.mapInArrow(alone, schema)


U64 = np.uint64


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U64(31))) * U64(0x9FB21C651E98DF25)
    h = (h ^ (h >> U64(28))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))
