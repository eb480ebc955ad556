"""An archive's integrity controls: a checkpoint publishes the manifests of its files, a check compares them, and both tell their evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.text import escape_path
from lettermill.operators.verify import manifest_faults
from lettermill.sources import stores, versions
from lettermill.tables import cut

EVIDENCE = "control string, subject string, kind string, algorithm string, value string, byte_length long"


class IntegrityError(ValueError):
    """An archive that isn't as its checkpoint says; `faults`: the first of them."""

    def __init__(self, faults: list[str]):
        super().__init__("archive check failed: " + "; ".join(faults))
        self.faults = faults


def hashed(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to folder, found, length): SHA-256 of every file below it, of any size, chunk by chunk."""
    top = folder.rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [stores.digests(p, n)[0] for p, n in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(digests, pa.string()), b.column("length")], names=["path", "found", "length"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = listed.repartition(n, "path").mapInArrow(run, "path string, found string, length long")
    return rows.withColumn("path", F.substring("path", F.instr("path", top) + len(top), F.length("path")))


def _evidence(files: DataFrame, control: str, archive: str) -> DataFrame:
    return files.select(F.lit(control).alias("control"), F.concat(F.lit(archive + ":"), "path").alias("subject"), F.lit("cryptographic-fixity").alias("kind"), F.lit("sha256").alias("algorithm"), F.col("found").alias("value"), F.col("length").alias("byte_length"))


def checkpoint(spark: SparkSession, folder: str, root: str, archive: str = "archive") -> DataFrame:
    """Publish below root the manifest (line) and evidence of all files below folder as a new version, both or none; the evidence (EVIDENCE)."""
    files = cut(hashed(spark, folder))
    lines = files.select(F.concat("found", F.lit("  "), escape_path(F.col("path"))).alias("line"))
    number = versions.publish({"manifest": lines, "evidence": _evidence(files, "payload-manifest", archive)}, root, {"manifest": files.count()})
    return versions.read(spark, root, "evidence", number)


def faults(spark: SparkSession, folder: str, root: str, number: int | None = None) -> DataFrame:
    """(path, fault) of the files below folder against the newest checkpoint, or that number."""
    return manifest_faults(versions.read(spark, root, "manifest", number), hashed(spark, folder), scope="")


def verify(spark: SparkSession, folder: str, root: str, archive: str = "archive", most: int = 20) -> DataFrame:
    """The evidence of a folder that is as its newest checkpoint says; else an IntegrityError with the first `most` faults."""
    found = [f"{r['path']}: {r['fault']}" for r in faults(spark, folder, root).orderBy("path", "fault").limit(most).collect()]
    if found:
        raise IntegrityError(found)
    return versions.read(spark, root, "evidence").withColumn("control", F.lit("verified"))
