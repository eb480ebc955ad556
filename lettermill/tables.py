"""Tables between stages, in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a folder of our own, but only if all of Spark runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "lettermill-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: lineage ends there, and a lost executor costs no earlier stage.

    The files stay until the folder is emptied, as other jobs of the session may still read them, or until they are discarded.
    """
    path = f"{shared_folder(df.sparkSession)}/lettermill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `cut` has given and that nothing reads any more, such as those of the rounds before in a loop."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dealt(scan: DataFrame, rows: int = 100_000) -> DataFrame:
    """A scan for Python that costs alike for each row: dealt out evenly to tasks of at most `rows`, one for each core at least. Row groups of Parquet need not be even, nor more than the cores."""
    return scan.repartition(max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows)))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan for work that costs far more than reading: a table in fewer splits than there are cores is dealt out once; larger ones are left as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
