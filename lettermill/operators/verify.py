"""Verification: every check is a DataFrame of faults, and an archive without faults is verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lettermill.functions.text import unescape_path
from lettermill.operators.reconcile import both_ways
from lettermill.tables import cut

LINE = r"^([0-9a-f]{64})  (.+)$"


def manifest_faults(lines: DataFrame, files: DataFrame, scope: str = "data/") -> DataFrame:
    """(path, fault) of a manifest (line) against files (path, content, or in its place the digest `found`): grammar, unsafe or foreign paths, repeats, wrong hashes, and files on one side only."""
    parsed = lines.select(F.regexp_extract("line", LINE, 1).alias("sha256"), unescape_path(F.regexp_extract("line", LINE, 2)).alias("path"), "line")
    bad = F.when(F.col("sha256") == "", "malformed row").when(F.col("path").isNull() | F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))"), "unsafe path").when(~F.col("path").startswith(scope), "out of scope")
    rows = parsed.withColumn("fault", bad)
    grammar = rows.filter("fault IS NOT NULL").select(F.coalesce(F.nullif("path", F.lit("")), "line").alias("path"), "fault")
    good = rows.filter("fault IS NULL").select("path", "sha256")
    repeated = good.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path", F.lit("listed more than once").alias("fault"))
    hashes = files.select("path", "found" if "found" in files.columns else F.sha2("content", 256).alias("found"))
    wrong = good.join(hashes, "path").filter("sha256 <> found").select("path", F.lit("hash mismatch").alias("fault")).distinct()
    sides = both_ways(good, hashes, "path").select("path", F.when(F.col("side") == "left", "missing file").otherwise("not in manifest").alias("fault"))
    return reduce(DataFrame.unionByName, [grammar, repeated, wrong, sides])


#: Quote marks up to which all readings of a record are tried where it is read; those of more are dealt out by whose the first marks are.
EASY_MARKS, DEALT_MARKS = 14, 8


def record_faults(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(mailbox, ordinal, fault) of manifest rows (mailbox, ordinal, sha256, semantic_sha256) against stored records (mailbox, ordinal, record): a record must have a reading with the raw hash, and that reading the semantic hash.

    Every reading is tried. A record of many quote marks, not all alike, is dealt out in 256 shares of its readings.
    """
    both = manifest.join(records, ["mailbox", "ordinal"], "full_outer").select("mailbox", "ordinal", "sha256", "semantic_sha256", "record")

    def told(row: dict, raw: bytes | None) -> str | None:
        from lettermill.functions.mail import semantic_bytes

        if raw is None:
            return "raw hash mismatch"
        return "semantic hash mismatch" if hashlib.sha256(semantic_bytes(raw)).hexdigest() != row["semantic_sha256"] else None

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lettermill.functions.storage import marks, recovered

        for b in batches:
            faults = []
            for row in b.to_pylist():
                if row["record"] is None:
                    faults.append("missing record")
                elif row["sha256"] is None:
                    faults.append("unexpected record")
                else:
                    hard = marks(row["record"]) > EASY_MARKS
                    raw = recovered(row["record"], row["sha256"], alike=hard)
                    faults.append("open" if hard and raw is None else told(row, raw))
            yield b.append_column("fault", pa.array(faults, pa.string())).filter(pa.array([f is not None for f in faults], pa.bool_()))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lettermill.functions.storage import recovered

        for b in batches:
            faults = [told(row, recovered(row["record"], row["sha256"], first=[bool(row["share"] >> k & 1) for k in range(DEALT_MARKS)])) for row in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("row", "mailbox", "ordinal")] + [pa.array(faults, pa.string())], names=["row", "mailbox", "ordinal", "fault"])

    rows = both.mapInArrow(near, StructType([*both.schema.fields, StructField("fault", StringType())]))
    kept = cut(rows.withColumn("record", F.when(F.col("fault") == "open", F.col("record"))).withColumn("row", F.monotonically_increasing_id()))
    shares = kept.filter("fault = 'open'").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(2**DEALT_MARKS - 1)))).repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "share")
    tried = shares.mapInArrow(far, "row long, mailbox string, ordinal int, fault string")
    # the one share with the reading that has the hash knows; where there is none, all say so
    one = tried.groupBy("row").agg(F.first("mailbox").alias("mailbox"), F.first("ordinal").alias("ordinal"), F.count_if(F.col("fault").isNull()).alias("right"), F.min_by("fault", F.col("fault") == "raw hash mismatch").alias("fault"))
    return kept.filter("fault <> 'open'").select("mailbox", "ordinal", "fault").unionByName(one.filter("right = 0").select("mailbox", "ordinal", "fault"))


def csv_faults(rows: DataFrame, containers: DataFrame, key: str, container: str) -> DataFrame:
    """(key, fault): identifiers repeated in any case, and containers (container, records) whose rows are not as many."""
    repeated = rows.groupBy(F.lower(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit("repeated identifier").alias("fault"))
    counted = rows.groupBy(container).agg(F.count(F.lit(1)).alias("n"))
    uneven = counted.join(containers, container, "full_outer").filter("NOT n <=> records").select(F.col(container).alias("key"), F.lit("record count differs").alias("fault"))
    return repeated.unionByName(uneven)


def schema_faults(df: DataFrame, expected: str) -> list[str]:
    """Columns that are missing, foreign or of another type than in the expected DDL."""
    from pyspark.sql.types import StructType

    want, have = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (StructType.fromDDL(expected), df.schema))
    return [f"missing {c}" for c in want.keys() - have.keys()] + [f"foreign {c}" for c in have.keys() - want.keys()] + [f"{c} is {have[c]}, not {want[c]}" for c in want.keys() & have.keys() if want[c] != have[c]]


def verified(*faults: DataFrame) -> bool:
    """No check has found a fault."""
    return all(f.isEmpty() for f in faults)
