"""Mail containers through Spark's own file readers, so any store that Spark can reach will do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import framing
from lettermill.operators.reports import glob_regex

# Files beside mail that hold none.
IGNORED = ("**/.DS_Store", "**/.FBCIndex", "**/Info.plist", "**/table_of_contents", "**/descmap.pce", "**/*.toc", "**/courierimapacl", "**/courierimapuiddb", "**/maildirfolder", "**/courierimapkeywords/**", "owner-names.txt")


def ignored(path: Column) -> Column:
    """Does the path match an ignored glob, in any case? `**/` also matches nothing."""
    found = F.lit(False)
    for g in IGNORED:
        regex = glob_regex(g.replace("**/", "")) if not g.endswith("/**") else glob_regex("*" + g.removeprefix("**/").removesuffix("/**") + "/*")
        tail = path if g.endswith("/**") else F.element_at(F.split(path, "/"), -1)
        found = found | F.lower(tail).rlike(regex.lower().replace("(?s)", "(?is)"))
    return found


def discover(spark: SparkSession, path: str, reading: bool = True) -> DataFrame:
    """(path, length, modified, kind, disposition, content): every file below the path; content only where it is mail.

    disposition: mail; metadata (skipped silently); partial or unrecognized (reported). Spark's reader itself passes over empty
    files and names that start with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    probe = _probe(files)
    disposition = (
        F.when(F.col("length") == 0, "empty").when(ignored(F.col("path")), "metadata").when(F.col("kind") == "partial-emlx", "partial").when(F.col("kind").isNull(), "unrecognized").otherwise("mail")
    )
    found = probe.withColumn("disposition", disposition)
    content = F.when(F.col("disposition") == "mail", F.col("content"))
    return found.select("path", "length", F.col("modificationTime").alias("modified"), "kind", "disposition", *([content.alias("content")] if reading else []))


def _probe(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [framing.kind_of(p, c[: framing.PROBE_BYTES]) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield b.append_column("kind", pa.array(kinds, pa.string()))

    return files.mapInArrow(run, "path string, modificationTime timestamp, length long, content binary, kind string")


RECORD = "container string, kind string, position long, raw binary, envelope binary, rule string, source_sha256 string, exclusion string, error string"


def records(containers: DataFrame, permissive: bool = False) -> DataFrame:
    """(container, kind, position, raw, ...) of containers (path, kind, content[, start]); a damaged container fails, or with permissive ends in a row with `error`."""
    has_start = "start" in containers.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("container", pa.string()), ("kind", pa.string()), ("position", pa.int64()), ("raw", pa.binary()), ("envelope", pa.binary()), ("rule", pa.string()), ("source_sha256", pa.string()), ("exclusion", pa.string()), ("error", pa.string())])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        held, size = [], 0  # of several containers: many hold a few records
        for b in batches:
            for row in b.to_pylist():
                try:
                    for r in framing.records(row["kind"], row["content"], row.get("start") or 0):
                        held.append((row["path"], row["kind"], r.position, r.raw, r.envelope, r.rule, r.source_sha256, r.exclusion, None))
                        size += len(r.raw)
                        if size > 8 << 20 or len(held) == 10_000:
                            yield batch(held)
                            held, size = [], 0
                except ValueError as e:
                    if not permissive:
                        raise
                    held.append((row["path"], row["kind"], None, None, None, None, None, None, str(e)))
        if held:
            yield batch(held)

    cols = ["path", "kind", "content", *(["start"] if has_start else [])]
    return containers.filter("content IS NOT NULL").select(*cols).mapInArrow(run, RECORD)


def inventory(found: DataFrame) -> DataFrame:
    """(disposition, kind, files, bytes) of discovered files."""
    return found.groupBy("disposition", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def hierarchy(path: Column) -> Column:
    """The mailbox that a file belongs to: a Maildir's root, an Apple package without its suffix, else the path."""
    maildir = F.regexp_extract(path, "^(.*)/(?:cur|new)/[^/]+$", 1)
    package = F.regexp_extract(path, r"(?i)^(.*)\.mbox/.+$", 1)
    return F.when(maildir != "", maildir).when(package != "", package).otherwise(path)


def gmail_account(path: Column) -> Column:
    """The account whose cache a file below a `[Gmail].mbox` package belongs to, else null."""
    account = F.regexp_extract(path, r"([^/]+)/\[Gmail\]\.mbox/.*\.emlx$", 1)
    return F.when(account != "", account)


# From the surest to the least sure.
SERVICES = ("gmail", "ews", "imap", "pop", "local")


def services(marks: DataFrame) -> DataFrame:
    """(account, service) of marks (account, service): the first of SERVICES that an account has, else unknown."""
    have = marks.groupBy("account").agg(F.collect_set("service").alias("have"))  # six values at most
    chosen = F.coalesce(*[F.when(F.array_contains("have", s), F.lit(s)) for s in SERVICES], F.lit("unknown"))
    return have.select("account", chosen.alias("service"))
