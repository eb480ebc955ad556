"""A corpus made ready for ingest: files chosen by globs, told apart by their first bytes, split into messages where their kind says so, and counted before anything is seen of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.sources import mail, stores, versions

#: Bytes by which a file is told; the kinds of corpora.
HEAD = 64 << 10
KINDS = ("messages", "mailboxes", "mixed", "rmail")
_HEADER = re.compile(rb"(?mi)^(date|from|to|subject|message-id|received):[ \t]*")


def chosen(relative: Column, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    """Does a path match one of the globs, from its end on, and none of the excluded? `**/` is any number of folders, `*` and `?` stay within a name."""

    def regex(glob: str) -> str:
        parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        return "(?s)(^|/)" + "".join(parts.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob)) + "$"

    any_of = lambda globs: F.lit(bool(globs)) & relative.rlike("|".join(map(regex, globs)) or "^$")
    return any_of(include) & ~any_of(exclude)


def heads(files: DataFrame) -> DataFrame:
    """files (path, length, ...) with `head` (mbox, babyl or other) and `fields`: does a header field stand in the first bytes?"""

    def kind(head: bytes) -> str:
        if head.startswith(b"From "):
            return "mbox"
        return "babyl" if head[:14].lower() == b"babyl options:" else "other"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stores.between(p, 0, min(HEAD, n)) for p, n in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True)]
            yield b.append_column("head", pa.array(map(kind, found), pa.string())).append_column("fields", pa.array([bool(_HEADER.search(x)) for x in found], pa.bool_()))

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", head string, fields boolean")


def prepared(spark: SparkSession, source: str, kind: str, include: tuple[str, ...] = ("**/*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(source, position, form, raw) of the corpus below source: split messages with their bytes (form eml), and files that stay whole where they are (form eml or mbox, raw null).

    messages: mailboxes are split, other files are messages. mailboxes: only these. mixed: mailboxes and what has header fields. rmail: as mixed, but RMAIL files are split.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of corpus {kind}")
    top = source.rstrip("/") + "/"
    relative = F.substring(F.col("path"), F.instr("path", top) + len(top), F.length("path"))
    listed = mail.files(spark, source).select("path", "length", F.when(F.instr("path", top) > 0, relative).otherwise(F.element_at(F.split("path", "/"), -1)).alias("relative"))
    found = heads(listed.filter(chosen(F.col("relative"), include, exclude)).select("path", "length"))
    split = {"messages": "head = 'mbox'", "rmail": "head = 'babyl'"}.get(kind, "false")
    whole = {"messages": "true", "mailboxes": "head = 'mbox'"}.get(kind, "(head = 'mbox' OR fields)")
    messages = mail.records(found.filter(split).select("path", "length", F.lit(0).alias("start"))).select(F.col("container").alias("source"), "position", F.lit("eml").alias("form"), "raw")
    files = found.filter(f"NOT ({split}) AND {whole}").select(F.col("path").alias("source"), F.lit(0).cast("long").alias("position"), F.when(F.col("head") == "mbox", "mbox").otherwise("eml").alias("form"), F.lit(None).cast("binary").alias("raw"))
    return messages.unionByName(files)


def prepare(spark: SparkSession, source: str, root: str, kind: str, include: tuple[str, ...] = ("**/*",), exclude: tuple[str, ...] = (), expected: int | None = None) -> int:
    """`prepared` published below root as the table `prepared`, counted as it is written. None at all, or another number than expected, is an error that leaves no version."""
    rows = prepared(spark, source, kind, include, exclude)
    return versions.publish({"prepared": rows}, root, {"prepared": expected} if expected is not None else None, filled=("prepared",))
