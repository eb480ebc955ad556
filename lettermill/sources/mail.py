"""Mail of files of any size as a Spark data source: `spark.read.format("mail").load(folder)`, and `spark.readStream.format("mail")` for what grows.

A mailbox is cut into byte ranges; each is read by a task of its own, which begins at the first envelope in its range and ends with the record that begins last in it. Other
containers are one record or need their whole content, and are read by one task. No task holds more than a chunk and one record of a mailbox.

The streaming offset is a map from each source to the length and digest of what is known of it. A source that has grown is read
from there, if the digest still holds and a record begins at that place; a changed one is read anew, an unchanged one not at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lettermill.functions import framing
from lettermill.operators.reports import glob_regex
from lettermill.sources import containers, stores

#: Bytes of a mailbox that a task reads, and files that it reads at most; bytes of an Arrow batch.
SPLIT, FILES, BATCH = 128 << 20, 1000, 8 << 20
#: Bytes that are read at a time behind a range.
BEYOND = 64 << 10
#: size: the record's bytes in the container; length: what was known of the container when it was read.
RECORD = containers.RECORD + ", size long, length long"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in RECORD.split(", "))])


def ignored(path: str) -> bool:
    """As `containers.ignored`, of one path."""
    for g in containers.IGNORED:
        inside = g.endswith("/**")
        regex = glob_regex("*" + g.removeprefix("**/").removesuffix("/**") + "/*") if inside else glob_regex(g.replace("**/", ""))
        if re.search(regex.lower().replace("(?s)", "(?is)"), path.lower() if inside else path.rsplit("/", 1)[-1].lower()):
            return True
    return False


def stored_records(chunks: Iterable[bytes], at: int, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of the mailbox records that begin in [begin, end). chunks: the file from `at` on, which is begin or, behind the file's start, the byte before."""
    held, base, search, current = bytearray(), at, 0, None
    if begin == 0:  # the file's start is a line's start
        held, base = bytearray(b"\n"), -1
    for chunk in chunks:
        held += chunk
        while (i := held.find(b"\nFrom ", search)) >= 0:
            if current is not None:
                yield current, bytes(held[: i + 1])
            del held[: i + 1]
            base, search = base + i + 1, 0
            if base >= end:
                return
            current = base
        search = max(0, len(held) - 5)
        if current is None and search:  # before the first record
            del held[:search]
            base, search = base + search, 0
    if current is not None:
        yield current, bytes(held)


def read_range(path: str, begin: int, end: int, length: int, start: int = 0) -> Iterator[tuple]:
    """Rows of RECORD that begin in [begin, end) of a container of which `length` bytes count, reading of which begins at `start`. A damaged record, or a damaged container of another kind, is a row with `error`."""
    head = stores.between(path, 0, min(framing.PROBE_BYTES, length))
    kind = framing.kind_of(path, head)

    def row(r: framing.Record, size: int) -> tuple:
        return path, kind, r.position, r.raw, r.envelope, r.rule, r.source_sha256, r.exclusion, None, size, length

    if kind == "mbox":
        framed = head.split(b"\n", 1)[0].rstrip(b"\r") == framing.MMDF
        at = max(0, begin - 1)
        # behind its end a range reads on only until its last record is whole
        chunks = chain(stores.pieces(path, at, min(end, length)), stores.pieces(path, min(end, length), length, BEYOND))
        for position, stored in stored_records(chunks, at, begin, end):
            try:
                yield row(framing.mailbox_record(position, stored, framed), len(stored))
            except ValueError as e:
                yield path, kind, position, None, None, None, None, None, str(e), len(stored), length
    elif kind in ("babyl", "emlx", "eml") and begin == start:
        content = stores.between(path, 0, length)
        try:
            for r in framing.records(kind, content):
                yield row(r, len(content))
        except ValueError as e:
            yield path, kind, None, None, None, None, None, None, str(e), len(content), length


def in_batches(rows: Iterable[tuple], permissive: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        if row[8] is not None and not permissive:
            raise ValueError(f"{row[0]}: {row[8]}")
        held.append(row)
        size += len(row[3] or b"")
        if size > BATCH or len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class Ranges(InputPartition):
    """(path, begin, end, length, start) of what one task reads."""

    ranges: list[tuple[str, int, int, int, int]]


def dealt(files: Iterable[tuple[str, int, int]], split: int) -> list[Ranges]:
    """Tasks for files (path, start, length): a large one in ranges of `split` bytes, small ones together."""
    out, held, size = [], [], 0
    for path, start, length in files:
        if length - start > split:
            out += [Ranges([(path, b, min(b + split, length), length, start)]) for b in range(start, length, split)]
            continue
        held.append((path, start, length, length, start))
        size += length - start
        if size >= split or len(held) >= FILES:
            out.append(Ranges(held))
            held, size = [], 0
    return [*out, Ranges(held)] if held else out


class _Read:
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.permissive, self.whole = options.get("permissive", "false").lower() == "true", options.get("seal", "ends") == "whole"

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from in_batches((row for r in partition.ranges for row in read_range(*r)), self.permissive)

    def files(self) -> list[tuple[str, int, int]]:
        return [f for f in stores.listing(self.path) if not ignored(f[0])]


class _Batch(_Read, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return dealt(((path, 0, length) for path, length, _ in self.files()), self.split) or [Ranges([])]


def decide(path: str, known: dict | None, length: int, digest: str, whole: bool = False) -> tuple[str, int]:
    """One decision for a source, of which {length, sha256} is known: (skip, resume or read, the byte from which on it is read)."""
    if known is None:
        return "read", 0
    was = known["length"]
    if (was, known["sha256"]) == (length, digest):
        return "skip", length
    if length > was > 0 and stores.seal(path, was, whole) == known["sha256"]:
        seam = stores.between(path, was - 1, min(was + 5, length))
        if seam == b"\nFrom " and framing.kind_of(path, stores.between(path, 0, framing.PROBE_BYTES)) == "mbox":
            return "resume", was
    return "read", 0


class _Stream(_Read, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.sealed: dict[str, tuple[tuple[int, int], str]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for path, length, changed in self.files():
            if self.sealed.get(path, (None,))[0] != (length, changed):
                digest = stores.seal(path, length, self.whole)
                if digest is None:  # it has just become shorter
                    continue
                self.sealed[path] = (length, changed), digest
            found[path] = {"length": length, "sha256": self.sealed[path][1]}
        return found

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        todo = []
        for path in sorted(end):
            decision, begin = decide(path, start.get(path), end[path]["length"], end[path]["sha256"], self.whole)
            if decision != "skip":
                todo.append((path, begin, end[path]["length"]))
        return dealt(todo, self.split)


class MailSource(DataSource):
    """Options: path; split (bytes of a mailbox for one task); permissive (damaged records as rows with `error`, else they fail); seal: `ends` (digests of a source's length and both
    ends, so that little is read to tell what is new) or `whole` (of all its bytes, read by the driver)."""

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(MailSource)
    return spark


def ranges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, begin, end, length, start) of files (path, length, start): large ones cut into ranges."""
    begins = F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("length") - 1), F.lit(split).cast("long"))
    cut = files.select("path", F.col("length").cast("long").alias("length"), F.col("start").cast("long").alias("start")).filter("length > start").withColumn("begin", F.explode(begins))
    return cut.select("path", "begin", F.least(F.col("begin") + split, F.col("length")).alias("end"), "length", "start")


def records(files: DataFrame, permissive: bool = False, split: int = SPLIT) -> DataFrame:
    """RECORD of files (path, length, start), of any size: the ranges are dealt out over tasks. Damaged records fail, or with permissive are rows with `error`."""
    dealt_out = ranges(files, split)
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from in_batches((row for r in b.to_pylist() for row in read_range(r["path"], r["begin"], r["end"], r["length"], r["start"])), permissive)

    return dealt_out.repartition(n, "path", "begin").mapInArrow(run, RECORD)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files below path, by Spark's own listing; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).filter(~containers.ignored(F.col("path")))


def checked(found: DataFrame, known: DataFrame) -> DataFrame:
    """found (path, length, ...) with kind, sha256, was (the known length or 0), prefix_sha256 (of the known length, null if shorter) and seam (does a record begin there?). known: (path, length).

    Files are hashed chunk by chunk, one pass over each.
    """
    rows = found.join(known.select("path", F.col("length").alias("was")), "path", "left").withColumn("was", F.coalesce("was", F.lit(0)).cast("long"))
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", kind string, sha256 string, prefix_sha256 string, seam boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, whole, prefix, seams = [], [], [], []
            for path, length, was in zip(*(b.column(c).to_pylist() for c in ("path", "length", "was")), strict=True):
                kinds.append(framing.kind_of(path, stores.between(path, 0, min(framing.PROBE_BYTES, length))))
                sums = stores.digests(path, was, length) if was <= length else [None, *stores.digests(path, length)]
                prefix.append(sums[0])
                whole.append(sums[1])
                seams.append(was == 0 or stores.between(path, was - 1, min(was + 5, length)) == b"\nFrom ")
            more = [pa.array(kinds, pa.string()), pa.array(whole, pa.string()), pa.array(prefix, pa.string()), pa.array(seams, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "kind", "sha256", "prefix_sha256", "seam"])

    return rows.repartition(n, "path").mapInArrow(run, schema)
