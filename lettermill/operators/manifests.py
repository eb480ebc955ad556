"""Integrity manifests of mailboxes: declarations of hash standards, a record of the mailbox and a row for each message; written, parsed and checked."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.storage import canonical_json, strict_json
from lettermill.operators.verify import record_faults
from lettermill.sources import sinks
from lettermill.tables import cut

# Digest lengths, what each standard is of, its input and canonical form, the heads of the table, and the standards that every manifest has.
ALGORITHMS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}
SCOPES = {"mbox": "mbox", "raw": "message", "semantic": "message"}
INPUTS = {"mbox": "complete-mbox-file", "message": "recovered-rfc5322-message"}
METHODS = {"mbox": "none", "raw": "none", "semantic": "selected-headers-relaxed-and-body"}
COLUMNS, TABLE_HEAD = ["ordinal", "message-id-json", "hashes..."], "ordinal\tmessage-id\thashes"
REQUIRED = [("h1", "sha256", "mbox"), ("h2", "sha256", "raw"), ("h3", "sha256", "semantic")]
ID_PREFIX = "tag:lettermill,2026:hash"


@dataclass(frozen=True)
class Standard:
    code: str
    algorithm: str
    standard: str
    scope: str


def declaration(code: str, algorithm: str, standard: str, prefix: str = ID_PREFIX) -> dict:
    return {"code": code, "digest_algorithm": algorithm, "hash_standard": standard, "hash_version": 1, "id": f"{prefix}/{standard}/v1/{algorithm}", "input": INPUTS[SCOPES[standard]], "canonicalization": {"method": METHODS[standard]}, "scope": SCOPES[standard], "type": "hash-standard"}


def parse_standards(lines: list[str], prefix: str = ID_PREFIX) -> list[Standard]:
    """The standards of declaration lines, in order; another form, code, algorithm, scope, id, input or canonical form is an error. A declaration may say `same_input_as` an earlier one of its standard in place of input and canonical form."""
    found: list[Standard] = []
    own: set[str] = set()
    for line in lines:
        r = strict_json(line)
        if not isinstance(r, dict) or r.get("type") != "hash-standard":
            raise ValueError("not a declaration of a hash standard")
        code, algorithm, standard = r.get("code"), r.get("digest_algorithm"), r.get("hash_standard")
        if code != f"h{len(found) + 1}":
            raise ValueError("codes must be h1, h2, ... in order")
        if algorithm not in ALGORITHMS:
            raise ValueError(f"{code}: digest algorithm {algorithm} is not known")
        if standard not in SCOPES or r.get("hash_version") != 1 or isinstance(r.get("hash_version"), bool):
            raise ValueError(f"{code}: hash standard is not known")
        if r.get("scope") != SCOPES[standard]:
            raise ValueError(f"{code}: wrong scope")
        want = declaration(code, algorithm, standard, prefix)
        if r.get("id") != want["id"]:
            raise ValueError(f"{code}: wrong id")
        same = r.get("same_input_as")
        if same is None:
            if r.get("input") != want["input"] or r.get("canonicalization") != want["canonicalization"]:
                raise ValueError(f"{code}: input or canonical form is not known")
            own.add(code)
        elif same not in own or next(s for s in found if s.code == same).standard != standard:
            raise ValueError(f"{code}: wrong same_input_as")
        found.append(Standard(code, algorithm, standard, SCOPES[standard]))
    return found


def parse_token(token: object, standards: list[Standard]) -> tuple[Standard, str]:
    """(standard, digest) of a token `code:digest`."""
    code, mark, digest = token.partition(":") if isinstance(token, str) else ("", "", "")
    standard = next((s for s in standards if s.code == code), None)
    if not mark or standard is None or not re.fullmatch("[0-9a-f]+", digest) or len(digest) != ALGORITHMS[standard.algorithm]:
        raise ValueError(f"invalid hash token {token}")
    return standard, digest


def _controls(mailbox: str, size: int, sha256: str, messages: int, prefix: str) -> list[str]:
    records = [
        {"format": f"{prefix}/manifest", "format_version": 1, "manifest_id": f"h1:{sha256}", "type": "integrity-manifest"}, *(declaration(*r, prefix) for r in REQUIRED),
        {"bytes": size, "hashes": [f"h1:{sha256}"], "messages": messages, "name": mailbox, "type": "mbox"}, {"columns": COLUMNS, "encoding": "tsv", "type": "message-table"},
    ]
    return [canonical_json(r) for r in records] + [TABLE_HEAD]


def manifest_lines(records: DataFrame, files: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """(mailbox, at, line): the lines of each mailbox's manifest; control lines come before at = 1, rows are numbered by the record's place. records: (mailbox, position, record, message_id, sha256, semantic_sha256); files: (mailbox, bytes, sha256)."""
    placed = records.select("mailbox", "position", "message_id", "sha256", "semantic_sha256").join(sinks.locations(records).select("mailbox", "position", "ordinal"), ["mailbox", "position"])
    quoted = F.to_json(F.array("message_id"))
    rows = placed.select("mailbox", F.col("ordinal").cast("long").alias("at"), F.concat_ws("\t", F.col("ordinal").cast("string"), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.concat(F.lit("h2:"), "sha256"), F.concat(F.lit("h3:"), "semantic_sha256")).alias("line"))
    counted = files.join(placed.groupBy("mailbox").agg(F.count(F.lit(1)).alias("messages")), "mailbox", "left").fillna(0, ["messages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r["mailbox"], k, line) for r in b.to_pylist() for k, line in enumerate(_controls(r["mailbox"], r["bytes"], r["sha256"], r["messages"], prefix), -len(REQUIRED) - 3)]
            cols = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["mailbox", "at", "line"])

    return rows.unionByName(counted.select("mailbox", "bytes", "sha256", "messages").mapInArrow(run, "mailbox string, at long, line string"))


def write_manifests(lines: DataFrame, path: str) -> None:
    """A folder for each mailbox, whose part files in order of their names are its manifest; nothing is overwritten."""
    lines = cut(lines)  # the bounds of the ranges are of these rows
    lines.repartitionByRange("mailbox", "at").sortWithinPartitions("mailbox", "at").select("mailbox", F.col("line").alias("value")).write.mode("errorifexists").partitionBy("mailbox").text(path)


def manifest_faults(lines: DataFrame, files: DataFrame, records: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """(mailbox, ordinal, fault) of manifests (mailbox, at from 1, line) against files (mailbox, bytes, sha256) and stored records (mailbox, ordinal, record). ordinal: null where the fault is the mailbox's own.

    Control lines, the mailbox's size, digest and number of messages, and the rows' form and order are checked; then each record's readings (`verify.record_faults`).
    """
    heads = len(REQUIRED) + 4
    top = lines.filter(F.col("at") <= heads).groupBy("mailbox").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("top"))  # a few lines of each
    row = r'^([0-9]+)\t("(?:[^"\\]|\\.)*")\th2:([0-9a-f]{64})\th3:([0-9a-f]{64})$'
    part = lambda k: F.regexp_extract("line", row, k)
    rows = lines.filter(F.col("at") > heads).select("mailbox", (F.col("at") - heads).cast("int").alias("nth"), (part(1) != "").alias("sound"), part(1).cast("int").alias("ordinal"), part(3).alias("sha256"), part(4).alias("semantic_sha256"))
    n = rows.groupBy("mailbox").agg(F.count(F.lit(1)).alias("rows"))
    both = files.join(top, "mailbox", "full_outer").join(n, "mailbox", "left").select("mailbox", F.col("bytes").alias("size"), "sha256", "top.line", F.coalesce("rows", F.lit(0)).alias("rows"))

    def faults(r: dict) -> Iterator[str]:
        if r["sha256"] is None:
            yield "manifest without a mailbox"
            return
        if r["line"] is None:
            yield "mailbox without a manifest"
            return
        try:
            if len(r["line"]) < heads or r["line"][-1] != TABLE_HEAD:
                raise ValueError("control lines are not complete")
            first, *declared, box, table = r["line"][:-1]
            standards = parse_standards(declared, prefix)
            if [(s.code, s.algorithm, s.standard) for s in standards] != REQUIRED:
                raise ValueError("required standards are not declared")
            first, box = strict_json(first), strict_json(box)
            if first.get("type") != "integrity-manifest" or first.get("format_version") != 1 or strict_json(table) != {"columns": COLUMNS, "encoding": "tsv", "type": "message-table"}:
                raise ValueError("format is not known")
            if box.get("type") != "mbox" or box.get("name") != r["mailbox"]:
                raise ValueError("wrong mailbox record")
            (digest,) = [parse_token(t, standards)[1] for t in box["hashes"]]
            if first.get("manifest_id") != f"h1:{digest}":
                raise ValueError("manifest id is not the mailbox's digest")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            yield str(e)
            return
        for what, told, found in (("bytes", box.get("bytes"), r["size"]), ("digest", digest, r["sha256"]), ("messages", box.get("messages"), r["rows"])):
            if told != found:
                yield f"{what} differ"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r["mailbox"], None, f) for r in b.to_pylist() for f in faults(r)]
            cols = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["mailbox", "ordinal", "fault"])

    own = both.mapInArrow(run, "mailbox string, ordinal int, fault string")
    form = rows.filter("NOT sound OR ordinal IS NULL OR ordinal <> nth").select("mailbox", F.col("nth").alias("ordinal"), F.when(F.col("sound"), "rows are not in order").otherwise("malformed row").alias("fault"))
    stored = record_faults(rows.filter("sound").select("mailbox", "ordinal", "sha256", "semantic_sha256"), records)
    return own.unionByName(form).unionByName(stored)


def numbered_lines(spark, path: str) -> DataFrame:
    """(mailbox, at, line) of what `write_manifests` wrote: part files in order of their names, lines in order within them."""
    lines = spark.read.text(path).select("mailbox", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    # a mailbox may fill many files: each is numbered on its own, behind the sum of those before it
    sizes = lines.groupBy("mailbox", "file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("mailbox").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.select("mailbox", "file", "block", F.coalesce(before, F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("mailbox", "file", "block").orderBy("id"))
    return lines.withColumn("own", own).join(ahead, ["mailbox", "file", "block"]).select("mailbox", (F.col("own") + F.col("ahead")).cast("long").alias("at"), "line")
