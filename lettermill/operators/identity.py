"""Evidence of identity: who stands in a message's header fields, what marks it as list or automatic mail, and the signature below its text. One parse of a message feeds all relations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import mail, signature
from lettermill.functions.view import struct_lists
from lettermill.tables import cut

# The header fields with people, and those that mark list and automatic mail.
ROLES = ("from", "to", "cc", "bcc")
MARKERS = ("List-Id", "List-Post", "List-Unsubscribe", "Mailing-List", "Precedence", "Auto-Submitted", "X-BeenThere", "Sender", "Reply-To")
_MARKERS = tuple(map(str.lower, MARKERS))
_pick = mail.picker((*ROLES, *_MARKERS))
_PERSON = pa.struct([("role", pa.string()), ("ordinal", pa.int32()), ("address", pa.string()), ("display_name", pa.string())])
_MARKER = pa.struct([("header", pa.string()), ("ordinal", pa.int32()), ("value", pa.string())])
PARSED = "pk long, sha256 string, people array<struct<role: string, ordinal: int, address: string, display_name: string>>, markers array<struct<header: string, ordinal: int, value: string>>, body string, error string"


def _one(raw: bytes, expected: str | None) -> tuple:
    digest = hashlib.sha256(raw).hexdigest()
    if expected is not None and expected != digest:
        raise ValueError("digest differs from the catalogue")
    if (picked := _pick(raw)) is not None:
        found, body = picked
        values, body = (lambda name: found.get(name, ())), mail.decode(body)[0]
    else:
        m = mail.message(raw)
        values, body = (lambda name: m.get_all(name, [])), mail.preferred_text(m)
    text = lambda v: mail.header_text(str(v).encode("utf-8", "surrogateescape"))[0].strip()
    people = [(role, k, a.strip().casefold(), text(name) if name else "") for role in ROLES for k, (name, a) in enumerate(mail.addresses(values(role))) if a.strip()]
    markers = [(name, k, text(v)) for name in _MARKERS for k, v in enumerate(values(name))]
    return digest, people, markers, body, None


def extracted(messages: DataFrame) -> DataFrame:
    """PARSED of messages (pk, raw[, sha256, which must agree]): one parse of each. A message that can't be read is a row with `error`."""
    rows = messages.select(F.col("pk").cast("long").alias("pk"), "raw", (F.col("sha256") if "sha256" in messages.columns else F.lit(None).cast("string")).alias("expected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, people, markers, bodies, errors, n_people, n_markers = ([] for _ in range(7))
            for raw, expected in zip(b.column("raw").to_pylist(), b.column("expected").to_pylist(), strict=True):
                try:
                    digest, p, m, body, error = _one(raw or b"", expected)
                except Exception as e:  # noqa: BLE001  of any kind: the row tells which
                    digest, p, m, body, error = expected, [], [], None, f"{type(e).__name__}: {e}"
                digests.append(digest)
                people += p
                n_people.append(len(p))
                markers += m
                n_markers.append(len(m))
                bodies.append(body)
                errors.append(error)
            columns = [b.column("pk"), pa.array(digests, pa.string()), struct_lists(people, n_people, pa.list_(_PERSON)), struct_lists(markers, n_markers, pa.list_(_MARKER)), pa.array(bodies, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["pk", "sha256", "people", "markers", "body", "error"])

    return rows.mapInArrow(run, PARSED)


def evidence(bodies: DataFrame) -> DataFrame:
    """(pk, kind, confidence, start_line, end_line, lines) of bodies (pk, body) that end in a signature block; in columns, without Python."""
    # the number keeps the filter where it is: pushed down, its condition would hold all of the block's expressions again, at each level below
    found = signature.with_block(bodies.select("pk", "body")).withColumn("_row", F.monotonically_increasing_id())
    return found.filter("block IS NOT NULL AND _row >= 0").select("pk", "block.*")


def facts(found: DataFrame) -> DataFrame:
    """(pk, ordinal, line, kind, value, normalized, confidence) of `evidence`: texts, addresses, links, numbers and the first line that may be a name."""
    each = F.flatten(F.transform(F.transform("lines", signature.stripped), lambda x, i: signature.line_facts(x, i, F.col("confidence"))))
    first = F.array_min(F.transform(F.filter("f", lambda f: f["kind"] == "name-candidate"), lambda f: f["line"]))
    kept = found.select("pk", each.alias("f")).withColumn("name", first)
    kept = kept.select("pk", F.posexplode(F.filter("f", lambda f: (f["kind"] != "name-candidate") | (f["line"] == F.col("name")))).alias("ordinal", "f"))
    return kept.select("pk", "ordinal", "f.*")


def observations(parsed: DataFrame) -> DataFrame:
    """(pk, role, ordinal, address, display_name, normalized_name): people of the header fields, in order."""
    each = parsed.select("pk", F.explode("people").alias("p")).select("pk", "p.*")
    return each.withColumn("normalized_name", signature.normalized(F.col("display_name")))


def markers(parsed: DataFrame) -> DataFrame:
    return parsed.select("pk", F.explode("markers").alias("m")).select("pk", "m.*")


TABLES = ("messages", "header_observations", "message_markers", "signature_blocks", "signature_facts", "extraction_errors")


def relations(messages: DataFrame) -> dict[str, DataFrame]:
    """TABLES of messages (pk, raw[, sha256]), from one parse that is written once."""
    parsed = cut(extracted(messages))
    good = parsed.filter("error IS NULL")
    blocks = evidence(good)
    found = (good.select("pk", "sha256"), observations(good), markers(good), blocks, facts(blocks), parsed.filter("error IS NOT NULL").select("pk", "sha256", "error"))
    return dict(zip(TABLES, found, strict=True))


def merge(messages: DataFrame, shard: str, root: str) -> None:
    """Evidence of one shard's messages into the tables below root: what a shard had before is replaced, so that a run may be repeated; other shards aren't touched."""
    tables = relations(messages)
    tables["signature_blocks"] = cut(tables["signature_blocks"])  # found once, for themselves and for the facts in them
    tables["signature_facts"] = facts(tables["signature_blocks"])
    for name, rows in tables.items():
        write = lambda t, name=name: t.withColumn("shard", F.lit(shard)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{root}/{name}")
        seen = Observation()
        write(rows.observe(seen, F.count(F.lit(1)).alias("n")))  # the shard is a plain constant, as the writer would sort by anything else
        if not seen.get["n"]:
            # a shard without rows leaves nothing behind either: it gets one row of nulls, which `read` passes over
            write(rows.sparkSession.range(1, numPartitions=1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").filter("pk IS NOT NULL")


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(messages, errors, header_observations, message_markers, distinct_addresses, distinct_nonempty_names, signature_blocks, signature_facts) of TABLES."""
    n = lambda t, name: tables[t].agg(F.count(F.lit(1)).alias(name))
    people = tables["header_observations"].agg(F.count(F.lit(1)).alias("header_observations"), F.count_distinct("address").alias("distinct_addresses"), F.count_distinct(F.nullif("normalized_name", F.lit(""))).alias("distinct_nonempty_names"))
    rows = [people, n("messages", "messages"), n("extraction_errors", "errors"), n("message_markers", "message_markers"), n("signature_blocks", "signature_blocks"), n("signature_facts", "signature_facts")]
    long = rows[0].select(F.explode(F.create_map(*[x for c in rows[0].columns for x in (F.lit(c), F.col(c))])).alias("name", "n"))
    for r in rows[1:]:
        long = long.unionByName(r.select(F.lit(r.columns[0]).alias("name"), F.col(r.columns[0]).alias("n")))
    names = ("messages", "errors", "header_observations", "message_markers", "distinct_addresses", "distinct_nonempty_names", "signature_blocks", "signature_facts")
    return long.agg(*[F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in names])


def requests(cases: DataFrame, model: str) -> DataFrame:
    """(id, body): a request of each case (pk, prompt) under an id that its content fixes."""
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.col("prompt").alias("input")))
    return cases.select(F.sha2(F.concat(F.col("pk").cast("string"), F.lit("\n"), body), 256).alias("id"), body.alias("body"))


def correlate(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """(id, answer): answers by id in any order; unknown, repeated and missing ids are errors."""
    one = answered.groupBy("id").agg(F.min("answer").alias("answer"), F.count(F.lit(1)).alias("n"))
    both = asked.select("id", F.lit(True).alias("asked")).join(one, "id", "full_outer")
    wrong = F.when(F.col("asked").isNull(), "unknown result ").when(F.col("n").isNull(), "missing result ").when(F.col("n") > 1, "repeated result ")
    return both.select("id", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col("id"))).cast("string")).otherwise(F.col("answer")).alias("answer"))
