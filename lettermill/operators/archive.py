"""The archive as tables: reading by number, dictionaries and upserts, publication with its gates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.storage import recovered
from lettermill.operators.search import page
from lettermill.sources import stores
from lettermill.tables import cut


def lookup(asked: DataFrame, messages: DataFrame, locations: DataFrame, generations: DataFrame) -> DataFrame:
    """(pk, status, filename, offset, length, sha256) for each pk of asked: status ok, no-message or no-location.

    messages: (pk, sha256); locations: (pk, generation, offset, length); generations: (generation, filename).
    """
    there = locations.join(generations, "generation").select("pk", "filename", "offset", "length")
    found = asked.select("pk").distinct().join(messages.select("pk", "sha256", F.lit(True).alias("known")), "pk", "left").join(there, "pk", "left")
    status = F.when(F.col("known").isNull(), "no-message").when(F.col("filename").isNull(), "no-location").otherwise("ok")
    return found.select("pk", status.alias("status"), "filename", "offset", "length", "sha256")


#: Bytes between two records of a file that are read rather than skipped; of a file that one task reads in a go; of one read.
GAP, WINDOW, MOST_READ = 64 << 10, 256 << 20, 16 << 20


def _reading(stored: bytes, sha256: str) -> bytes | None:
    """The message with that digest in a record's stored bytes: as they stand, or in one of the forms in which mailboxes store it."""
    if not re.fullmatch("[0-9a-f]{64}", sha256 or ""):
        return None
    return stored if hashlib.sha256(stored).hexdigest() == sha256 else recovered(stored, sha256)


def read_records(found: DataFrame, containers: DataFrame) -> DataFrame:
    """(pk, status, raw): the located message of each row, read as `storage.recovered` does and checked against its digest: damaged if no reading has it. containers: (filename, content), small ones."""
    rows = found.join(containers, "filename", "left")
    stored = F.substring("content", F.col("offset") + 1, F.col("length"))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("content").isNull(), "no-container").otherwise("ok")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(pk, status, _reading(x, sha) if status == "ok" else None) for pk, status, x, sha in zip(*(b.column(c).to_pylist() for c in ("pk", "status", "stored", "sha256")), strict=True)]
            yield _read_batch(b.column("pk"), out)

    return rows.select("pk", status.alias("status"), F.when(status == "ok", stored).alias("stored"), "sha256").mapInArrow(run, _read_schema(found))


def _read_schema(found: DataFrame, more: str = "") -> str:
    return f"pk {found.schema['pk'].dataType.simpleString()}, status string, raw binary{more}"


def _read_batch(pks: pa.Array, out: list[tuple], **more: list[int]) -> pa.RecordBatch:
    status = ["damaged" if s == "ok" and raw is None else s for _, s, raw in out]
    return pa.RecordBatch.from_arrays([pks, pa.array(status, pa.string()), pa.array([raw for *_, raw in out], pa.binary()), *(pa.array(v, pa.int64()) for v in more.values())], names=["pk", "status", "raw", *more])


def read_ranges(found: DataFrame, gap: int = GAP, window: int = WINDOW) -> DataFrame:
    """(pk, status, raw, fetched): as `read_records`, from files of any size, of which only what is asked for is read. filename: a path that `sources.stores` opens.

    Requests meet by file and window of it, in order; those nearer than `gap` are one read of at most MOST_READ bytes (or one record). fetched: the bytes
    of such a read, at its first request. A file that isn't there: no-container. Beyond its end: damaged.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = found.withColumn("offset", F.col("offset").cast("long")).withColumn("length", F.col("length").cast("long"))
    dealt = asked.repartition(n, "filename", F.expr(f"offset div {window}"), F.when(F.col("status") != "ok", F.xxhash64("pk"))).sortWithinPartitions("filename", "offset", "pk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("pk", "status", "filename", "offset", "length", "sha256")), strict=True))
            out, fetched, k = [], [], 0
            while k < len(rows):
                pk, status, name, offset, length, sha = rows[k]
                if status != "ok":
                    out.append((pk, status, None))
                    fetched.append(0)
                    k += 1
                    continue
                end, last = offset + length, k + 1
                while last < len(rows) and rows[last][1:3] == (status, name) and rows[last][3] <= end + gap and max(end, rows[last][3] + rows[last][4]) - offset <= MOST_READ:
                    end, last = max(end, rows[last][3] + rows[last][4]), last + 1
                try:
                    data = stores.between(name, offset, end)
                except FileNotFoundError:
                    data = None
                for j in range(k, last):
                    pk, _, _, at, size, sha = rows[j]
                    stored = data[at - offset : at - offset + size] if data is not None else None
                    whole = stored is not None and len(stored) == size
                    out.append((pk, "ok" if data is not None else "no-container", _reading(stored, sha) if whole else None))
                    fetched.append(len(data or b"") if j == k else 0)
                k = last
            yield _read_batch(b.column("pk"), out, fetched=fetched)

    return dealt.mapInArrow(run, _read_schema(found, ", fetched long"))


def attachment_places(attachments: DataFrame, messages: DataFrame, locations: DataFrame, generations: DataFrame) -> DataFrame:
    """attachments (pk, ...) of messages that have a place, with filename and offset."""
    return attachments.join(messages.select("pk"), "pk", "left_semi").join(locations.select("pk", "generation", "offset"), "pk").join(generations, "generation").drop("generation")


def page_with_more(found: DataFrame, order: str, descending: bool, limit: int, offset: int = 0) -> DataFrame:
    """A page with has_more: one row more is asked for and, if it comes, only tells so."""
    key = F.lower(order) if order != "date" else F.col(order)
    by = [key.desc(), F.desc("pk")] if descending else [key.asc(), F.asc("pk")]
    rows = page(found, order, descending, limit + 1, offset)  # limit + 1 rows stand in the windows
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(*by))).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return rows.filter(F.col("place") <= limit).drop("place")


def recent_first(recent: DataFrame, whole: DataFrame, order: str, descending: bool, limit: int) -> DataFrame:
    """The page of the recent window if that fills it, else of all that is found."""
    first = cut(page(recent, order, descending, limit))
    return first if first.count() == limit else page(whole, order, descending, limit)


def newest(messages: DataFrame, n: int = 10_000) -> DataFrame:
    """The n newest messages, the window that a quick search tests."""
    return page(messages, "date", True, n)


def previews(spark, wanted: list[int], messages: DataFrame, previews_: DataFrame, most: int = 100) -> DataFrame:
    """(place, pk, subject, preview) in the order of the request, each once, at most `most`; messages without a preview have a null one."""
    order = list(dict.fromkeys(wanted))[:most]
    asked = spark.createDataFrame(list(enumerate(order, 1)), "place int, pk long")
    return F.broadcast(asked).join(messages.select("pk", "subject"), "pk").join(previews_.select("pk", "preview"), "pk", "left").select("place", "pk", "subject", "preview")


def numbered(rows: DataFrame, *order: str, start: int = 1, name: str = "number", ranges: int | None = None) -> DataFrame:
    """rows with consecutive numbers in this order. Ranges are sorted side by side; only their sizes, a row for each, are summed up."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before") + (start - 1)
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, at.cast("long")).drop("_range", "_before")  # `n` rows


def extend_dictionary(known: DataFrame, addresses: DataFrame) -> DataFrame:
    """(address_pk, address): the dictionary with the new addresses behind its last key; known keys stay."""
    fresh = addresses.select("address").filter("address IS NOT NULL").distinct().join(known, "address", "left_anti")
    last = known.agg(F.coalesce(F.max("address_pk"), F.lit(0))).first()[0]
    return known.select("address_pk", "address").unionByName(numbered(fresh, "address", start=last + 1, name="address_pk").select("address_pk", "address"))


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each key the row of the latest `at`; of equal ones the fresh row."""
    both = existing.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    others = [c for c in existing.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(at, "_fresh")).alias("r"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in existing.columns])


def append_evidence(existing: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """fresh with `ordinal`, counted on from each key's last one in existing (key, ordinal)."""
    last = existing.groupBy(key).agg(F.max("ordinal").alias("_last"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return fresh.join(last, key, "left").withColumn("ordinal", (n + F.coalesce("_last", F.lit(0))).cast("long")).drop("_last")


def without_messages(suggestions: DataFrame, seen: DataFrame, removed: DataFrame) -> DataFrame:
    """suggestions (address, display_name, messages, last_seen) after messages left the index. seen: (pk, date, address) of what is indexed; removed: (pk).

    Only addresses of removed messages are counted anew; those without a message left go.
    """
    touched = seen.join(removed.select("pk").distinct(), "pk", "left_semi").select("address").distinct()
    left = seen.join(removed.select("pk").distinct(), "pk", "left_anti").join(touched, "address", "left_semi")
    again = left.groupBy("address").agg(F.count_distinct("pk").alias("messages"), F.max("date").alias("last_seen"))
    names = suggestions.select("address", "display_name")
    return suggestions.join(touched, "address", "left_anti").unionByName(again.join(names, "address", "left").select("address", F.coalesce("display_name", F.lit("")).alias("display_name"), "messages", "last_seen"))


def changed_subjects(messages: DataFrame, read: DataFrame) -> DataFrame:
    """(pk, subject): subjects that read anew differ from the catalogued ones."""
    return read.select("pk", F.col("subject").alias("new")).join(messages.select("pk", "subject"), "pk").filter(~F.col("new").eqNullSafe(F.col("subject"))).select("pk", F.col("new").alias("subject"))


def totals(messages: DataFrame, locations: DataFrame) -> DataFrame:
    """(filename, messages, searchable): per file, and of all (filename null)."""
    rows = locations.select("pk", "filename").join(messages.select("pk", "category"), "pk")
    return rows.groupingSets([["filename"], []], "filename").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("category").isin("Archive", "Sent")).alias("searchable"))


def rebuild_gate(catalogued: DataFrame, counted: DataFrame, indexed: DataFrame, quarantined: DataFrame) -> DataFrame:
    """(filename, fault): what forbids to publish an index. catalogued, counted: (filename, records); indexed, quarantined: (filename, pk).

    A file's records must be as many as catalogued, indexed and quarantined ones together must be all of them, and no quarantined message may be indexed.
    """
    n = indexed.unionByName(quarantined.join(indexed.select("pk"), "pk", "left_anti").select(*indexed.columns)).groupBy("filename").agg(F.count_distinct("pk").alias("i"))
    both = catalogued.select("filename", F.col("records").alias("c")).join(counted.select("filename", F.col("records").alias("r")), "filename", "full_outer").join(n, "filename", "left")
    fault = F.when(F.col("c").isNull(), "not catalogued").when(F.col("r").isNull(), "missing").when(F.col("c") != F.col("r"), "record count differs").when(F.coalesce("i", F.lit(0)) != F.col("c"), "index count differs")
    leaked = indexed.join(quarantined.select("pk").distinct(), "pk", "left_semi").select("filename", F.lit("quarantined message indexed").alias("fault")).distinct()
    return both.select("filename", fault.alias("fault")).filter("fault IS NOT NULL").unionByName(leaked)


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): files (path, length, modified) that differ since they were read, so that their checkpoint must not be committed."""
    b, a = before.select("path", F.struct("length", "modified").alias("b")), after.select("path", F.struct("length", "modified").alias("a"))
    both = b.join(a, "path", "full_outer")
    change = F.when(F.col("a").isNull(), "gone").when(F.col("b").isNull(), "new").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def first_names(headers: DataFrame) -> DataFrame:
    """(pk, address, name): for each address of a message the first non-empty display name in header order, else ''. headers: (pk, ordinal, address, name)."""
    found = headers.filter("address <> ''").groupBy("pk", "address").agg(F.min_by("name", F.when(F.col("name") != "", F.col("ordinal"))).alias("name"))
    return found.select("pk", "address", F.coalesce("name", F.lit("")).alias("name"))


def volume_label(metadata: Column) -> Column:
    """A volume's label from its JSON: the label, else the mount path, else a constant."""
    of = lambda name: F.nullif(F.get_json_object(metadata, f"$.{name}"), F.lit(""))
    return F.coalesce(of("volume_label"), of("current_mount_path"), F.lit("Unknown source volume"))


# What a message without a usable sender may still be, and the other fields that name one, in order.
SENDER_FIELDS = ("sender", "reply_to", "return_path")


def missing_kind(rows: DataFrame) -> DataFrame:
    """rows (from_value, from_addresses, sender, reply_to, return_path: arrays of addresses; envelope, thread) with candidate_field, candidates and kind."""
    some = lambda c: F.coalesce(F.size(F.filter(c, lambda a: a != "")) > 0, F.lit(False))
    field = F.coalesce(*[F.when(some(c), F.lit(c)) for c in SENDER_FIELDS], F.lit(""))
    lists = F.coalesce(*[F.when(some(c), F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda a: a != ""), F.lower)))) for c in SENDER_FIELDS], F.array().cast("array<string>"))
    kind = (
        F.when(some("from_addresses"), "recoverable-from").when(field != "", "recoverable-fallback-header").when(F.coalesce("envelope", F.lit("")) != "", "recoverable-source-envelope")
        .when(F.col("thread").isNotNull(), "gmail-chat-or-export").when(F.col("from_value").isNotNull(), "invalid-from").otherwise("no-from-or-fallback")
    )
    return rows.withColumns({"candidate_field": field, "candidates": lists, "kind": kind})
