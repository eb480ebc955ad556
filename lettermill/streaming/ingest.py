"""Incremental ingest: containers of any size are read by ranges, deduplicated against the archive and appended; a container's checkpoint is written last, and only if it has stayed as it was."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.functions.mail import parsed, with_date
from lettermill.functions.text import path_year
from lettermill.operators.archive import changed_sources
from lettermill.operators.ingest import decide, inherit_dates, resume_after
from lettermill.sources import mail
from lettermill.tables import cut

MESSAGE = "container string, position long, message_id string, sha256 string, semantic_sha256 string, sender string, subject string, date timestamp_ntz, date_source string, autosave boolean, exclusion string, disposition string, batch long"
CONTAINER = "path string, kind string, length long, sha256 string, batch long, seen timestamp"
RUN = "batch long, containers long, records long, bytes long, errors long, changed long"
KINDS = ("mbox", "babyl", "emlx", "eml")


def empty(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("append").parquet(path)


def narrow(records: DataFrame, permissive: bool = False) -> DataFrame:
    """What the catalogue needs of records (mail.RECORD), read once."""
    read = with_date(parsed(records.filter("raw IS NOT NULL"), permissive=permissive).filter("m IS NOT NULL"))
    return cut(read.select("container", "position", "m.message_id", "m.sha256", "m.semantic_sha256", "m.sender", "m.subject", "m.autosave", "exclusion", "own_date", "date_source"))


def observe(read: DataFrame, cursors: DataFrame, archive: DataFrame, batch: int) -> DataFrame:
    """Observations (MESSAGE) of `narrow` rows, in the order container, position.

    cursors: (container, cursor) of containers that are read from there on: their first undated messages inherit from the archive. Excluded, then autosaved, then messages that the archive or an earlier record has by id and raw hash (duplicate); the rest is archived.
    """
    year = F.coalesce(path_year(F.col("container")), F.lit(1970))
    kept = read.filter("exclusion IS NULL").select("container", "position", "own_date", year.alias("path_year"))
    # a resumed mailbox goes on from the last date that is catalogued before it
    dated = archive.filter("date IS NOT NULL AND exclusion IS NULL").select("container", "position", F.col("date").alias("own_date"))
    history = resume_after(dated, cursors)
    dates = inherit_dates(kept, history).withColumnRenamed("date_source", "how")
    rows = read.drop("own_date").join(dates, ["container", "position"], "left")
    rows = rows.withColumn("date_source", F.coalesce("date_source", "how")).drop("how")
    fresh = F.col("exclusion").isNull() & ~F.col("autosave")
    known = archive.filter("disposition = 'archived'").select("message_id", "sha256").distinct().withColumn("known", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("message_id", "sha256", fresh).orderBy("container", "position"))
    rows = rows.withColumn("nth", nth).join(known, ["message_id", "sha256"], "left")
    disposition = F.when(F.col("exclusion").isNotNull(), "source-metadata-excluded").when(F.col("autosave"), "autosave-excluded").when(F.col("known") | (F.col("nth") > 1), "duplicate").otherwise("archived")
    found = rows.withColumn("disposition", disposition).withColumn("batch", F.lit(batch).cast("long"))
    return found.select("container", "position", "message_id", "sha256", "semantic_sha256", "sender", "subject", "date", "date_source", "autosave", "exclusion", "disposition", "batch")


def pending(listed: DataFrame, known: DataFrame) -> DataFrame:
    """(path, kind, length, sha256, start) of listed files (path, length, modified) that must be read: from `start` on, which is behind what is known of a mailbox that grew by whole records, and 0 for all others."""
    last = known.groupBy("path").agg(F.max(F.struct("seen", "batch", "kind", "length", "sha256")).alias("k")).select("path", "k.kind", "k.length", "k.sha256")
    found = cut(mail.checked(listed, last).filter(F.col("kind").isin(*KINDS)))
    start = F.when((F.col("decision") == "resume") & (F.col("kind") == "mbox") & F.col("seam"), F.col("was")).otherwise(F.lit(0))
    return found.join(decide(found, last), "path").filter("decision <> 'skip'").select("path", "kind", "length", "sha256", start.cast("long").alias("start"))


def _seen():
    return F.lit(datetime.now(timezone.utc)).cast("timestamp")


def ingest(spark: SparkSession, source: str, target: str, batch: int, permissive: bool = False, split: int = mail.SPLIT) -> int:
    """Read what is new or changed below `source` into `target`: messages, containers and runs; the number of containers read. A second run reads nothing.

    A container that is not the same after it was read keeps its old checkpoint, so the next run reads it again; the messages that it brings again are duplicates then.
    """
    empty(spark, f"{target}/messages", MESSAGE)
    empty(spark, f"{target}/containers", CONTAINER)
    known = spark.read.schema(CONTAINER).parquet(f"{target}/containers")
    listed = cut(mail.files(spark, source))
    todo = cut(pending(listed, known))
    n = todo.count()
    if n:
        counted = Observation()
        records = mail.records(todo.select("path", "length", "start"), permissive, split)
        records = records.observe(counted, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("error").alias("errors"))
        read = narrow(records, permissive)
        archive = spark.read.schema(MESSAGE).parquet(f"{target}/messages")
        cursors = todo.filter("start > 0").select(F.col("path").alias("container"), F.col("start").alias("cursor"))
        observe(read, cursors, archive, batch).write.mode("append").parquet(f"{target}/messages")
        touched = cut(changed_sources(listed.join(todo, "path", "left_semi"), mail.files(spark, source)).filter("change <> 'new'"))
        done = todo.join(touched, "path", "left_anti")
        done.select("path", "kind", "length", "sha256", F.lit(batch).cast("long").alias("batch"), _seen().alias("seen")).write.mode("append").parquet(f"{target}/containers")
        c = counted.get
        spark.createDataFrame([(batch, n, c["records"], c["bytes"], c["errors"], touched.count())], RUN).write.mode("append").parquet(f"{target}/runs")
    return n


def start(spark: SparkSession, source: str, target: str, checkpoint: str, split: int = mail.SPLIT):
    """A streaming query over what is new below `source`, tails of grown mailboxes included (`sources.mail`). Each micro-batch is appended once, under a negative batch number, so that it never is one of `ingest`'s; what it has read, `ingest` reads no more."""
    empty(spark, f"{target}/messages", MESSAGE)
    empty(spark, f"{target}/containers", CONTAINER)
    mail.register(spark)
    stream = spark.readStream.format("mail").option("permissive", "true").option("split", split).load(source)

    def write(records: DataFrame, batch: int) -> None:
        number = -1 - batch
        there = lambda table, schema: not spark.read.schema(schema).parquet(f"{target}/{table}").filter(F.col("batch") == number).isEmpty()
        if there("containers", CONTAINER):
            return
        if not there("messages", MESSAGE):
            read = narrow(records, permissive=True)
            archive = spark.read.schema(MESSAGE).parquet(f"{target}/messages")
            cursors = read.groupBy("container").agg(F.min("position").alias("cursor"))
            observe(read, cursors, archive, number).write.mode("append").parquet(f"{target}/messages")
        found = records.select(F.col("container").alias("path"), "length").distinct()
        done = mail.checked(found, spark.createDataFrame([], "path string, length long")).filter("sha256 IS NOT NULL")
        done.select("path", "kind", "length", "sha256", F.lit(number).cast("long").alias("batch"), _seen().alias("seen")).write.mode("append").parquet(f"{target}/containers")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
