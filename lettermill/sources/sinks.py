"""Writers of archive files: tables of rows in parts, manifests, mailboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import escape_path


def split_rows(rows: DataFrame, order: str, per_file: int = 100_000) -> DataFrame:
    """rows with `file`, the number (from 0) of the part that a row falls into, `per_file` to a part in the given order.

    Ranks come from sorted range partitions and the sums of their sizes, so no task sees all rows. The result is
    materialised between the two passes, as a range partitioning need not come out alike twice.
    """
    spark = rows.sparkSession
    from lettermill.tables import cut

    placed = cut(rows.repartitionByRange(order).select("*", F.spark_partition_id().alias("_part")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row for each partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_part"], total))
        total += r["n"]
    from pyspark.sql import Window

    base = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_part int, _start long"))  # a row for each partition
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    found = placed.withColumn("_n", nth).join(base, "_part")
    return found.withColumn("file", F.floor((F.col("_start") + F.col("_n") - 1) / per_file).cast("long")).drop("_part", "_n", "_start")


def manifest_lines(files: DataFrame) -> DataFrame:
    """(line): SHA-256, two blanks and the escaped path of files (path, content binary)."""
    return files.select(F.concat(F.sha2("content", 256), F.lit("  "), escape_path(F.col("path"))).alias("line"))


def write_csv(rows: DataFrame, path: str, order: str, per_file: int = 100_000) -> None:
    """One folder for each part, CRLF line ends, a header, and no overwriting."""
    split_rows(rows, order, per_file).write.mode("errorifexists").option("header", True).option("lineSep", "\r\n").partitionBy("file").csv(path)


def mailbox_name(date, category):
    """`1999-Archive1.mbox` of a date and category; quarantined mail goes to one file of its own."""
    return F.when(category == "INFECTED", F.lit("INFECTED1.mbox")).otherwise(F.concat(F.year(date).cast("string"), F.lit("-"), category, F.lit("1.mbox")))


def framed(messages: DataFrame) -> DataFrame:
    """messages (position, date, category, sender, raw[, envelope]) with `mailbox` and `record`, the bytes to be stored."""
    from collections.abc import Iterator

    import pyarrow as pa

    from lettermill.functions.storage import envelope, stored

    rows = messages.withColumn("mailbox", mailbox_name(F.col("date"), F.col("category"))).withColumn("record", F.lit(None).cast("binary"))
    given = "envelope" in messages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("envelope").to_pylist() if given else [None] * b.num_rows
            out = [stored(raw, e or envelope(raw, date, sender)) for raw, e, date, sender in zip(b.column("raw").to_pylist(), held, b.column("date").to_pylist(), b.column("sender").to_pylist(), strict=True)]
            yield b.set_column(b.schema.get_field_index("record"), "record", pa.array(out, pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def locations(records: DataFrame) -> DataFrame:
    """(mailbox, position, ordinal, byte_offset, byte_length): where each record stands when a mailbox's records follow one another, a blank line between."""
    from pyspark.sql import Window

    from lettermill.tables import cut

    lengths = records.select("mailbox", "position", F.length("record").cast("long").alias("byte_length"))
    placed = cut(cut(lengths).repartitionByRange(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mailbox", "position").withColumn("_part", F.spark_partition_id()))
    # a mailbox may fill many ranges: each is summed on its own, then come the sums of those before it
    before = Window.partitionBy("mailbox").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("mailbox", "_part").agg(F.sum(F.col("byte_length") + 1).alias("b"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("mailbox", "_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows"))
    own = Window.partitionBy("mailbox", "_part").orderBy("position")
    offset = F.coalesce(F.sum(F.col("byte_length") + 1).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_bytes")
    rows = placed.join(sums, ["mailbox", "_part"])
    return rows.select("mailbox", "position", (F.row_number().over(own) + F.col("_rows")).cast("int").alias("ordinal"), offset.alias("byte_offset"), "byte_length")


def write_mailboxes(records: DataFrame, path: str) -> None:
    """A folder for each mailbox; its part files, put together in order of their names, are the mailbox. Nothing is overwritten."""
    from lettermill.tables import cut

    # the bounds of ranges need a look at the rows, which are not made twice for it
    ordered = cut(records.select("mailbox", "position", "record")).repartitionByRange("mailbox", "position").sortWithinPartitions("mailbox", "position")
    ordered.select("mailbox", F.col("record").cast("string").alias("value")).write.mode("errorifexists").partitionBy("mailbox").text(path)


def integrity_rows(records: DataFrame) -> DataFrame:
    """(mailbox, ordinal, line): a tab-separated manifest row of each record (position, message_id, sha256, semantic_sha256)."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("mailbox").orderBy("position"))
    rows = records.select("mailbox", nth.alias("ordinal"), "message_id", "sha256", "semantic_sha256")
    return rows.select("mailbox", "ordinal", F.concat_ws("\t", F.col("ordinal").cast("string"), F.to_json(F.array("message_id")).substr(F.lit(2), F.length(F.to_json(F.array("message_id"))) - 2), F.concat(F.lit("h2:"), "sha256"), F.concat(F.lit("h3:"), "semantic_sha256")).alias("line"))


def oxum(files: DataFrame) -> DataFrame:
    """(oxum): bytes and number of payload files (path, length), as `bytes.files`."""
    return files.agg(F.concat_ws(".", F.coalesce(F.sum("length"), F.lit(0)).cast("string"), F.count(F.lit(1)).cast("string")).alias("oxum"))


def write_mbox(messages: DataFrame, path: str) -> None:
    """Messages (position, raw) as one mailbox: a new folder whose part files, in order of their names, are the mailbox; nothing is overwritten."""
    rows = messages.select("position", "raw", F.lit(None).cast("timestamp_ntz").alias("date"), F.lit("Archive").alias("category"), F.lit("").alias("sender"))
    framed(rows).repartitionByRange("position").sortWithinPartitions("position").select(F.col("record").cast("string").alias("value")).write.mode("errorifexists").text(path)
