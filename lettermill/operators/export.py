"""Address books, listings of owners, run histories and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.operators.reports import owner_rule

# The longest line of an address book, seconds after which a silent run is stale, and file names that may be opened without asking.
LONGEST_LINE, STALE_SECONDS = 900, 60
SAFE_SUFFIXES = {"text/plain": [".txt", ".text", ".log"], "application/pdf": [".pdf"], "image/png": [".png"], "image/jpeg": [".jpg", ".jpeg"], "image/gif": [".gif"]}


def line_error(address: Column) -> Column:
    """Why an address can't stand on a line of an address book; null if it can."""
    entity = address.rlike(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    return (
        F.when(address == "", "empty address").when(address.startswith("--"), "delimiter prefix").when(address.rlike(r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]"), "control or non-printing character")
        .when(entity, "character entity").when(~address.contains("@") & address.rlike("[&<>\"']"), "needs escaping").when(F.length(address) > LONGEST_LINE, "too long")
    )


def address_book(messages: DataFrame, recipients: DataFrame) -> DataFrame:
    """(address, is_owner, spellings, fault): every referenced address, trimmed and lower case, owners of sent mail marked; spellings counts what fell together; faulty ones carry a reason."""
    used = messages.select(F.col("sender").alias("original"), (F.col("category") == "Sent").alias("owner")).union(recipients.select("address", F.lit(False)))
    found = used.select(F.lower(F.trim("original")).alias("address"), "original", "owner").groupBy("address").agg(F.bool_or("owner").alias("owner"), F.count_distinct("original").alias("spellings"))
    fault = line_error(F.col("address"))
    return found.select("address", (F.col("owner") & F.col("address").contains("@") & fault.isNull()).alias("is_owner"), "spellings", fault.alias("fault")).orderBy(F.desc("is_owner"), "address")


def detected_owners(messages: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """(address, messages): senders that the owner rules match, by address."""
    found = messages.filter(owner_rule(F.col("sender"), include, exclude)).groupBy(F.lower(F.trim("sender")).alias("address")).agg(F.count(F.lit(1)).alias("messages"))
    return found.orderBy("address")


STATUS = "run string, state string, phase string, started_at timestamp, updated_at timestamp, messages long"


def history(spark: SparkSession, path: str) -> DataFrame:
    """Status files, one JSON object each, newest first; unreadable ones keep their text in `error`."""
    found = spark.read.schema(f"{STATUS}, error string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "error").option("multiLine", "true").json(path)
    return found.orderBy(F.desc_nulls_last("started_at"), F.desc("run"))


def effective(status: DataFrame, now: Column | None = None) -> DataFrame:
    """Running states without a sign of life for STALE_SECONDS become stale."""
    lost = (F.col("state") == "running") & (F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("updated_at") > STALE_SECONDS)
    return status.withColumn("phase", F.when(lost, "status heartbeat lost").otherwise(F.col("phase"))).withColumn("state", F.when(lost, "stale").otherwise(F.col("state")))


def within_budget(artifacts: DataFrame, order: str, size: str, budget: int, *groups: str) -> DataFrame:
    """artifacts with `total`, the sizes so far in order, and `fits`."""
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return artifacts.withColumn("total", F.sum(size).over(w)).withColumn("fits", F.col("total") <= budget)


def is_risky(mime: Column, filename: Column) -> Column:
    """Not both a harmless type and a suffix of that type."""
    suffix = F.lower(F.regexp_extract(filename, r"(\.[^./\\]*)$", 1))
    safe = F.lit(False)
    for kind, suffixes in SAFE_SUFFIXES.items():
        safe = safe | ((F.lower(mime) == kind) & suffix.isin(*suffixes))
    return ~safe


def duration(seconds: Column) -> Column:
    """`1h 2m 3s`, whole seconds rounded up, leading zeros left out."""
    n = F.greatest(F.ceil(seconds), F.lit(0)).cast("long")
    h, m, s = F.floor(n / 3600), F.floor(n / 60) % 60, n % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def status_line(text: Column) -> Column:
    short = F.substring(F.regexp_replace(F.trim(text), r"\s+", " "), 1, 80)
    return F.when(short == "", "working").otherwise(short)


def format_of(path: Column, head: Column) -> Column:
    """babyl, mbox, pdf, text, empty or other, by the first bytes and the suffix."""
    h = head.cast("string")
    return (
        F.when(F.length(head) == 0, "empty").when(F.lower(F.substring(h, 1, 14)) == "babyl options:", "babyl").when(h.startswith("From "), "mbox").when(h.startswith("%PDF-"), "pdf")
        .when(F.lower(path).rlike(r"\.(txt|text)$"), "text").otherwise("other")
    )


def format_inventory(files: DataFrame) -> DataFrame:
    """(format, files, bytes) of files (path, length, content)."""
    kind = format_of(F.col("path"), F.substring("content", 1, 64))
    return files.groupBy(kind.alias("format")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").cast("long").alias("bytes"))


def audit(observed: DataFrame) -> DataFrame:
    """(year, date_source, messages, missing_senders, errors) of read messages (date, date_source, sender, error)."""
    return observed.groupBy(F.year("date").alias("year"), "date_source").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("sender") == "").alias("missing_senders"), F.count("error").alias("errors"))
