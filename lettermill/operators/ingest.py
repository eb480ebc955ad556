"""Ordered and incremental semantics of an ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inherit_dates(stream: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(container, position, date, date_source): a message without a date takes the resolved date before it in its container.

    stream: (container, position, own_date, path_year). The first of a container without any date before it takes the start
    of its path's year (source `path-year`); the others inherit (`previous-message`), from it too. history: (container, own_date), the
    last resolved date that is catalogued before the stream begins, which its first messages inherit.
    """
    if history is not None:
        first = history.filter("own_date IS NOT NULL").select("container", F.lit(-1).cast(stream.schema["position"].dataType).alias("position"), "own_date", F.lit(None).cast("int").alias("path_year"))
        return inherit_dates(stream.select("container", "position", "own_date", "path_year").unionByName(first)).filter("position >= 0")
    before = Window.partitionBy("container").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy("container").orderBy("position"))
    start = F.make_timestamp_ntz("path_year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) if hasattr(F, "make_timestamp_ntz") else F.concat(F.col("path_year").cast("string"), F.lit("-01-01")).cast("timestamp_ntz")
    rows = stream.select("container", "position", "own_date", F.when((nth == 1) & F.col("own_date").isNull(), start).alias("year_date"))
    given = F.coalesce("own_date", "year_date")
    source = F.when(F.col("own_date").isNotNull(), "date").when(F.col("year_date").isNotNull(), "path-year").otherwise("previous-message")
    return rows.select("container", "position", F.coalesce(given, F.last(given, ignorenulls=True).over(before)).alias("date"), source.alias("date_source"))


def neighbours(stream: DataFrame) -> DataFrame:
    """(container, position, previous, following): the nearest dated messages before and after each undated one, by strict position."""
    w = Window.partitionBy("container").orderBy("position")
    previous = F.last("own_date", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1))
    following = F.first("own_date", ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing))
    return stream.select("container", "position", "own_date", previous.alias("previous"), following.alias("following")).filter("own_date IS NULL").drop("own_date")


def first_occurrences(observed: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """observed with `disposition` (archived or duplicate) and the `winner`'s order key of its identity."""
    w = Window.partitionBy(*identity).orderBy(*order)
    first = F.first(F.col(order[-1])).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return observed.withColumn("disposition", F.when(F.row_number().over(w) == 1, "archived").otherwise("duplicate")).withColumn("winner", first)


def fair_order(work: DataFrame, *keys: str, order: str) -> DataFrame:
    """work with `turn`: round robin over the keys; run by (turn, order)."""
    return work.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def decide(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, decision): skip, resume or read.

    files: (path, kind, length, sha256, prefix_sha256) where prefix_sha256 is of the first known-length bytes; known: (path,
    kind, length, sha256). Same length and content: skip; grown, with the known content as prefix: resume; else read.
    """
    was = known.select("path", F.col("kind").alias("was_kind"), F.col("length").alias("was_length"), F.col("sha256").alias("was_sha256"))
    both = files.join(was, "path", "left")
    same = (F.col("kind") == F.col("was_kind")) & (F.col("length") == F.col("was_length")) & (F.col("sha256") == F.col("was_sha256"))
    grown = (F.col("kind") == F.col("was_kind")) & (F.col("length") > F.col("was_length")) & (F.col("prefix_sha256") == F.col("was_sha256"))
    return both.select("path", F.when(F.col("was_length").isNull(), "read").when(same, "skip").when(grown, "resume").otherwise("read").alias("decision"))


def resume_after(stream: DataFrame, cursors: DataFrame) -> DataFrame:
    """(container, position, own_date): the last catalogued message before each container's cursor."""
    at = stream.join(cursors, "container").filter(F.col("position") < F.col("cursor"))
    return at.groupBy("container").agg(F.max(F.struct("position", "own_date")).alias("m")).select("container", "m.position", "m.own_date")


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with `side`) that one of two snapshots has more often than the other; none: the inventory is stable."""
    return a.exceptAll(b).withColumn("side", F.lit("only first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only second")))


def register(candidates: DataFrame, identity: list[str], payload: str) -> DataFrame:
    """One row for each identity; conflicts between payloads of one identity are an error."""
    found = candidates.groupBy(*identity).agg(F.count_distinct(payload).alias("n"), F.min(payload).alias(payload))
    conflict = F.raise_error(F.concat(F.lit("conflicting registration of "), F.concat_ws(" ", *identity)))
    return found.select(*identity, F.when(F.col("n") > 1, conflict.cast("string")).otherwise(F.col(payload).cast("string")).alias(payload))


def counters(observed: DataFrame) -> DataFrame:
    """(year, disposition, messages, first_date, last_date, bytes) of observations (date, disposition, bytes)."""
    return observed.groupBy(F.year("date").alias("year"), "disposition").agg(F.count(F.lit(1)).alias("messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("bytes").cast("long").alias("bytes"))


def progress(files: DataFrame) -> DataFrame:
    """(percent, eta_seconds) of files (bytes_done, bytes_total, done, seconds): at most 99.9 until all are done."""
    s = files.agg(F.sum("bytes_done").cast("double").alias("a"), F.sum("bytes_total").cast("double").alias("b"), F.bool_and("done").alias("all"), F.max("seconds").cast("double").alias("t"))
    share = F.when(F.col("b") == 0, F.lit(0.0)).otherwise(F.col("a") / F.col("b"))
    percent = F.when(F.col("all"), F.lit(100.0)).otherwise(F.least(F.lit(99.9), 100 * share))
    return s.select(F.round(percent, 6).alias("percent"), F.when(F.col("a") > 0, F.round(F.col("t") * (F.col("b") - F.col("a")) / F.col("a"), 6)).alias("eta_seconds"))
