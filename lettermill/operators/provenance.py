"""Where messages came from: mailbox trees, selections, locations, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import prefixes


def tree(observed: DataFrame) -> DataFrame:
    """(volume, path, depth, messages): every folder and mailbox with the distinct messages at or below it; depth 0 is the volume.

    observed: (pk, volume, path). A parent counts a message once, however many of its mailboxes hold it.
    """
    each = observed.filter("pk IS NOT NULL").select("pk", "volume", F.explode(F.concat(F.array(F.lit("")), prefixes(F.col("path")))).alias("path"))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return each.groupBy("volume", "path").agg(F.count_distinct("pk").alias("messages")).select("volume", "path", depth.alias("depth"), "messages").orderBy("volume", "depth", "path")


def collapsed(nodes: DataFrame) -> DataFrame:
    """Nodes of `tree` that a browser shows: a folder all of whose children hold one message each hides them."""
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    hidden = nodes.filter("depth > 0").groupBy("volume", parent.alias("parent")).agg(F.max("messages").alias("most"), F.count(F.lit(1)).alias("n")).filter("most = 1 AND n > 1")
    return nodes.withColumn("parent", parent).join(hidden.select("volume", "parent"), ["volume", "parent"], "left_anti").drop("parent")


def in_mailboxes(observed: DataFrame, selections: list[tuple[str | None, str | None]]) -> DataFrame:
    """(pk) of messages in any selection (volume, path): the path itself or below it; None: any."""
    hit: Column = F.lit(False)
    for volume, path in selections:
        one = F.lit(True)
        if volume is not None:
            one = one & (F.col("volume") == volume)
        if path is not None:
            one = one & ((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
        hit = hit | one
    return observed.filter(hit & F.col("pk").isNotNull()).select("pk").distinct()


def in_selected(observed: DataFrame, selections: DataFrame) -> DataFrame:
    """(pk) of messages in any selection, as `in_mailboxes`, for a table of selections (volume, path) of any size; null: any."""
    names = F.array_join(F.filter(F.split("path", "/"), lambda p: p != ""), "/")
    chosen = selections.select("volume", F.when(F.col("path").isNotNull(), names).alias("at")).distinct()
    each = observed.filter("pk IS NOT NULL").select("pk", "volume", F.explode(F.concat(F.array(F.lit("")), prefixes(F.col("path")))).alias("at"))
    on = {"both": (["volume", "at"], "volume IS NOT NULL AND at IS NOT NULL"), "path": (["at"], "volume IS NULL AND at IS NOT NULL"), "volume": (["volume"], "volume IS NOT NULL AND at IS NULL")}
    hits = [each.join(chosen.filter(which).select(*keys), keys, "left_semi").select("pk") for keys, which in on.values()]
    every = each.join(F.broadcast(chosen.filter("volume IS NULL AND at IS NULL").limit(1).select(F.lit("").alias("at"))), "at", "left_semi").select("pk")  # a row at most
    return hits[0].union(hits[1]).union(hits[2]).union(every).distinct()


def locations(observed: DataFrame, preferred: str) -> DataFrame:
    """(pk, place, volume, path): all places of a message, those on the preferred volume first."""
    from pyspark.sql import Window

    order = Window.partitionBy("pk").orderBy(F.desc(F.col("volume") == preferred), "volume", "path")
    return observed.filter("pk IS NOT NULL").distinct().select("pk", F.row_number().over(order).alias("place"), "volume", "path")


def with_observations(files: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Source files that have at least one catalogued observation."""
    return files.join(observed.filter("pk IS NOT NULL").select(key), key, "left_semi")


def latest_check(checks: DataFrame, *keys: str) -> DataFrame:
    """The latest completed check of each key: checks (..., completed_at, action), ties to the larger action."""
    done = checks.filter("completed_at IS NOT NULL")
    best = done.groupBy(*keys).agg(F.max(F.struct("completed_at", "action")).alias("last"))
    return best.select(*keys, "last.completed_at", "last.action")
