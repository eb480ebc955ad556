"""Sharding by Karmarkar-Karp differencing, for groups that can't be divided.

A partial partition is k sums. The two with the largest spread are put together, the largest sum of one with the smallest of the other, until one is left: its sums are the shards.
One task differences at most `TOP_ITEMS` items. Where there are more, small ones are dealt by hash to blocks, and differencing
makes a few near-equal bundles of each block; bundles are the next level's items. A group larger than a small share of all bytes is never bundled: it stands for itself
up to the last level, where what is left balances against it. So do some small ones, chosen by hash: the last level evens out with them what bundles of one size leave.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import cut, text_bytes, tune

#: Items that one task differences into shards; items of a block, and the bundles that are made of them.
TOP_ITEMS, BLOCK_ITEMS, BUNDLES = 16384, 4096, 256
#: What a document takes besides its text.
ROW_BYTES = 16


def differenced(sizes: list[int], k: int) -> np.ndarray:
    """For each item the part (0 to k - 1) it falls to by k-way differencing. Ties of spread: what was there first."""
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}  # ascending, the smallest at 0; an item alone has none yet
    joined: list[tuple[int, int, np.ndarray]] = []  # node n + j: its two parts, and the places of the first part's sums in order

    def of(node: int) -> np.ndarray:
        if node >= n:
            return sums.pop(node)
        alone = np.zeros(k, np.int64)
        alone[-1] = sizes[node]
        return alone

    for j in range(n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = of(a) + of(b)[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        sums[n + j] = both - both[0]
        joined.append((a, b, order.astype(np.int16)))
        heapq.heappush(heap, (-int(both[-1] - both[0]), n + j))
    part = np.empty(n, np.int64)
    labels = {heap[0][1]: np.arange(k)}
    for node in range(2 * n - 2, n - 1, -1):
        mine = labels.pop(node)
        a, b, order = joined[node - n]
        first = np.empty(k, np.int64)
        first[order] = mine
        for child, places in ((a, first), (b, first[::-1])):
            if child >= n:
                labels[child] = places
            else:
                part[child] = places[-1]
    if n == 1:
        part[0] = k - 1
    return part


def _parts(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "item"], ascending=[False, True]).reset_index(drop=True)
    return rows.assign(part=differenced(rows["size"].tolist(), k))


def shards_of(items: DataFrame, shards: int, top_items: int = TOP_ITEMS, block_items: int = BLOCK_ITEMS, bundles: int = BUNDLES) -> DataFrame:
    """(item, shard) of items (item long, size long; distinct, none null)."""
    levels: list[DataFrame] = []
    n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("size").cast("decimal(38,0)")), F.lit(0))).first()
    while n > top_items:
        # larger ones are at most half of what the last level takes; the others become a few of a block's many
        level = len(levels)
        large = F.col("size") > F.lit(int(total) // (top_items // 2)).cast("long")
        single = large | (F.pmod(F.xxhash64("item", F.lit(-1)), F.lit(n)) < top_items // 8)
        blocks = -(-n // block_items)

        def bundled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return _parts(rows, bundles)[["item", "part", "block"]]

        small = items.filter(~single).withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)))
        dealt = small.groupBy("block").applyInPandas(bundled, "item long, part long, block long")
        above = dealt.select("item", F.xxhash64("block", "part", F.lit(level)).alias("above"))
        levels.append(cut(above.unionByName(items.filter(single).select("item", F.col("item").alias("above")))))
        items = cut(items.join(levels[-1], "item").groupBy("above").agg(F.sum("size").alias("size")).withColumnRenamed("above", "item"))
        n = items.count()

    def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _parts(rows, shards)[["item", "part"]]

    found = cut(items.groupBy(F.lit(0).alias("all")).applyInPandas(lambda key, rows: last(key, rows[["item", "size"]]), "item long, part long").select("item", F.col("part").cast("int").alias("shard")))
    for level in reversed(levels):
        found = cut(level.join(found.withColumnRenamed("item", "above"), "above").select("item", "shard"))
    return found


def _sized(docs: DataFrame, *columns) -> DataFrame:
    """Columns, item (equal texts: one item; null is as empty), size."""
    return docs.select(*columns, F.xxhash64(text_bytes()).alias("item"), (F.octet_length(text_bytes()).cast("long") + ROW_BYTES).alias("size"))


def place(docs: DataFrame, shards: int = 40, **limits: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): the shard of every row of docs and its place there, gapless from 0.

    law is `bytes`: the shards' sizes are near equal. size: the text's UTF-8 bytes and ROW_BYTES. Rows of equal texts are one group and share a shard; a null
    text is as empty. (Texts of one 64-bit hash are one group too, which costs a little balance and nothing else.) A group
    larger than a shard's share has a shard to itself. Null ids are kept, repeated rows each have a slot, texts are read whole, other columns are not looked at, an empty table
    gives no rows.
    """
    tune(docs.sparkSession)
    rows = cut(_sized(docs, F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text_bytes()).alias("text_crc32"), F.monotonically_increasing_id().alias("at")))
    found = shards_of(cut(rows.groupBy("item").agg(F.sum("size").alias("size"))), shards, **limits)
    dealt = cut(rows.join(found, "item").select("doc_id", "size", "text_crc32", "shard", "at", F.shiftright("at", 33).alias("split")))
    # a row's place: what its shard has in earlier splits of the input, and before it in its own
    counted = cut(dealt.groupBy("shard", "split").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counted.select("shard", "split", F.coalesce(before, F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("shard", "split").orderBy("at"))
    placed = dealt.withColumn("own", own).join(ahead, ["shard", "split"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, files: int = 16, **limits: int) -> None:
    """Parquet below path, a folder shard=N for each shard that has rows, of at most `files` files each; all columns of docs stay (one named shard is replaced), equal texts lie in one shard."""
    rest = [c for c in docs.columns if c != "shard"]
    sized = _sized(docs, F.struct(*rest).alias("row"))
    found = shards_of(cut(sized.groupBy("item").agg(F.sum("size").alias("size"))), shards, **limits)
    dealt = sized.join(found, "item").select("row.*", "shard")
    part = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    dealt.withColumn("_file", part).repartition("shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
