"""SimHash near-dedup: BK-trees over fingerprints, then connected components.

Pigeonhole: cut 64 bits into `radius + 2` blocks; two fingerprints that differ in at most `radius` bits agree on at
least two whole blocks. Each pair of blocks is a shard key, so every link lies inside some shard. A shard's
fingerprints form one BK-tree (children keyed by their integer Hamming distance to the parent) and a search follows
only the edges within the radius of the distance at hand. The trees of a partition form one forest that numpy walks
level by level. A shard with more than `SHARD_ROWS` fingerprints is split into several trees; each is then sent to
every block of the shard's queries, so no task holds more than two such parts. Of the links found in a task only a
spanning forest goes on: it keeps the components and never grows with the square of a group.

The pipeline's near copies (`near_groups`) are those of shingle sets of a Jaccard similarity: bands of least hashes bring candidates
together, and exact counts decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import NULL_ID, U64, cut, discard, in_arrow, mix64, parts, text_bytes, tune

#: Fingerprints in one tree; larger shards are split.
SHARD_ROWS = 4096
#: Frontier entries that a search expands at a time.
FRONTIER = 1 << 18


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, A-Z lowered, words joined by a space; fewer words: of all of them."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], U64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], U64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every whole text. Null text: as empty; no words: 0. Null id: NULL_ID."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [majority(shingle_hashes(t, width)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), text_bytes().alias("text"))
    return in_arrow(rows, "bktree", run, "id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """BK-trees, one for each distinct value of `tree`, over fingerprints that are distinct within a tree."""

    def __init__(self, tree: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        order = np.argsort(tree, kind="stable")
        first = np.r_[True, tree[order][1:] != tree[order][:-1]] if n else np.empty(0, bool)
        self.trees, self.roots = tree[order][first], order[first]
        parent = np.empty(n, np.int64)
        parent[order] = np.repeat(self.roots, np.diff(np.r_[np.flatnonzero(first), n]))
        waiting = np.setdiff1d(np.arange(n), self.roots)
        edges = []
        self.up = np.full(n, -1)  # each node's parent
        while len(waiting):
            at = parent[waiting]
            key = at * 128 + popcount(fp[waiting] ^ fp[at])
            o = np.argsort(key, kind="stable")
            head = np.r_[True, key[o][1:] != key[o][:-1]]
            child = waiting[o][head]
            self.up[child] = at[o][head]
            edges.append(np.stack([key[o][head], child]))
            below = np.repeat(child, np.diff(np.r_[np.flatnonzero(head), len(o)]))
            rest = ~head
            parent[waiting[o][rest]] = below[rest]
            waiting = waiting[o][rest]
        self.levels = [e[1] for e in edges]
        found = np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.int64)
        found = found[:, np.argsort(found[0], kind="stable")]
        self.key, self.child = found

    def one_kind(self, label: np.ndarray) -> np.ndarray:
        """For each node its label if all nodes below it have the same, else -1."""
        same = label.copy()
        for level in reversed(self.levels):
            same[self.up[level[same[level] != label[self.up[level]]]]] = -1
        return same

    def search(self, tree: np.ndarray, fp: np.ndarray, radius: int, done: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, some at a time; a query walks the tree it names. done: labels of queries and of nodes (`one_kind`); a query passes by what has its own label throughout."""
        at = np.searchsorted(self.trees, tree)
        ok = at < len(self.trees)
        ok[ok] = self.trees[at[ok]] == tree[ok]
        stack = [(np.flatnonzero(ok), self.roots[at[ok]])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack.append((q[FRONTIER:], node[FRONTIER:]))
                q, node = q[:FRONTIER], node[:FRONTIER]
            if done is not None:
                open_ = done[0][q] != done[1][node]
                q, node = q[open_], node[open_]
            d = popcount(fp[q] ^ self.fp[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * 128 + np.minimum(d + radius, 127), side="right")
            n = hi - lo
            if n.any():
                total = n.sum()
                inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                stack.append((np.repeat(q, n), self.child[np.repeat(lo, n) + inside]))


class Union:
    """Disjoint sets; `add` tells which of the pairs joined two sets."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                break
            r = s
        self.up[x] = r
        return r

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        ra, rb = self.roots(a), self.roots(b)
        open_ = ra != rb
        kept = []
        up = self.up
        for x, y, i, j in zip(a[open_].tolist(), b[open_].tolist(), ra[open_].tolist(), rb[open_].tolist(), strict=True):
            while up[i] != i:
                i = int(up[i])
            while up[j] != j:
                j = int(up[j])
            if i != j:
                up[max(i, j)] = min(i, j)
                kept.append((x, y))
        return kept


def block_masks(radius: int, bits: int = 64) -> list[int]:
    """A mask for each pair of the radius + 2 blocks, as signed 64-bit values."""
    n = radius + 2
    edges = [bits * i // n for i in range(n + 1)]
    block = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(x | y) for x, y in combinations(block, 2)]


def links(classes: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): ids of rows whose fingerprints differ in at most `radius` bits; a spanning forest of each task's links.

    classes: (id long, fp long). A shard with more than `shard_rows` rows is cut into `t` parts by a hash; part i goes to the cells (i, j) and (j, i) of every j, where the tree of one is searched with the other.
    """
    spark = classes.sparkSession
    tune(spark)
    keyed = classes.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(radius)])).alias("m", "key"))
    keyed = keyed.select("id", "fp", F.xxhash64("m", "key").alias("shard"))
    sizes = keyed.groupBy("shard").count()
    hot = sizes.filter(F.col("count") > shard_rows).select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("t"))
    crowded = sizes.filter((F.col("count") > 1) & (F.col("count") <= shard_rows)).select("shard", F.lit(1).alias("t"))
    rows = keyed.join(crowded.unionByName(hot), "shard")
    part = F.pmod(F.xxhash64("fp", "id"), F.col("t")).cast("int")
    cells = F.when(F.col("t") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    )
    rows = rows.select("id", "fp", "shard", part.alias("part"), F.explode(cells).alias("c"))
    rows = rows.select("id", "fp", F.xxhash64("shard", "c.i", "c.j").alias("cell"), F.when(F.col("part") == F.col("c.i"), 0).otherwise(1).alias("side"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(some)
            ids, cell, side = (t.column(c).to_numpy() for c in ("id", "cell", "side"))
            fp = t.column("fp").to_numpy().view(U64)
            # equal fingerprints of a cell stand in a row and are one node
            o = np.lexsort((side, fp, cell))
            same = (cell[o][1:] == cell[o][:-1]) & (fp[o][1:] == fp[o][:-1])
            alike = (o[:-1][same], o[1:][same])
            tree = side == 0
            nodes = o[np.r_[True, ~same] & tree[o]]
            # where a cell has two sides, the second searches the first; else the cell searches itself
            two = np.unique(cell[~tree])
            asks = np.flatnonzero(~tree | ~np.isin(cell, two))
            forest, union = Forest(cell[nodes], fp[nodes]), Union(len(ids))
            out: list[tuple[int, int]] = []

            def join(a: np.ndarray, b: np.ndarray) -> None:
                keep = a != b
                out.extend(union.add(a[keep], b[keep]))

            if len(alike[0]):
                join(*alike)
            # links along the trees' own edges come first: a crowd of near copies is then one set, which its members pass by
            below = np.flatnonzero(forest.up >= 0)
            above = forest.up[below]
            near = popcount(forest.fp[below] ^ forest.fp[above]) <= radius
            if near.any():
                join(nodes[below[near]], nodes[above[near]])
            label = union.roots(np.arange(len(ids)))
            for q, node in forest.search(cell[asks], fp[asks], radius, (label[asks], forest.one_kind(label[nodes]))):
                join(asks[q], nodes[node])
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            # cells arrive together; only whole cells are searched
            cell = b.column("cell").to_numpy()
            change = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            if held and last != cell[0] and n >= 1 << 16:
                yield flush(held)
                held, n = [], 0
            if len(change) and n + len(cell) >= 1 << 16:
                c = int(change[-1])
                yield flush([*held, b.slice(0, c)])
                held, n = [b.slice(c)], len(cell) - c
            else:
                held.append(b)
                n += len(cell)
            last = cell[-1]
        if held:
            yield flush(held)

    return in_arrow(rows.repartition(parts(spark), "cell").sortWithinPartitions("cell"), "bktree", search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id that occurs in `edges` (a, b), the smallest id it is connected with.

    Alternating large-star and small-star rounds; each round is one written table, and hubs are summed before the shuffle.
    """
    at = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = at(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # sums are written, so that both sides of the joins are plain exchanges and a hub's links can be split
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("a > m").select("a", F.col("m").alias("b")))
        large = cut(large.filter("a <> b").distinct())
        small = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        replaced = (now, least, large, small)
        now = cut(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        discard(*replaced)
        before, seen = seen, at(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


#: Width of the shingles of near copies; bands of least hashes that bring candidates together, and the hashes of a band:
#: of pairs at a similarity of 0.8 one in 13,000 shares no band.
SHINGLE, BANDS, BAND_HASHES = 5, 24, 5
#: Texts, and shingles, of a candidate group that are compared in one list; larger groups are cut into cells.
GROUP_ROWS, GROUP_SHINGLES = 2048, 1 << 20
#: Digests of sets that a task remembers, so that repeated rows don't go on.
SEEN_ROWS = 200_000

_odd = np.random.default_rng(20240801).integers(0, 2**63, (2, BANDS * BAND_HASHES, 1), dtype=U64)
_SCALE, _SHIFT = _odd[0] * U64(2) + U64(1), _odd[1]


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS): a key for each band, of the least of the set's hashes by each of BAND_HASHES functions."""
    least = np.full((len(sets), BANDS * BAND_HASHES), U64(2**64 - 1))
    for k, s in enumerate(sets):
        for at in range(0, len(s), 4096):
            np.minimum(least[k], (s[at : at + 4096] * _SCALE + _SHIFT).min(axis=1), out=least[k])
    least = least.reshape(len(sets), BANDS, BAND_HASHES)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=U64)), least.shape[:2])
    for j in range(BAND_HASHES):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + least[:, :, j])
    return key.view(np.int64)


def near_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is `similarity` or more, by exact counts of what they share."""
    n = len(sets)
    lengths = np.array([len(s) for s in sets])
    begin = np.r_[0, np.cumsum(lengths)]
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), lengths)[np.argsort(value, kind="stable")]
    held = np.bincount(value)
    at = np.cumsum(held) - held
    waiting, left, out = np.ones(n, bool), n, []
    for start in range(n):
        if not waiting[start]:
            continue
        waiting[start], left, queue = False, left - 1, [start]
        while queue and left:
            p = queue.pop()
            mine = value[begin[p] : begin[p + 1]]
            count = held[mine]
            common = np.bincount(holders[np.repeat(at[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())], minlength=n)
            union = lengths[p] + lengths - common
            near = np.flatnonzero(waiting & ((union == 0) | (common / np.maximum(union, 1) >= similarity)))
            waiting[near] = False
            left -= len(near)
            queue += near.tolist()
            out += [(p, k) for k in near.tolist()]
    return out


def _exact_links(docs: DataFrame, group: DataFrame, sizes: DataFrame, similarity: float, group_rows: int) -> DataFrame:
    """(a, b): links at the similarity within candidate groups (id, component), a spanning forest of each cell's. sizes: (id, sets, size), of the different sets of an id.

    A group too large for one list is cut into `t` parts by a hash of the id and the set, every two of which meet in a cell. Of repeated rows one counts and comes.
    """
    spark = docs.sparkSession
    grouped = cut(group.join(sizes, "id"))
    some = grouped.groupBy("component").agg(F.sum("sets").alias("n"), F.sum("size").alias("size"))
    t = F.greatest(F.ceil(2 * F.col("n") / group_rows), F.ceil(2 * F.col("size") / GROUP_SHINGLES)).cast("int")
    t = F.when((F.col("n") <= group_rows) & (F.col("size") <= GROUP_SHINGLES), 1).otherwise(F.greatest(t, F.lit(2)))
    dealt = cut(grouped.select("id", "component").join(some.select("component", t.alias("t")), "component"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), text_bytes().alias("text")).join(dealt, "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            sets = [shingle_set(x).tobytes() for x in b.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_digest(x + i.to_bytes(8, "little", signed=True)) for x, i in zip(sets, b.column("id").to_pylist(), strict=True)]
            new = [k for k, d in enumerate(digests) if d not in seen and not seen.add(d)]  # an id's rows come to one task, or to few
            if len(seen) > SEEN_ROWS:
                seen.clear()
            at = pa.array(new, pa.int64())
            columns = [b.column("id").take(at), b.column("component").take(at), b.column("t").take(at), pa.array([int.from_bytes(digests[k][:8], "little", signed=True) for k in new], pa.int64()), pa.array([sets[k] for k in new], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "t", "digest", "set"])

    rows = in_arrow(rows.select("id", "text", "component", "t"), "bktree", read, "id long, component long, t int, digest long, set binary")
    part = F.pmod("digest", F.col("t")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("t") - 1), lambda j: (F.col("t") == 1) | (j != part))
    cells = F.transform(others, lambda j: F.xxhash64("component", F.least(part, j), F.greatest(part, j)))
    rows = rows.select("id", "digest", "set", F.explode(cells).alias("cell"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        ids: list[int] = []
        sets: list[np.ndarray] = []
        last = None

        def close() -> None:
            if len(ids) > 1:
                out.extend((ids[x], ids[y]) for x, y in near_links(sets, similarity) if ids[x] != ids[y])
            ids.clear()
            sets.clear()

        def batch() -> pa.RecordBatch:
            pairs = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for b in batches:
            for cell, i, digest, s in zip(*(b.column(c).to_pylist() for c in ("cell", "id", "digest", "set")), strict=True):
                if (cell, i, digest) == last:
                    continue
                if last is None or cell != last[0]:
                    close()
                last = cell, i, digest
                ids.append(i)
                sets.append(np.frombuffer(s, U64))
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    return in_arrow(rows.repartition(parts(spark), "cell").sortWithinPartitions("cell", "id", "digest"), "bktree", search, "a long, b long")


def fingerprint_links(found: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): ids of rows (id, fp) that the BK-trees link; rows of one fingerprint are linked with their smallest id."""
    found = cut(found.distinct())
    same = cut(found.groupBy("fp").agg(F.min("id").alias("first")))
    copies = found.join(same, "fp").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    return copies.unionByName(links(same.select(F.col("first").alias("id"), "fp"), radius))


def near_groups(docs: DataFrame, similarity: float = 0.8, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, component): the ids that have a near copy with a smaller id, and the smallest id of their group.

    Texts are near copies if the exact Jaccard similarity of their sets of five-word shingles is `similarity` or more.
    Texts whose fingerprints the BK-trees link, and those that share a band of least hashes, are candidates; groups connected
    by them are compared by their whole sets.
    Texts with equal sets are one class first. Null text: as empty; empty texts are alike. Null id: NULL_ID. Rows of one
    id are one document.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x) for x in b.column("text").to_pylist()]
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), np.int64).reshape(-1, 2)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sets).ravel()), BANDS).cast(pa.list_(pa.int64()))
            fps = pa.array([majority(shingle_hashes(t, 3)) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64()), keys, fps], names=["id", "c1", "c2", "size", "keys", "fp"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), text_bytes().alias("text"))
    found = cut(in_arrow(rows, "bktree", run, "id long, c1 long, c2 long, size long, keys array<long>, fp long"))
    classes = cut(found.groupBy("c1", "c2", "size", "keys").agg(F.min("id").alias("id")))
    keyed = classes.select("id", F.explode("keys").alias("key"))
    leaders = cut(keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("key", "first"))
    banded = keyed.join(leaders, "key").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    candidates = components(fingerprint_links(found.join(classes.select("id"), "id", "left_semi").select("id", "fp")).unionByName(banded))
    group = candidates.unionByName(candidates.select(F.col("component").alias("id"), "component").distinct())
    sizes = found.select("id", "c1", "c2", "size").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("size"))
    joined = components(_exact_links(docs, group, sizes, similarity, group_rows))
    copies = found.join(classes.select("c1", "c2", F.col("id").alias("first")), ["c1", "c2"]).select("id", "first")
    label = copies.join(joined.withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    return label.filter("id <> component").distinct()


def one_of_each(docs: DataFrame, similarity: float = 0.8, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs without the rows that have a near copy with a smaller id (`near_groups`).

    Columns are kept as they are. Rows of one doc_id stay or go together, texts of any length are read whole, an empty table gives no rows.
    """
    more = near_groups(docs, similarity, group_rows).select(F.col("id").alias("_near_copy"))
    return docs.join(more, F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == more["_near_copy"], "left_anti")


def near_dedup(docs: DataFrame, width: int = 3, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Texts of one fingerprint are one class, standing as its smallest id; classes at `radius` or fewer differing bits are
    linked, and component_id is the smallest doc_id reachable. Null text: as empty. No words: fingerprint zero, linked
    like any other. Repeated rows give repeated results. Null doc_id: kept; it sorts first, so its component_id is null.
    Texts of any length are read whole. Columns other than doc_id and text are not looked at. An empty table gives no rows.
    """
    found = cut(fingerprints(docs, width))
    classes = cut(found.groupBy("fp").agg(F.min("id").alias("id")))
    joined = components(links(classes, radius, shard_rows))
    label = classes.join(joined, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    own = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.join(label, "fp").select(own("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own("component").alias("component_id"))
