"""Suffix-array dedup with a run-length index: every byte covered by a span that also starts earlier is removed.

1. Anchors. Every window of `span` bytes is known by the smallest hash among its GRAM-byte strings (its anchor). Equal
   windows have equal anchors, and a run of neighbouring windows shares one, so a run (anchor, digest of its bytes) stands
   for some 35 windows. Runs are combined where they are read, then dealt by anchor: an anchor that occurs once settles
   all its windows, and of equal runs all but the first are repeats.
2. Index. What is left are different runs of one anchor: edges of repeats, edited copies, and periodic text. Their bytes meet by anchor
   in blocks of bounded size. A block becomes a run-length compressed Burrows-Wheeler transform; for each of its runs
   one suffix-array sample is kept (the run ends: suffix, its predecessor and their common prefix). Streaming these samples
   through the text gives every position's matching statistics, and matches of `span` bytes or more chain the equal windows.
3. The marks meet their documents by id, and the covered bytes go.

Anchors of very many different runs would make one huge group: their windows are not indexed. The first of each window is
summed up by digest where it is read and joined back to the others, so that equal windows never meet in one list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import NULL_ID, U64, cut, in_arrow, mix64, parts, text_bytes, tune

GRAM = 32
#: Windows in a run at most; bytes that are hashed at a time; bytes of a block that is indexed (positions take 20 bits).
RUN_WINDOWS, PIECE, BLOCK = 96, 1 << 20, 1 << 20
#: Open runs of one anchor beyond which they are settled window by window.
HOT_RUNS = 1024

_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return U64(pow(_BASE, n, 2**64))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, U64(base))
    x[0] = 1
    return np.multiply.accumulate(x)


_tables: dict[str, np.ndarray] = {}


def _power_table(kind: str) -> np.ndarray:
    if kind not in _tables:
        _tables[kind] = _powers(_BASE if kind == "up" else pow(_BASE, -1, 2**64), 2 * PIECE + 4096)
    return _tables[kind]


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string of b, by doubling."""
    sizes = {1: _BYTE[b]}
    m = 1
    while 2 * m <= k:
        h = sizes[m]
        sizes[2 * m] = h[:-m] * _power(m) + h[m:]
        m *= 2
    h, done = sizes[m], m
    for p in sorted(sizes, reverse=True):
        while k - done >= p:
            n = len(b) - done - p + 1
            h = h[:n] * _power(p) + sizes[p][done : done + n]
            done += p
    return mix64(h)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m = 1
    while 2 * m <= w:
        h = np.minimum(h[:-m], h[m:])
        m *= 2
    return np.minimum(h[: len(h) - (w - m)], h[w - m :]) if m < w else h


_NO_RUNS = tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, U64, U64, bool))


def runs(texts: list[bytes], span: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, digest, periodic) of each run of windows that share an anchor; periodic: the anchor occurs in it more than once."""
    pieces = [(i, at, t[at : at + PIECE + span - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - span + 1), PIECE)]
    out, held, size = [], [], 0
    for n, piece in enumerate(pieces):
        held.append(piece)
        size += len(piece[2])
        if size >= PIECE or n == len(pieces) - 1:
            out.append(_runs(held, span))
            held, size = [], 0
    if not out:
        return _NO_RUNS
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _runs(pieces: list[tuple[int, int, bytes]], span: int) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    if len(b) < span:
        return _NO_RUNS
    gram = min(GRAM, span)
    hashes = gram_hashes(b, gram)
    anchor = sliding_min(hashes, span - gram + 1)
    lengths = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(lengths)
    piece = np.repeat(np.arange(len(pieces)), lengths)[: len(anchor)]
    inside = np.arange(len(anchor)) <= ends[piece] - span
    edge = np.ones(len(anchor) + 1, bool)
    edge[1:-1] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(edge)
    s, e = at[:-1], at[1:]
    ok = inside[s]
    s, e = s[ok], e[ok]
    n = -(-(e - s) // RUN_WINDOWS)
    if len(n) and n.max() > 1:  # periodic text
        which = np.repeat(np.arange(len(s)), n)
        s = s[which] + RUN_WINDOWS * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        e = np.minimum(e[which], s + RUN_WINDOWS)
    sums = np.zeros(len(b) + 1, U64)
    np.cumsum(_BYTE[b] * _power_table("up")[: len(b)], out=sums[1:])
    digest = mix64((sums[e + span - 1] - sums[s]) * _power_table("down")[s] + (e - s).astype(U64))
    # a string is an anchor if it is the least in some window over it, that is, if no such window has a larger least
    pad = np.zeros(span - gram, U64)
    places = np.flatnonzero(~sliding_min(~np.concatenate([pad, anchor, pad]), span - gram + 1) == hashes)
    lo, hi = np.searchsorted(places, s), np.searchsorted(places, e + span - gram)
    n = hi - lo
    run = np.repeat(np.arange(len(s)), n)
    at = places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    periodic = np.bincount(run[hashes[at] == anchor[s][run]], minlength=len(s)) > 1
    owner, offset = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    k = piece[s]
    return owner[k], s - (ends - lengths)[k] + offset[k], e - s, anchor[s], digest, periodic


def _first(change: np.ndarray) -> np.ndarray:
    """Index of each row's group start."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def _repeats(m: np.ndarray, c: np.ndarray, i: np.ndarray, s: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, digest, document, start, without rows that are there already; and which rows, in that order, repeat an earlier run."""
    o = np.lexsort((h, s, i, c, m))
    rows = np.stack([x[o].astype(np.int64, copy=False) if x.dtype != U64 else x[o].view(np.int64) for x in (m, c, i, s, h)])
    other = np.ones(len(o), bool)
    other[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    o = o[other]
    m, c, i, s = m[o], c[o], i[o], s[o]
    new = np.ones(len(o), bool)
    new[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
    f = _first(new)
    return o, (i != i[f]) | (s != s[f])


_LISTS = ("m", "c", "i", "s", "n", "h")
_KINDS = {"m": np.int64, "c": np.int64, "i": np.int64, "s": np.int32, "n": np.int16, "h": np.int32}
_RUN_SCHEMA = "part int, m array<long>, c array<long>, i array<long>, s array<int>, n array<smallint>, h array<int>"
_MARK_SCHEMA = "id long, h int, s int, n int, anchor long, state int"
#: Added to the number of windows of a periodic run on its way to the others of its anchor.
PERIODIC = 1 << 10
#: States of a row of marks: its windows are repeats; its bytes are asked for, by anchor; its windows are told by their digests.
REPEAT, ASKED, HOT = 0, 1, 2


def _list_batch(part: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each part that something falls to, with the lists of it."""
    o = np.argsort(part, kind="stable")
    there, first = np.unique(part[o], return_index=True)
    offsets = pa.array(np.append(first, len(part)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(cols[c][o].astype(_KINDS[c]))) for c in _LISTS]
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *lists], names=["part", *_LISTS])


def _identified(docs: DataFrame) -> list:
    """Columns id (null: NULL_ID) and h, which tells rows of one id with different texts apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.shiftrightunsigned(F.xxhash64("text"), 34).cast("int").alias("h")]


def _marks(docs: DataFrame, span: int, hot_runs: int) -> DataFrame:
    """Steps 1: runs that repeat, and runs whose bytes the index needs."""
    spark = docs.sparkSession
    n_parts = 2 * parts(spark)
    most_runs = min(hot_runs, BLOCK // (RUN_WINDOWS + span - 1))  # an anchor's open runs fit into a block, as each row of (id, h, start) counts and comes once

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # repeated rows have the same runs: one of them is read
            ids, hashes = b.column("id").to_numpy(), b.column("h").to_numpy()
            which = np.sort(np.unique(np.stack([ids, hashes.astype(np.int64)]), axis=1, return_index=True)[1])
            ids, hashes = ids[which], hashes[which]
            d, s, n, m, c, periodic = runs(b.column("text").take(pa.array(which)).to_pylist(), span)
            if not len(d):
                continue
            i, h = ids[d], hashes[d]
            o, again = _repeats(m, c, i, s, h)
            n = np.where(again, n[o], n[o] + PERIODIC * periodic[o])
            cols = {"m": m[o].view(np.int64), "c": c[o].view(np.int64), "i": i[o], "s": s[o], "n": n, "h": h[o]}
            part = (mix64(m[o]) % U64(n_parts)).astype(np.int64)  # anchors are minima: mixed, lest they crowd at zero
            first = {k: v[~again] for k, v in cols.items()}
            yield _list_batch(part[~again], first)
            if again.any():  # settled here; a digest of 0 says so. Neighbouring runs of a document become one
                i, s, n, h = (cols[k][again].astype(np.int64) for k in "isnh")
                o = np.lexsort((s, h, i))
                i, s, n, h = i[o], s[o], n[o], h[o]
                new = np.ones(len(o), bool)
                new[1:] = (i[1:] != i[:-1]) | (h[1:] != h[:-1]) | (s[1:] != (s + n)[:-1]) | (s[1:] >> 13 != s[:-1] >> 13)
                at = np.flatnonzero(new)
                n = np.add.reduceat(n, at)
                none = np.zeros(len(at), np.int64)
                yield _list_batch(i[at] % n_parts, {"m": none, "c": none, "i": i[at], "s": s[at], "n": n, "h": h[at]})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            m, c, i, s, n, h = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in t.column(k).chunks]) for k in _LISTS)
            known = c == 0
            if known.any():
                yield _mark_batch(i[known], h[known], s[known], n[known], np.zeros(known.sum(), np.int64), np.full(known.sum(), REPEAT))
            # an anchor that occurs once has nothing to tell
            u = np.sort(m[~known])
            twice = np.unique(np.concatenate([u[1:][u[1:] == u[:-1]], m[~known & (n >= PERIODIC)]]))
            if not len(twice):
                return
            at = np.minimum(np.searchsorted(twice, m), len(twice) - 1)
            keep = ~known & (twice[at] == m)
            m, c, i, s, n, h = (x[keep] for x in (m, c, i, s, n, h))
            n, periodic = n % PERIODIC, n >= PERIODIC
            o, again = _repeats(m, c, i, s, h)
            m, c, i, s, n, h, periodic = (x[o] for x in (m, c, i, s, n, h, periodic))
            new = np.ones(len(m), bool)
            new[1:] = m[1:] != m[:-1]
            group = np.cumsum(new) - 1
            kinds = np.ones(len(m), bool)
            kinds[1:] = new[1:] | (c[1:] != c[:-1])
            different = np.bincount(group, weights=kinds).astype(np.int64)[group]
            open_ = np.bincount(group, weights=~again).astype(np.int64)[group]  # rows of one id repeat nothing of each other
            state = np.where(again, REPEAT, np.where(open_ > most_runs, HOT, ASKED))
            tell = again | periodic | (different > 1)
            yield _mark_batch(*(x[tell] for x in (i, h, s, n, m, state)))

        held: list[pa.RecordBatch] = []
        for b in batches:
            part = b.column("part").to_numpy()
            bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi == lo:
                    continue
                if held and held[-1].column("part")[0].as_py() != part[lo]:
                    yield from one(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from one(held)

    rows = docs.select(*_identified(docs), text_bytes().alias("text"))
    dealt = in_arrow(rows, "suffix", read, _RUN_SCHEMA).repartition(parts(spark), "part").sortWithinPartitions("part")
    return in_arrow(dealt, "suffix", settle, _MARK_SCHEMA)


def _mark_batch(i, h, s, n, m, state) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), k) for x, k in zip((i, h, s, n, m, state), kinds, strict=True)], names=["id", "h", "s", "n", "anchor", "state"])


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform of a text of at most BLOCK bytes, with a sample for each run.

    heads: the byte of each run; starts: its first row. For a run's first row, SA[row] - 1 is an irreducible position:
    pos, phi (the suffix that sorts just before it) and lcp (their common prefix, up to `limit`) are its sample.
    """

    def __init__(self, text: np.ndarray, limit: int):
        self.n = n = len(text)
        sa = suffix_array(text)
        before = np.where(sa > 0, text[sa - 1].astype(np.int16), -1)
        change = np.ones(n, bool)
        change[1:] = before[1:] != before[:-1]
        self.starts = np.flatnonzero(change)
        self.heads = before[self.starts]
        rank = np.empty(n, np.int64)
        rank[sa] = np.arange(n)
        pos = sa[self.starts] - 1
        pos = np.sort(np.append(pos[pos >= 0], n - 1))
        pos = pos[np.r_[True, pos[1:] != pos[:-1]]]
        row = rank[pos]
        self.pos, self.phi = pos, np.where(row > 0, sa[row - 1], -1)
        self.lcp = common_prefix(text, self.pos, self.phi, limit)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position in text order: the suffix before it in sorted order (-1: none) and their common prefix, exact below the limit."""
        gaps = np.diff(np.r_[-1, self.pos])
        back = np.repeat(self.pos, gaps) - np.arange(self.n)
        phi = np.repeat(self.phi, gaps)
        return np.where(phi >= 0, phi - back, -1), np.where(phi >= 0, np.repeat(self.lcp, gaps) + back, 0)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; ranks and position share one 64-bit key, so each round is one plain sort."""
    n = len(text)
    bits = U64(max(1, int(n).bit_length()))
    assert 3 * int(bits) <= 64, "block too large"
    low = U64((1 << int(bits)) - 1)
    at = np.arange(n, dtype=U64)
    depth = min(4, (64 - int(bits)) // 9)
    padded = np.zeros(n + depth, U64)
    padded[:n] = text.astype(U64) + U64(1)
    key = np.zeros(n, U64)
    for j in range(depth):
        key = (key << U64(9)) | padded[j : j + n]
    while True:
        key = np.sort((key << bits) | at)
        order, high = key & low, key >> bits
        new = np.ones(n, U64)
        new[1:] = high[1:] != high[:-1]
        ranks = np.cumsum(new, dtype=U64)
        if ranks[-1] == n:
            return order.astype(np.int64)
        rank = np.zeros(n + depth, U64)
        rank[order] = ranks
        key = (rank[:n] << bits) | rank[depth : depth + n]
        depth *= 2
        if depth > n:
            depth = n


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (-1: none), up to the limit."""
    n = len(text)
    found = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(b >= 0)
    for k in range(limit):
        x, y = a[open_] + k, b[open_] + k
        ok = np.maximum(x, y) < n
        open_, x, y = open_[ok], x[ok], y[ok]
        open_ = open_[text[x] == text[y]]
        if not len(open_):
            break
        found[open_] += 1
    return found


def repeated_windows(contexts: list[bytes], key: np.ndarray, ids: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """For each byte position of the contexts put together: does a span-byte window start there that starts earlier too?

    Contexts come in order of key, id, start; windows of different keys are never equal. Earlier: by (id, start).
    """
    lengths = np.array([len(x) for x in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), lengths)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = inside <= lengths[owner] - span
    phi, lcp = RunIndex(text, span).matching_statistics()
    root = np.where((lcp >= span) & (phi >= 0), phi, np.arange(len(text)))
    while True:  # to the smallest suffix of those that share the window
        up = root[root]
        if (up == root).all():
            break
        root = up
    at = np.flatnonzero(whole)
    i, s, g = ids[owner[at]], starts[owner[at]] + inside[at], root[at]
    o = np.lexsort((s, i, g))
    new = np.ones(len(o), bool)
    new[1:] = g[o][1:] != g[o][:-1]
    f = _first(new)
    marked = np.zeros(len(text), bool)
    marked[at[o]] = (i[o] != i[o][f]) | (s[o] != s[o][f])
    return marked


def _fetched(docs: DataFrame, asked: DataFrame, span: int) -> DataFrame:
    """(key, more, id, h, s, bytes): the runs that are asked for with their bytes, by anchor; of crowded anchors each window's 128-bit digest (key, more), no bytes."""
    # runs of one document; written, so that both sides of the join are plain exchanges and the rows of one id can be split
    wanted = cut(asked.groupBy("id", "h").agg(F.collect_list(F.struct("s", "n", "anchor", "state")).alias("asked")))
    texts = docs.select(*_identified(docs), text_bytes().alias("text")).join(wanted, ["id", "h"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rows: list[tuple] = []
            for i, h, text, asks in zip(*(b.column(c).to_pylist() for c in ("id", "h", "text", "asked")), strict=True):
                if (i, h) == last:  # repeated rows arrive together
                    continue
                last = i, h
                for a in asks:
                    s, n = a["s"], a["n"]
                    if a["state"] == ASKED:
                        rows.append((a["anchor"], None, i, h, s, text[s : s + n + span - 1]))
                    else:
                        for k in range(s, s + n):
                            d = hashlib.blake2b(text[k : k + span], digest_size=16).digest()
                            rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), i, h, k, None))
            for at in range(0, len(rows), 8192):
                cols = zip(*rows[at : at + 8192], strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "more", "id", "h", "s", "bytes"])

    return cut(in_arrow(texts, "suffix", fetch, "key long, more long, id long, h int, s int, bytes binary"))


def _hot(windows: DataFrame) -> DataFrame:
    """(id, h, s, n) of windows of crowded anchors that are not the first of their digest, with n = 1."""
    first = cut(windows.groupBy("key", "more").agg(F.min(F.struct("id", "s")).alias("first"), F.count(F.lit(1)).alias("count")).filter("count > 1").drop("count"))
    return windows.join(first, ["key", "more"]).filter("id <> first.id OR s <> first.s").select("id", "h", "s", F.lit(1).alias("n"))


def _indexed(runs_: DataFrame, span: int) -> DataFrame:
    """Step 2: (id, h, s, n) of windows that the index finds repeated."""
    spark = runs_.sparkSession

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[tuple]) -> pa.RecordBatch:
            key, ids, h, s, contexts = zip(*rows, strict=True)
            key, ids, h, s = (np.array(x, np.int64) for x in (key, ids, h, s))
            marked = repeated_windows(list(contexts), key, ids, s, span)
            lengths = np.array([len(x) for x in contexts])
            begin = np.cumsum(lengths) - lengths
            on = np.diff(np.r_[False, marked, False].astype(np.int8))
            lo, hi = np.flatnonzero(on == 1), np.flatnonzero(on == -1)  # never across contexts: their last bytes start no window
            own = np.searchsorted(begin, lo, side="right") - 1
            out = (ids[own], h[own], s[own] + lo - begin[own], hi - lo)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["id", "h", "s", "n"])

        held: list[tuple] = []
        group: list[tuple] = []
        size = group_size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "id", "h", "s", "bytes")), strict=True):
                if group and group[-1][:4] == row[:4]:  # of repeated rows that a split join has parted
                    continue
                if group and group[0][0] != row[0]:
                    if held and size + group_size >= BLOCK:
                        yield block(held)
                        held, size = [], 0
                    if len(group) > 1 or group_size > span:  # a lone window has nothing to be compared with
                        held += group
                        size += group_size
                    group, group_size = [], 0
                group.append(row)
                group_size += len(row[4])
                assert group_size <= BLOCK, "more open runs of one anchor than were counted"
        if held and size + group_size >= BLOCK:
            yield block(held)
            held = []
        if len(group) > 1 or group_size > span:
            held += group
        if held:
            yield block(held)

    return in_arrow(runs_.repartition(parts(spark), "key").sortWithinPartitions("key", "id", "s", "h"), "suffix", index, "id long, h int, s int, n int")


def repeats(docs: DataFrame, span: int = 100, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(id, h, marks): for each document with repeats the array of (s, n): windows of `span` bytes starting at s, s + 1, ..., s + n - 1."""
    tune(docs.sparkSession)
    marks = cut(_marks(docs, span, hot_runs))
    known = marks.filter(F.col("state") == REPEAT).select("id", "h", "s", "n")
    fetched = _fetched(docs, marks.filter(F.col("state") != REPEAT), span)
    more = _indexed(fetched.filter("bytes IS NOT NULL").drop("more"), span).unionByName(_hot(fetched.filter("bytes IS NULL").drop("bytes")))
    # runs of one document, each once, whatever the number of its rows; written, as in `_fetched`
    return cut(known.unionByName(more).groupBy("id", "h").agg(F.collect_set(F.struct("s", "n")).alias("marks")))


def kept_bytes(text: bytes, marks: list[dict] | None, span: int) -> tuple[bytes, int, int]:
    """What remains of a text, the number of removed bytes and of maximal removed runs."""
    if not marks:
        return text, 0, 0
    s = np.array([m["s"] for m in marks], np.int64)
    e = s + np.array([m["n"] for m in marks], np.int64) + span - 1
    o = np.argsort(s, kind="stable")
    s, e = s[o], np.maximum.accumulate(e[o])
    new = np.r_[True, s[1:] > e[:-1]]
    lo, hi = s[new], e[np.r_[new[1:], True]]
    kept = b"".join([text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True)])
    return kept, len(text) - len(kept), len(lo)


def _marked(docs: DataFrame, span: int, hot_runs: int, *more) -> DataFrame:
    rows = docs.select(*_identified(docs), text_bytes().alias("text"), *more)
    return rows.join(repeats(docs, span, hot_runs), ["id", "h"], "left")


def dedup(docs: DataFrame, span: int = 100, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte goes if it is covered by a `span`-byte string of the UTF-8 text that also starts earlier: in a smaller doc_id, or in
    the same doc_id at a smaller offset, judged on the input. Matches never cross documents. Null text: as empty. Null
    doc_id: smaller than any other. Rows of one doc_id count as one document, repeated rows are read once: equal strings at equal offsets of them don't
    remove one another. Shorter texts lose nothing. Texts of any length are
    read whole, in pieces that overlap. Columns other than doc_id and text are not looked at. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            done = [kept_bytes(t, m, span) for t, m in zip(texts, b.column("marks").to_pylist(), strict=True)]
            cols = [[len(t) for t in texts], [d[1] for d in done], [d[2] for d in done], [hashlib.sha256(d[0]).hexdigest() for d in done]]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(),) * 3 + (pa.string(),), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = in_arrow(_marked(docs, span, hot_runs).select("id", "text", "marks"), "suffix", run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def without_repeats(docs: DataFrame, span: int = 100, hot_runs: int = HOT_RUNS) -> DataFrame:
    """docs with each text cut as by `dedup` and n_chars, if there, counted anew; a character that was cut apart goes whole.

    Other columns are kept as they are, whatever their names. Null text comes back as empty, a null doc_id stays null, an empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [kept_bytes(t, m, span)[0].decode("utf-8", "ignore") for t, m in zip(b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(kept, pa.string()), b.column("rest")], names=["doc_id", "text", "rest"])

    rest = F.struct(*others, F.lit(0).alias("_")).alias("rest")
    schema = docs.select(F.lit(0).cast("long").alias("doc_id"), F.lit("").alias("text"), rest).schema
    found = in_arrow(_marked(docs, span, hot_runs, rest).select("id", "text", "marks", "rest"), "suffix", run, schema)
    own = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).cast(docs.schema["doc_id"].dataType)
    column = {"doc_id": own, "text": F.col("text"), **{c: F.col("rest")[c] for c in others}}
    if "n_chars" in others:
        column["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[column[c].alias(c) for c in docs.columns])
