"""Best-fit packing with a swap-based local search.

Documents become token pieces of at most the capacity. Shards of pieces are packed best fit first; then the local
search moves documents between underfull bins (one for none, one for one, two for one, one for two), only ever raising
the sum of squared fills, so that the emptiest bins drain; it ends when the bins are as few as the total needs or no bin
admits a step. What shards leave clearly underfull is dealt anew into groups of the same size and packed again, for as
long as a round makes fewer bins than it was given.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import cut, in_arrow, release, tune, worker_state

#: Pieces that one group packs, and the share of the capacity up to which a bin is open.
SHARD_ROWS, OPEN_FILL = 4096, 0.98
#: Entries of a worker's table of parts.
PART_ROWS = 500_000


def _letters(*kinds: str) -> str:
    """A character class of the characters of these categories below PLAIN."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] in kinds)


#: Scripts below this code point are split here, texts with others word by word by the library.
PLAIN = 0x530
_L, _N = _letters("L"), _letters("N")
# Fixed value: the pattern in the tokenizer's file, with the letters and numbers below PLAIN spelled out
PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Characters that this splitting leaves to the library: other scripts, and those whose lower case is not of the same kind below PLAIN.
_MOVED = "".join(re.escape(chr(c)) for c in range(PLAIN) if any(ord(x) >= PLAIN or unicodedata.category(x)[0] != unicodedata.category(chr(c))[0] for x in chr(c).lower()))
_STRANGE = re.compile(f"[\x1c-\x1f{_MOVED}{chr(PLAIN)}-\U0010ffff]")


class PartTable:
    """Token ids (little-endian, 32 bits) of each distinct part of lower-case text: a run of letters, a digit, a run of other signs.

    The model splits text into these parts and drops white space, so no token crosses them; every missing part is encoded
    once, many in one call, and a text's ids are its parts' ids by position. Texts that this splitting can't vouch for
    (other scripts, text not in NFC, special strings) go word by word through the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        one = lambda x: self.t.encode(x, add_special_tokens=False).ids
        if one("a b\n\nc") != one("a") + one("b") + one("c"):
            raise ValueError("the tokenizer keeps white space: words are not independent")
        self.by_parts = one("Don't12..é") == one("don") + one("'t") + one("1") + one("2") + one("..") + one("é")
        self.known: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        return self.by_parts and not _STRANGE.search(text) and (text.isascii() or unicodedata.is_normalized("NFC", text)) and "<|" not in text

    def each(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(self, missing: list[str]) -> None:
        if len(self.known) > PART_ROWS:
            self.known.clear()
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            e = self.t.encode(" ".join(some), add_special_tokens=False)
            word = np.array(e.word_ids, np.int64)
            if len(word) and word[-1] == len(some) - 1 and (np.diff(word) >= 0).all():
                ids = np.array(e.ids, "<u4").tobytes()
                bounds = (4 * np.searchsorted(word, np.arange(len(some) + 1))).tolist()
                found = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            else:
                found = self.each(some)
            self.known.update(zip(some, found, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [PART.findall(t.replace("Σ", "σ").lower()) if self.plain(t) else None for t in texts]
        distinct = set().union(*[p for p in split if p])
        known = self.known
        missing = [p for p in distinct if p not in known]
        if len(known) + len(missing) > PART_ROWS:
            known.clear()
            missing = list(distinct)
        self.learn(missing)
        out = []
        for t, parts in zip(texts, split, strict=True):
            if parts is None:
                words = t.split(" ")
                parts_of = {}
                uniq = list(set(words))
                for at in range(0, len(uniq), 1024):
                    parts_of.update(zip(uniq[at : at + 1024], self.each(uniq[at : at + 1024]), strict=True))
                out.append(b"".join([parts_of[w] for w in words]))
            else:
                out.append(b"".join(map(known.__getitem__, parts)))
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each whole text's ids and then end_id, cut at the capacity. Null text: only end_id."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_state("packing", tokenizer, lambda: PartTable(tokenizer))
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for doc, ids in zip(b.column("doc_id").to_pylist(), table.encode(b.column("text").to_pylist()), strict=True):
                    ids = memoryview(ids + end)
                    rows += [(doc, p, p * capacity, len(x := ids[s : s + step]) // 4, zlib.crc32(x)) for p, s in enumerate(range(0, len(ids), step))]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_arrow(rows, "packing", run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that has room. `open_` has a bit for each free space that some bin has."""
    by_space: dict[int, list[int]] = defaultdict(list)
    bins: list[list[int]] = []
    open_ = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = open_ >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                open_ &= ~(1 << space)
            bins[at].append(i)
        else:
            space, at = capacity, len(bins)
            bins.append([i])
        if space > n:
            by_space[space - n].append(at)
            open_ |= 1 << (space - n)
    return bins


def drain(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: empty the least full bins into the others as long as a step raises the sum of squared fills.

    Steps between the drained bin (fill f) and another (fill g >= f): move a document over; exchange one for one, two for
    one or one for two such that more goes over than comes back. The other's fill grows by what the drained one loses,
    and as g >= f squares grow. Stops when the bins are as few as the total needs or no bin admits a step.
    """
    length = np.array(lengths, np.int64)
    at = np.full(len(length), -1)
    for k, b in enumerate(bins):
        at[b] = k
    fill = np.bincount(at, length, len(bins)).astype(np.int64)
    open_ = np.flatnonzero(fill < capacity)  # a full bin takes part in no step
    item = np.flatnonzero(np.isin(at, open_))
    least = fewest(length, capacity)
    n_live, progress = len(bins), True
    while n_live > least and progress:
        progress = False
        for source in sorted(open_.tolist(), key=lambda k: (fill[k], k)):
            while fill[source] and n_live > least and (step := best_step(source, at, fill, length, item, capacity)):
                target, out, back = step
                at[out], at[back] = target, source
                gain = int(length[out].sum() - length[back].sum())
                fill[source] -= gain
                fill[target] += gain
                progress = True
                n_live -= not fill[source]
            if n_live <= least:
                break
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(x)]


def best_step(source: int, at: np.ndarray, fill: np.ndarray, length: np.ndarray, item: np.ndarray, capacity: int) -> tuple[int, list[int], list[int]] | None:
    """(other bin, what goes over, what comes back): the step by which the other bin gains most; None if there is none.

    at: each document's bin. Documents of one length in one bin are alike, so one of each stands for them.
    """
    fits = np.flatnonzero((fill >= max(1, fill[source])) & (fill < capacity))
    fits = fits[fits != source]
    mine = item[at[item] == source]
    if not len(fits):
        return None
    mine = mine[np.argsort(length[mine], kind="stable")]
    sizes, first, count = np.unique(length[mine], return_index=True, return_counts=True)
    # what may go over: one document, or two
    x, y = np.triu_indices(len(sizes))
    two = (x != y) | (count[x] > 1)
    x, y = x[two], y[two]
    sums, which = np.unique(sizes[x] + sizes[y], return_index=True)
    one_or_two = [(int(n), [int(mine[i])]) for n, i in zip(sizes, first, strict=True)]
    one_or_two += [(int(n), [int(mine[first[x[k]]]), int(mine[first[y[k]] + (x[k] == y[k])])]) for n, k in zip(sums, which, strict=True)]
    space = capacity - fill[fits]
    best, gain = None, 0
    for n, out in one_or_two:  # for none
        ok = np.flatnonzero(space >= n)
        if n > gain and len(ok):
            best, gain = (int(fits[ok[np.argmin(space[ok])]]), out, []), n
    theirs = item[np.isin(at[item], fits)]
    room = capacity - fill[at[theirs]] + length[theirs]  # of its bin, once a document has come back
    for n, out in one_or_two:  # for one
        ok = np.flatnonzero((room >= n) & (length[theirs] < n - gain))
        if len(ok):
            k = ok[np.argmin(length[theirs[ok]])]
            best, gain = (int(at[theirs[k]]), out, [int(theirs[k])]), n - int(length[theirs[k]])
    top = int(sizes[-1])
    if top - gain >= 2:  # one for two, which are shorter together
        theirs = theirs[length[theirs] < top - gain]
        theirs = theirs[np.lexsort((theirs, length[theirs], at[theirs]))]
        bin_, size = at[theirs], length[theirs]
        spare = capacity - fill[bin_]
        for d in range(1, len(theirs)):
            same = np.flatnonzero(bin_[d:] == bin_[:-d])
            if not len(same):
                break
            back = size[same] + size[same + d]
            after = spare[same] + back
            for n, out in one_or_two[: len(sizes)]:
                ok = np.flatnonzero((after >= n) & (back < n - gain))
                if len(ok):
                    j = ok[np.argmin(back[ok])]
                    x, y = theirs[same[j]], theirs[same[j] + d]
                    best, gain = (int(at[x]), out, [int(x), int(y)]), n - int(back[j])
    return best


def fewest(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on bins (Martello and Toth): for each k, documents longer than capacity - k stand alone, those over half stand apart, and those from k to half fill what room these leave."""
    if not len(lengths):
        return 0
    have = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    n, total = np.cumsum(have), np.cumsum(have * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    alone = n[capacity] - n[capacity - k]
    apart = n[capacity - k] - n[half]
    room = apart * capacity - (total[capacity - k] - total[half])
    below = np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    return int((alone + apart + np.maximum(0, -(-(total[half] - below - room) // capacity))).max())


def pack_rows(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """rows, in one order for equal input, with bin (from 0), offset and the bin's fill."""
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    lengths = rows["length"].tolist()
    bins = drain(best_fit(lengths, capacity), lengths, capacity)
    n = len(rows)
    at, offset, fill = [0] * n, [0] * n, [0] * n
    for k, b in enumerate(bins):
        total = 0
        for i in b:
            at[i], offset[i] = k, total
            total += lengths[i]
        for i in b:
            fill[i] = total
    return rows.assign(bin=at, offset=offset, fill=fill)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of docs in its sequence.

    tokenizer: path of a tokenizers file that drops white space. Null text: as empty, one piece that is end_id. Texts of any length are read whole. Repeated
    rows are packed each for itself, a null doc_id stays null, other columns are not looked at, an empty table gives no
    rows. sequence_id: any distinct numbers.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = cut(pieces(docs, tokenizer, capacity, end_id))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"

    def packed(level: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            release("packing")
            out = pack_rows(rows, capacity)
            out["sequence_id"] = (level << 56) + (int(key[0]) << 24) + out["bin"]
            out["open"] = out["fill"] <= OPEN_FILL * capacity
            return out[[*names, "sequence_id", "offset", "open"]]

        return run

    waiting = found.filter(F.col("length") < capacity).select(*names)
    done: list[DataFrame] = []
    n, bins, level = waiting.count(), None, 0
    while n:
        level += 1
        groups = -(-n // shard_rows)
        dealt = waiting.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)))
        now = cut(dealt.groupBy("shard").applyInPandas(packed(level), kinds))
        n, left, made = now.agg(F.count_if("open"), F.count_if(F.col("open") & (F.col("offset") == 0)), F.count_if(F.col("offset") == 0)).first()
        if groups == 1 or (bins is not None and made >= bins):  # one group's search is at its end, or a round has saved nothing
            done.append(now)
            break
        # every step among one group's bins has been tried: only other groups' bins can help
        done.append(now.filter(~F.col("open")))
        waiting, bins = now.filter("open").select(*names), left
    full = found.filter(F.col("length") == capacity).select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return reduce(DataFrame.unionByName, [d.drop("open") for d in done], full)
