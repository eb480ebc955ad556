"""Periodic runs of words, by Kolpakov and Kucherov's algorithm for each text.

1. A suffix automaton of the words gives the Lempel-Ziv factors: each is a new word or the longest stretch that has begun before.
2. Main's algorithm finds the runs that touch a factor's beginning: common extensions to both sides of it, within a
   window that the neighbouring factors bound.
3. Every other run lies strictly inside a factor, and is copied from the factor's earlier occurrence.

A run is at least `times` periods and `least` words long, so each of its strings of a few words comes again one period
further on. What has no such neighbour holds no run, and doesn't reach the automaton; every run that is reported comes from it.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import U64, in_arrow, mix64, text_bytes, tune

#: A run's words at least, and its periods at least.
LEAST, TIMES = 24, 3
#: Times that stretches without a near equal are cut away. Fewer only leave the automaton more to read.
NARROWED = 8


class SuffixAutomaton:
    """Of a sequence of numbers from 0. first: where a state's strings first end. Most states have one edge, kept in two arrays; further edges are in `more`."""

    def __init__(self, seq: list[int]):
        self.first, self.letter, self.target = array("i", [-1]), array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        length, link, last = array("i", [0]), array("i", [-1]), 0
        first, letter, target, more = self.first, self.letter, self.target, self.more
        for i, c in enumerate(seq):
            now = len(length)
            length.append(length[last] + 1)
            first.append(i)
            letter.append(-1)
            target.append(-1)
            link.append(0)
            p = last
            while p >= 0:
                if letter[p] < 0:
                    letter[p], target[p] = c, now
                elif letter[p] == c:
                    break
                elif p not in more:
                    more[p] = {c: now}
                elif c in more[p]:
                    break
                else:
                    more[p][c] = now
                p = link[p]
            if p >= 0:
                q = target[p] if letter[p] == c else more[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    first.append(first[q])
                    letter.append(letter[q])
                    target.append(target[q])
                    link.append(link[q])
                    if q in more:
                        more[clone] = dict(more[q])
                    while p >= 0:
                        if letter[p] == c and target[p] == q:
                            target[p] = clone
                        elif p in more and more[p].get(c) == q:
                            more[p][c] = clone
                        else:
                            break
                        p = link[p]
                    link[q] = link[now] = clone
            last = now

    def factors(self, seq: list[int]) -> list[tuple[int, int]]:
        """(begin, source) of each Lempel-Ziv factor; source: where it has occurred before, maybe overlapping itself, or -1: a new number."""
        first, letter, target, more = self.first, self.letter, self.target, self.more
        out, i, n = [], 0, len(seq)
        while i < n:
            state, at = 0, i
            while at < n:
                c = seq[at]
                to = target[state] if letter[state] == c else more[state][c]
                if first[to] >= at:
                    break
                state, at = to, at + 1
            out.append((i, first[state] - (at - i) + 1 if at > i else -1))
            i = max(at, i + 1)
        return out


def beginnings(x: list[int]) -> list[int]:
    """For each position the common beginning of what starts there and the whole (the Z function)."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _touching(seq: list[int], before: int, at: int, end: int, least: int, times: int) -> dict[tuple[int, int], int]:
    """{(start, end): period} of the runs that start at or before `at` and end there or later, up to `end`; factors begin at before, at and end.

    A run of period q that reaches beyond `at` starts after before - q, or the factor at `before` would be longer; so at - start < (at - before) + q, and with
    `times` periods (times - 1) * q < end - before. Runs that end at `at` and start at or before `before` belong to the boundary there.
    """
    most = (end - before) // (times - 1)
    low = max(0, at - (at - before) - most - 1)
    left, ahead = at - low, min(end - at, most)
    out: dict[tuple[int, int], int] = {}

    def keep(s: int, e: int, q: int) -> None:
        if e - s < max(least, times * q) or (s and seq[s - 1] == seq[s - 1 + q]) or (e < len(seq) and seq[e] == seq[e - q]):
            return
        if out.get((s, e), q) >= q:
            out[s, e] = q

    back = seq[low:at][::-1]
    here = seq[at:end]
    # a whole period after `at`
    forward = beginnings(here)
    backward = beginnings([*back, -1, *seq[low : at + ahead][::-1]])
    for q in range(1, ahead + 1):
        more = forward[q] if q < len(here) else 0
        less = backward[left + 1 + ahead - q]
        if less + more + q >= least:
            keep(at - less, at + q + more, q)
    # a whole period before it
    backward = beginnings(back)
    forward = beginnings([*here, -1, *seq[low:end]])
    for q in range(1, min(left, most) + 1):
        less = backward[q] if q < left else 0
        more = forward[len(here) + 1 + left - q]
        if less + more + q >= least:
            keep(at - q - less, at + more, q)
    return out


def number_runs(seq: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least `times` (2 or more) smallest periods and `least` numbers, in order."""
    if len(seq) < max(least, times):
        return []
    seq = [*seq, max(seq) + 1]  # a last number of its own: every run ends before it
    factors = SuffixAutomaton(seq).factors(seq)
    found: dict[tuple[int, int], int] = {}
    starting: dict[int, list[tuple[int, int]]] = {}

    def add(s: int, e: int, q: int) -> None:
        if (s, e) not in found:
            found[s, e] = q
            starting.setdefault(s, []).append((e, q))

    for k in range(1, len(factors)):
        before, (at, source) = factors[k - 1][0], factors[k]
        end = factors[k + 1][0] if k + 1 < len(factors) else len(seq)
        # a run that touches `at` is shorter than both factors and the largest period together
        if (end - before) * times // (times - 1) >= least:
            for (s, e), q in _touching(seq, before, at, end, least, times).items():
                add(s, e, q)
        if source >= 0 and starting and end - at > least:
            shift, close = at - source, source + end - at
            for s in range(source + 1, close - least):
                for e, q in tuple(starting.get(s, ())):
                    if e < close:
                        add(s + shift, e + shift, q)
    return sorted((s, e, q) for (s, e), q in found.items())


def stretches(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the stretches outside which there is no run.

    Every string of `gram` words of a run has an equal one period away in it; a period is at most a `times`-th of the stretch. Strings are known by a hash: equal ones
    that aren't only leave more to read.
    """
    gram = least * (times - 2) // times + 1
    n = len(words) - gram + 1
    if len(words) < max(least, times):
        return []
    word = mix64(np.fromiter(map(hash, words), np.int64, len(words)).view(U64))
    key = np.zeros(n, U64)
    for j in range(gram):
        key = key * U64(0x9E3779B97F4A7C15) + word[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    gap = (order[1:] - order[:-1])[same]
    near = np.full(n, n + gram)
    np.minimum.at(near, order[1:][same], gap)
    np.minimum.at(near, order[:-1][same], gap)
    on = near < n + gram
    for _ in range(NARROWED):
        edge = np.diff(np.r_[False, on, False].astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = hi - lo + gram - 1
        most = np.where(size >= least, size // times, 0)
        still = on.copy()
        still[on] = near[on] <= np.repeat(most, hi - lo)
        if (still == on).all():
            break
        on = still
    edge = np.diff(np.r_[False, on, False].astype(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + gram - 1
    return [(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b - a >= least]


def word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of a text's words, by start, then period."""
    out = []
    for a, b in stretches(words, least, times):
        ids: dict[bytes, int] = {}
        seq = [ids.setdefault(w, len(ids)) for w in words[a:b]]
        out += [(a + s, a + e, q) for s, e, q in number_runs(seq, least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        steps[s + q] += 1
        steps[e] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The planted edit of one text in ten, by its id: from some word on, a stretch of it over and over. A null id plants nothing."""
    if doc_id is None or not words:
        return words
    g, last = divmod(zlib.crc32(b"%d" % doc_id), 10)
    if last:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * -(-(n - a) // p))[: n - a]]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of docs. runs: array of (start, length, period) in words, by start, then period.

    Words: what stands between ASCII white space. A run: a stretch of at least `times` smallest periods and `least` words that no neighbouring word extends.
    collapsed: the words that no run holds after its first period, joined by one space. edit(doc_id, words) may change the words first. Null and empty texts have no
    runs and collapse to an empty text. Null ids stay null, repeated rows give repeated results, texts of any length are read whole (a text in one
    worker's memory), other columns are not looked at, an empty table gives no rows.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[tuple]] = []
            kept: list[bytes] = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.split()
                if edit is not None:
                    words = edit(i, words)
                runs = word_runs(words, least, times)
                found.append([{"start": s, "length": e - s, "period": q} for s, e, q in runs])
                kept.append(b" ".join(without_repeats(words, runs)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return in_arrow(rows, "periodic", run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _foremost(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of equal ones."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what `collapse` gives; without runs four nulls."""
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", _foremost(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
