"""Runs by brute force over all periods."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import periodic


def brute_force(x, least, times):
    """Every period's stretches by comparing words a period apart; the smallest period of each stretch."""
    found = {}
    for q in range(1, len(x) // times + 1):
        i = q
        while i < len(x):
            s = i - q
            while i < len(x) and x[i] == x[i - q]:
                i += 1
            if i - s >= max(least, times * q):
                found.setdefault((s, i), q)
            i += 1
    return sorted((s, e, q) for (s, e), q in found.items())


@st.composite
def sequences(draw):
    k = draw(st.integers(1, 4))
    x = []
    for _ in range(draw(st.integers(1, 9))):
        block = draw(st.lists(st.integers(0, k - 1), min_size=1, max_size=9))
        kind = draw(st.integers(0, 2))
        if kind == 2 and x:  # what has been there before
            a = draw(st.integers(0, len(x) - 1))
            block = x[a : a + draw(st.integers(1, 40))]
        x += block * (draw(st.integers(2, 7)) if kind == 1 else 1)
    return x


@settings(max_examples=1500, deadline=None)
@given(sequences(), st.sampled_from([(2, 2), (3, 3), (4, 2), (6, 3), (24, 3), (12, 4), (9, 2)]))
def test_all_runs_are_found(x, bounds):
    want = brute_force(x, *bounds)
    assert periodic.number_runs(x, *bounds) == want
    assert sorted(periodic.word_runs([b"%d" % c for c in x], *bounds)) == want


def test_factors_are_the_longest_that_have_begun_before():
    x = [ord(c) for c in "abaababaabaab"]
    assert periodic.SuffixAutomaton(x).factors(x) == [(0, -1), (1, -1), (2, 0), (3, 0), (6, 1), (11, 0)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    say = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    long = say(4000) + " " + " ".join(["over and over"] * 2000) + " " + say(50)
    made = [None, "", " \t\n", "one", "x " * 23, "x " * 24, "a\x0bb\x0cc " * 8, "é é " * 40, say(30) + " " + "again and " * 30 + say(30), long, "1 2 3 " * 9 + "1 2 4 " + "1 2 3 " * 9]
    return [*((i, t) for i, t in enumerate(made)), *((i, say(r.randint(30, 400))) for i in range(20, 140)), (7, "x " * 30), (7, "x " * 30), (None, "y " * 40)]


def expected(i, text):
    words = (text or "").encode().split()
    if i is not None and words:
        g, last = divmod(zlib.crc32(str(i).encode()), 10)
        if last == 0:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(len(words))]
    runs = sorted(((s, e - s, q) for s, e, q in brute_force(words, 24, 3)), key=lambda r: (r[0], r[2]))
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (i, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, 5, "r", 1, 2) for i, t in texts], "doc_id long, text string, start int, runs string, best int, period int").repartition(3)
    got = periodic.summary(periodic.collapse(docs, edit=periodic.repeat_tail))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected(i, t) for i, t in texts]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 10 and any(i in {w[0] for w in want if w[1]} for i in range(20, 140))


def test_operator_gives_texts_and_spans(spark):
    docs = spark.createDataFrame([(1, "go " + "a b c " * 10 + "end")], "doc_id long, text string")
    (row,) = periodic.collapse(docs).collect()
    assert row["collapsed"] == "go a b c end" and [tuple(r) for r in row["runs"]] == [(1, 30, 3)]


def test_empty_table(spark):
    assert periodic.summary(periodic.collapse(spark.createDataFrame([], "doc_id long, text string"))).isEmpty()


def test_very_long_texts_stay_near_linear():
    assert periodic.word_runs([b"x", b"y", b"z"] * 100_000) == [(0, 300_000, 3)]
