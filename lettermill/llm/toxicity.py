"""Toxicity by a lexicon trie that Levenshtein automata search, and context windows.

The lexicon is learned: words that labelled toxic documents hold far more often than others. It forms a trie; the
nondeterministic Levenshtein automaton over it has states (trie node, edits so far) and is made deterministic while words
are read, so each distinct word costs a few look-ups and misspelled terms are found with the edits that their length
allows. Words within these edits that clean documents hold at their usual rate are words of their own, not misspellings.
Each hit is then weighed by the words around it: quotation marks and reporting verbs speak for quotation, second persons
for abuse. A logistic model of the sums gives the score; labelled documents hardly misspell or quote, so each toxic one is
also fitted with its terms misspelled (toxic), quoted, and misspelled and quoted (not toxic).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import cut, in_arrow, tune, worker_state

#: Labelled rows that the model is fitted on at most (those with the smallest hashes). What is learned from them, lexicon included, is bounded by them.
SAMPLE_ROWS = 20_000
#: Terms that may be chosen by chance alone (of all that are weighed), toxic documents that a term must be in, and how much likelier it must be in them.
FALSE_TERMS, LEAST_DOCS, LEAST_LIFT = 1, 3, 8.0
#: Letters of a term at least; tokens on either side of a hit; entries of a worker's table, and the longest token that it keeps; counters that a worker holds.
LEAST_LETTERS, WINDOW, TABLE_ROWS, TABLE_CHARS, COUNTERS = 3, 6, 200_000, 60, 150_000
#: Weight of a planted example in the fit.
PLANTED_WEIGHT = 0.5

TOKEN = re.compile(r"[\w*@$!+]+")
EDGE = "*@$!+_"
STRETCHED = re.compile(r"(.)\1{2,}")
# Marks of quotation, verbs that report speech, second persons.
QUOTES = "\"“”„«»‹›‘"
REPORTS = frozenset("said says say saying quote quoted quotes wrote writes written called calling term word slur sagte schrieb nannte wort dit écrit mot appelé dijo escribió llamó palabra".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted vosotros ustedes".split())


def normal(token: str) -> str:
    token = token.strip(EDGE)
    return STRETCHED.sub(r"\1", token) if len(token) > 3 else token


def allowed(term: str) -> int:
    """Edits at which a word still counts as the term."""
    n = len(term)
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """The determinised Levenshtein automaton over a lexicon's trie. States are made as words need them."""

    MOST_STATES = 40_000

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]  # edits allowed where a term ends, else -1
        for term in terms:
            at = 0
            for ch in term:
                if ch not in self.child[at]:
                    self.child[at][ch] = len(self.child)
                    self.child.append({})
                    self.whole.append(-1)
                at = self.child[at][ch]
            self.whole[at] = allowed(term)
        self.most = list(self.whole)
        for at in range(len(self.child) - 1, -1, -1):  # children have larger numbers
            self.most[at] = max([self.most[at], *(self.most[c] for c in self.child[at].values())])
        self.clear()

    def clear(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.at_end: list[int] = []
        self.start = self.state({0: 0})

    def state(self, positions: dict[int, int]) -> int:
        """The number of a set of (node, fewest edits), after skipping letters of terms at one edit each."""
        todo = list(positions.items())
        while todo:
            node, e = todo.pop()
            for c in self.child[node].values():
                if e < self.most[c] and positions.get(c, 99) > e + 1:
                    positions[c] = e + 1
                    todo.append((c, e + 1))
        key = frozenset(positions.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(positions)
            self.moves.append({})
            self.at_end.append(min((e for n, e in positions.items() if e <= self.whole[n]), default=-1))
        return self.ids[key]

    def step(self, state: int, ch: str) -> int:
        after: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and after.get(node, 99) > e:
                after[node] = e

        for node, e in self.sets[state].items():
            put(node, e + 1)
            for letter, c in self.child[node].items():
                put(c, e + (letter != ch))
        self.moves[state][ch] = to = self.state(after)
        return to

    def edits(self, word: str) -> int:
        """Fewest edits between the word and a term that allows them; -1 if none."""
        if len(self.sets) > self.MOST_STATES:
            self.clear()
        state = self.start
        for ch in word:
            to = self.moves[state].get(ch)
            state = self.step(state, ch) if to is None else to
            if not self.sets[state]:
                return -1
        return self.at_end[state]


FEATURES = 6


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    innocent: list[str] = field(default_factory=list)  # words near a term that are none
    weights: list[float] = field(default_factory=lambda: [-20.0] + [0.0] * FEATURES)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)))


class Reader:
    """What a worker keeps while it reads texts with one lexicon."""

    def __init__(self, terms: list[str], innocent: list[str]):
        self.automaton, self.innocent = Automaton(terms), frozenset(innocent)
        self.known: dict[str, int] = {}

    def hit(self, token: str) -> int:
        """0: no term; else 1 + edits."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= TABLE_ROWS:
                self.known.clear()
            word = normal(token)
            found = 0 if len(word) < LEAST_LETTERS or word in self.innocent else 1 + self.automaton.edits(word)
            if len(token) <= TABLE_CHARS:
                self.known[token] = found
        return found

    def changed(self, text: str) -> tuple[str, str]:
        """The text with each term in it misspelled, and with each term quoted."""
        text = text.lower()
        wrong: list[str] = []
        quoted: list[str] = []
        at = 0
        for n, m in enumerate(TOKEN.finditer(text)):
            if self.hit(m[0]):
                wrong += [text[at : m.start()], misspelled(m[0], n)]
                quoted += [text[at : m.start()], f'said "{m[0]}"']
                at = m.end()
        return "".join([*wrong, text[at:]]), "".join([*quoted, text[at:]])

    def features(self, text: str) -> list[float]:
        """Logs of: abuse in exact hits, in misspelled ones; quotation in exact, in misspelled; abuse for each hundred tokens; the share of abuse."""
        text = text.lower()
        tokens = TOKEN.findall(text)
        known = self.known
        hits = [known[t] if t in known else self.hit(t) for t in tokens]
        if not any(hits):
            return [0.0] * FEATURES
        spans = [m.span() for m in TOKEN.finditer(text)]
        abuse, quotes = [0.0, 0.0], [0.0, 0.0]
        for i, h in enumerate(hits):
            if h:
                lo, hi = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
                near = {normal(t) for t in tokens[lo:hi]}
                before, after = text[spans[lo][0] : spans[i][0]], text[spans[i][1] : spans[hi - 1][1]]
                marked = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
                quoted = 0.6 * marked + 0.4 * bool(near & REPORTS)
                if near & SECOND:
                    quoted *= 0.5
                abuse[h > 1] += 1 - quoted
                quotes[h > 1] += quoted
        a, q = sum(abuse), sum(quotes)
        return [*np.log1p([*abuse, *quotes, 100 * a / len(tokens)]).tolist(), a / (a + q)]


def misspelled(word: str, n: int) -> str:
    """The word with one edit that word and n choose: a letter left out, put in, or replaced by a sign or another letter."""
    h = xxhash.xxh64_intdigest(f"{n} {word}")
    at, other = 1 + h // 4 % max(1, len(word) - 1), "*1xzaeo"[h // 1024 % 7]
    return word[:at] + ("", other + word[at : at + 1], other, other)[h % 4] + word[at + 1 :]


def reader(terms: list[str], innocent: list[str]) -> Reader:
    return worker_state("toxicity", (tuple(terms), len(innocent)), lambda: Reader(terms, innocent))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, half): the labelled documents outside the held-out fold, at most `rows` of them, in two halves."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marks = marks.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(rows)
    marks = marks.select("doc_id", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("half"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the chosen ids are at most SAMPLE_ROWS
    return own.join(F.broadcast(marks), "doc_id").select("text", "toxic", "half")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, half, toxic, n, seen): documents that hold a term, and a sketch of the words before it (a bit for each of 64 hashes); summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*[(*k, c, seen[k] - (1 << 64) if seen[k] >> 63 else seen[k]) for k, c in n.items()], strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            n.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["term", "half", "toxic", "n", "seen"])

        for b in batches:
            for text, toxic, half in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                before, bit = {}, 1
                for m in TOKEN.finditer(text.lower()):
                    t = m[0]
                    before[t] = before.get(t, 0) | bit
                    bit = 1 << (xxhash.xxh32_intdigest(t) & 63)
                held: dict[str, int] = {"": 0}
                for t, bits in before.items():
                    w = normal(t)
                    if len(w) >= LEAST_LETTERS and w.isalpha():
                        held[w] = held.get(w, 0) | bits
                for term, bits in held.items():
                    n[term, half, toxic] += 1
                    seen[term, half, toxic] |= bits
                if len(n) > COUNTERS:
                    yield flush()
        yield flush()

    kinds = "term string, half int, toxic int, n long, seen long"
    return in_arrow(rows, "toxicity", run, kinds).groupBy("term", "half", "toxic").agg(F.sum("n").alias("n"), F.bit_or("seen").alias("seen"))


def _sides(sums: DataFrame, halves: tuple[int, ...]) -> DataFrame:
    """(term, a, b): toxic and clean documents of these halves that hold a term; a is at most the number of different words before it, as copies of one text tell no more than one."""
    a, b = (sum((F.col(f"{x}{h}") for h in halves[1:]), F.col(f"{x}{halves[0]}")) for x in "ab")
    bits = F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"seen{h}") for h in halves]))
    different = F.when(bits <= 48, F.round(-64 * F.log(1 - bits / 64))).otherwise(F.lit(2.0**53))
    return sums.select("term", F.least(a.cast("double"), different).alias("a"), b.cast("double").alias("b"))


def lexicons(counts: DataFrame) -> list[tuple[list[str], list[str]]]:
    """(terms, innocent words near them) of half 0, of half 1 and of both.

    A term marks toxicity if it is LEAST_LIFT times likelier in toxic documents and relative entropy, which bounds the chance of so
    many toxic ones among those that hold it, leaves less than FALSE_TERMS to chance over all words. Every such term comes to the
    driver: a part of the words of SAMPLE_ROWS texts.
    """
    is_ = lambda h, t: (F.col("half") == h) & (F.col("toxic") == t)
    sums = cut(counts.groupBy("term").agg(
        *[F.coalesce(F.sum(F.when(is_(h, t), F.col("n"))), F.lit(0)).alias(f"{'ba'[t]}{h}") for h in (0, 1) for t in (0, 1)],
        *[F.coalesce(F.max(F.when(is_(h, 1), F.col("seen"))), F.lit(0)).alias(f"seen{h}") for h in (0, 1)],
    ))
    total = sums.filter("term = ''").first()
    if total is None:
        return [([], [])] * 3
    weighed = sums.filter((F.col("term") != "") & (F.col("a0") + F.col("a1") + F.col("b0") + F.col("b1") >= LEAST_DOCS))
    surprise = float(np.log(max(1, weighed.count()) / FALSE_TERMS))
    found = []
    for halves in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(total[f"{x}{h}"] for h in halves) for x in "ab")
        if not toxic or not clean:
            found.append(([], []))
            continue
        sides, base = _sides(weighed, halves), toxic / (toxic + clean)
        a, b = F.col("a"), F.col("b")
        lift = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
        p = a / (a + b)
        gain = a * F.log(p / base) + F.when(b > 0, b * F.log((1 - p) / (1 - base))).otherwise(0.0)
        terms = sorted(r["term"] for r in sides.filter((a >= LEAST_DOCS) & (lift >= LEAST_LIFT) & (p > base) & (gain >= surprise)).select("term").collect())
        found.append((terms, _innocent(_sides(sums, halves).filter((F.col("term") != "") & (b > 0) & (lift < LEAST_LIFT)).select("term"), terms)))
    return found


def _innocent(words: DataFrame, terms: list[str]) -> list[str]:
    """Those of the words that the automaton takes for misspelled terms: few of the sample's words."""
    if not terms:
        return []

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        for b in batches:
            yield b.filter(pa.array([automaton.edits(w) > 0 for w in b.column("term").to_pylist()], pa.bool_()))

    return sorted(r["term"] for r in in_arrow(words, "toxicity", near, "term string").collect())


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1) -> list[float]:
    """Logistic regression by Newton steps; the intercept is not penalised, and the other weights only slightly."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [penalty] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled documents outside the held-out fold.

    The lexicon of one half gives the features of the other, so that the weights are learned on terms found elsewhere;
    the model's own lexicon is of both halves. Without labels of both kinds every score is the same: the share of toxic
    labels, 0 if there are none.
    """
    tune(docs.sparkSession)
    chosen = cut(sample(docs, labels, rows))
    *halves, whole = lexicons(term_counts(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, weight = [], [], []
            for t, toxic, h in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                r = reader(*halves[1 - h])
                own = r.features(t)
                x.append(own)
                y.append(toxic)
                weight.append(1.0)
                if toxic and any(own):
                    wrong, quoted = r.changed(t)
                    both = r.changed(wrong)[1]
                    planted = [(1, r.features(wrong)), (0, r.features(quoted)), (0, r.features(both))]
                    planted = [(k, f) for k, f in planted if any(f)]  # short terms allow no edit
                    x += [f for _, f in planted]
                    y += [k for k, _ in planted]
                    weight += [PLANTED_WEIGHT] * len(planted)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(weight, pa.float64())], names=["x", "toxic", "weight"])

    found = in_arrow(chosen, "toxicity", run, "x array<double>, toxic int, weight double").collect()  # 4 x SAMPLE_ROWS at most
    y, weight = np.array([r["toxic"] for r in found], float), np.array([r["weight"] for r in found])
    if not len(y):
        return Model()
    if y.min() == y.max():
        return Model([], [], [30.0 if y[0] else -30.0] + [0.0] * FEATURES)
    return Model(*whole, fit(np.array([r["x"] for r in found]), y, weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null text: as empty, which scores as any text without a term. Texts of any length are read whole. Repeated rows
    give repeated results, a null doc_id stays null (and is not held out), other columns are not looked at, an empty table gives no rows.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader(model.terms, model.innocent)
        for b in batches:
            texts = b.column("text").to_pylist()
            s = model.score(np.array([r.features(t) for t in texts], float).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return in_arrow(rows, "toxicity", run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model predicts toxic; columns as they are.

    Null text: as empty. Repeated rows stay or go alike, texts of any length are read whole, an empty table gives no rows.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader(model.terms, model.innocent)
        for b in batches:
            s = model.score(np.array([r.features(t or "") for t in b.column("text").to_pylist()], float).reshape(-1, FEATURES))
            yield b.filter(pa.array(s < 0.5))

    return in_arrow(docs, "toxicity", run, docs.schema)
