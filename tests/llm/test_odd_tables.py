"""Extra columns with clashing names, empty tables and texts beyond a megabyte, for the operators that other files don't try with them."""

import random

import pytest
from pyspark.sql import functions as F

from lettermill.llm import centroids, licenses, maxscore, periodic, sharding, toxicity, url_filter

LONG = 1_200_000


def clashing(df):
    """df with columns whose names the operators use inside."""
    names = ["key", "rank", "score", "query_id", "host", "path", "rule", "verdict", "u", "ids", "vectors", "digest", "license", "size", "part", "item", "vector", "runs", "best", "toxic", "half", "label"]
    return df.select("*", *[F.lit(7).alias(c) for c in names if c not in df.columns])


def test_top_k(spark):
    r = random.Random(1)
    e = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(120)] + [(3, [0.5] * 5), (None, [0.1] * 5)], "vec_id long, embedding array<float>")
    plain, odd = maxscore.quantised(e), maxscore.quantised(clashing(e))
    got = [sorted(map(tuple, maxscore.top_k(v, v.filter("vec_id % 10 = 0"), 4).select("query_id", "rank", "vec_id", "score").collect())) for v in (plain, odd)]
    assert got[0] == got[1] and len(got[0]) == 48
    none = maxscore.quantised(e.limit(0))
    assert maxscore.top_k(none, none, 4).isEmpty()


def test_license_scan(spark):
    text = dict(licenses.known_texts())["MIT"] if "MIT" in dict(licenses.known_texts()) else licenses.known_texts()[0][1]
    long = "word " * (LONG // 5)
    docs = spark.createDataFrame([(1, text), (2, long), (3, long + "\n" + text), (None, None), (1, text)], "doc_id long, text string")
    got, odd = (sorted(map(str, licenses.scan(d).collect())) for d in (docs, clashing(docs)))
    assert got == odd and len(got) == 5
    known = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert {i for i, name in known if name is not None} == {1} and (2, None) in known and licenses.scan(docs.limit(0)).isEmpty()


def test_url_filter(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    tail = "a" * LONG
    pages = spark.createDataFrame([(1, f"http://Example.net/en/{tail}"), (2, f"http://x.example.net/fr/{tail}"), (3, f"http://{'h.' * 50}org/fr/"), (4, None), (5, "example.net"), (1, f"http://Example.net/en/{tail}")], "page_id long, url string")
    got, odd = (sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in url_filter.filter_urls(p, rules, ranges=3).collect()) for p in (pages, clashing(pages)))
    assert got == odd == [(1, "example.net/en/", "allow"), (1, "example.net/en/", "allow"), (2, "net/", "block"), (3, "org/fr/", "allow"), (4, "", "allow"), (5, "", "allow")]
    assert url_filter.filter_urls(pages.limit(0), rules).isEmpty()
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_toxicity(spark):
    r = random.Random(2)
    words = [f"w{k}x" for k in range(200)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, say(30) + (" awfulterm " if i % 4 == 0 else " ") + say(30)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    rows += [(900, say(LONG // 5)), (901, say(LONG // 5) + " awfulterm awfulterm " + say(10)), (902, ""), (903, None), (None, "awfulterm awfulterm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, labels)
    got, odd = (sorted(map(str, toxicity.score(d, m).collect())) for d, m in ((docs, model), (clashing(docs), toxicity.learn(clashing(docs), clashing(labels)))))
    assert got == odd and len(got) == len(rows)
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert predicted[900] == predicted[902] == predicted[903] == 0 and predicted[236] == 1
    assert toxicity.score(docs.limit(0), model).isEmpty()


@pytest.mark.parametrize("n", [0, 5])
def test_new_operators_with_clashing_names(spark, n):
    docs = spark.createDataFrame([(i, "a b " * 20 + str(i % 2)) for i in range(5)], "doc_id long, text string").limit(n)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(periodic.summary(periodic.collapse(docs)), periodic.summary(periodic.collapse(clashing(docs))))
    assert same(sharding.place(docs, 4).drop("slot"), sharding.place(clashing(docs), 4).drop("slot"))
    e = spark.createDataFrame([(i, [float(i)] * 64) for i in range(5)], "vec_id long, embedding array<float>").limit(n)
    assert same(centroids.cluster(e), centroids.cluster(clashing(e)))


def test_new_operators_on_very_long_texts(spark):
    long = " ".join(f"u{k}" for k in range(LONG // 8)) + " x y z" * 5000
    docs = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    one = periodic.summary(periodic.collapse(docs)).filter("doc_id = 1").first()
    assert (one["n_runs"], one["start"], one["length"], one["period"]) == (1, LONG // 8, 15000, 3)
    assert {r["doc_id"]: r["size"] for r in sharding.place(docs).collect()} == {1: len(long) + 16, 2: 16}
