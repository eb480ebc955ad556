"""Many equal rows of one id, of null ids, and their copies."""

import random

import pytest

import corpus_pipeline
from lettermill.llm import bktree, suffix


def say(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(21)
    base = say(r, 160)  # some 1,100 bytes
    words = base.split()
    words[80] = "changed"
    return base, " ".join(words), say(r, 150)


@pytest.mark.parametrize("one", [5, None])
@pytest.mark.parametrize("hot", [16, 1024])
def test_suffix_dedup(spark, texts, one, hot):
    base, edited, other = texts
    docs = spark.createDataFrame([(one, base)] * 400 + [(9, edited), (10, other)], "doc_id long, text string").repartition(7)
    got = suffix.dedup(docs, 100, hot).collect()
    assert len(got) == 402
    assert {(r["doc_id"], r["n_removed"]) for r in got} == {(one, 0), (9, len(edited) - len("changed")), (10, 0)}
    kept = suffix.without_repeats(docs, 100, hot)
    assert kept.filter("text = 'changed'").count() == 1 and kept.count() == 402


def test_suffix_dedup_of_repeated_rows_that_repeat_others(spark, texts):
    base, edited, _ = texts
    docs = spark.createDataFrame([(1, base)] * 30 + [(2, base)] * 300 + [(3, edited)] * 300 + [(None, edited)] * 2, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["n_removed"]) for r in suffix.dedup(docs, 100).collect()}
    assert got == {(None, 0), (1, len(base) - len(base.split()[80])), (2, len(base)), (3, len(edited))}


@pytest.mark.parametrize("group_rows", [4, 2048])
def test_near_groups(spark, texts, group_rows):
    base, edited, other = texts
    docs = spark.createDataFrame([(5, base)] * 400 + [(9, edited)] * 300 + [(10, other), (11, other)], "doc_id long, text string").repartition(7)
    assert {(r["id"], r["component"]) for r in bktree.near_groups(docs, 0.8, group_rows).collect()} == {(9, 5), (11, 10)}
    assert bktree.one_of_each(docs, 0.8, group_rows).count() == 401


def test_near_groups_of_null_ids(spark, texts):
    base, edited, _ = texts
    r = random.Random(3)
    many = [say(r, 60) for _ in range(40)]
    docs = spark.createDataFrame([(None, t) for t in many for _ in range(5)] + [(None, base)] * 200 + [(7, edited), (8, many[3] + " more"), (9, say(r, 50))], "doc_id long, text string").repartition(6)
    kept = bktree.one_of_each(docs, 0.8, 8)
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["9"] + ["None"] * 400


def test_pipeline(spark, texts, tmp_path):
    base, edited, other = texts
    rows = [(5, base)] * 200 + [(None, other + " " + base[:300])] * 200 + [(9, other[:600])] + [(i, say(random.Random(i), 90)) for i in range(20, 40)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.filter("doc_id = 5").count() == 200 and got.filter("doc_id IS NULL").count() == 200 and got.filter("doc_id >= 20").count() == 20
