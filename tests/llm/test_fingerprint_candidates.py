import numpy as np

from lettermill.llm import bktree


def test_near_groups_find_candidates_by_the_trees(spark, monkeypatch):
    """The trees' links of copies are made and are among the candidates; other texts stay apart."""
    r = np.random.default_rng(3)
    base = [f"w{k}" for k in r.integers(0, 5000, 600)]
    texts = [base, [*base, "tail"], [f"v{k}" for k in r.integers(0, 5000, 600)]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    made = []
    whole = bktree.fingerprint_links
    monkeypatch.setattr(bktree, "fingerprint_links", lambda found: made.append(whole(found)) or made[0])
    assert {(x["id"], x["component"]) for x in bktree.near_groups(docs).collect()} == {(1, 0)}
    assert {tuple(sorted((x["a"], x["b"]))) for x in made[0].collect()} == {(0, 1)}
