import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, id long, h int, fp long, part int, bin int, rule string"


def make(spark, rows, kind=KIND):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 7, 7, 7, 7, "x") for i, t in rows], kind)


@pytest.fixture(scope="session")
def odd_rows():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, shared = say(120), say(40)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, base), (7, base), (8, base + " tail"), (9, say(60) + " " + shared + " " + say(50)), (10, shared), (11, say(3000)), (12, "a" * 500), (13, "ab" * 300), (14, base.upper()), (None, "no id"), (16, "日本語 テスト <|endoftext|> <s> ▁▁ x\x00y"), (16, "日本語 テスト <|endoftext|> <s> ▁▁ x\x00y"), (17, say(200)), (18, say(10) + "\n" + say(10))]
    edited = base.split()
    edited[60] = "changed"
    return [*rows, (19, " ".join(edited)), (20, say(400) + " " + "ab" * 120), (50, base), (100, say(30))]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
