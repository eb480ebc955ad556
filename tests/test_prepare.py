"""Corpora by globs, first bytes and counts; messages as text, as index documents and as bag entries."""

import pytest
from pyspark.sql import functions as F

from lettermill.functions import render
from lettermill.sources import prepare, versions
from tests.test_mail_source import mailbox


@pytest.fixture
def corpus(tmp_path):
    top = tmp_path / "corpus"
    (top / "sub/deep").mkdir(parents=True)
    (top / "a.mbox").write_bytes(mailbox(5))
    (top / "sub/b.txt").write_bytes(b"Subject: x\n\ny\n")
    (top / "sub/deep/c.txt").write_bytes(b"no mail\n")
    (top / "sub/d.mbox").write_bytes(mailbox(3, seed=4))
    (top / "r").write_bytes(b"BABYL OPTIONS:\n\x1f\x0c\n0,,\nFrom: a\n\n*** EOOH ***\nFrom: a\n\nhi\n\x1f\x0c\n0,,\nFrom: b\n\n*** EOOH ***\nFrom: b\n\nho\n\x1f")
    return str(top)


@pytest.mark.parametrize(
    ("kind", "include", "exclude", "want"),
    [
        ("messages", ("**/*",), (), {("a.mbox", "eml"): 5, ("d.mbox", "eml"): 3, ("b.txt", "eml"): 1, ("c.txt", "eml"): 1, ("r", "eml"): 1}),
        ("messages", ("*.mbox",), ("sub/*",), {("a.mbox", "eml"): 5}),
        ("messages", ("sub/**/*.txt",), (), {("b.txt", "eml"): 1, ("c.txt", "eml"): 1}),
        ("mailboxes", ("**/*",), (), {("a.mbox", "mbox"): 1, ("d.mbox", "mbox"): 1}),
        ("mixed", ("**/*",), ("?.mbox",), {("b.txt", "eml"): 1, ("r", "eml"): 1}),
        ("rmail", ("**/*",), (), {("a.mbox", "mbox"): 1, ("d.mbox", "mbox"): 1, ("b.txt", "eml"): 1, ("r", "eml"): 2}),
    ],
)
def test_kinds(spark, corpus, kind, include, exclude, want):
    got = prepare.prepared(spark, corpus, kind, include, exclude).groupBy(F.element_at(F.split("source", "/"), -1), "form").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == want


def test_a_wrong_count_writes_nothing(spark, corpus, tmp_path):
    root = str(tmp_path / "out")
    with pytest.raises(ValueError, match="8 rows instead of 9"):
        prepare.prepare(spark, corpus, root, "messages", ("*.mbox",), expected=9)
    with pytest.raises(ValueError, match="no rows"):
        prepare.prepare(spark, corpus, root, "mailboxes", ("*.txt",))
    assert versions.newest(spark, root) == 0
    assert prepare.prepare(spark, corpus, root, "messages", ("*.mbox",), expected=8) == 1
    assert versions.read(spark, root, "prepared").filter("raw IS NULL").isEmpty()


MIXED = b"""From: =?utf-8?q?J=C3=B6rg?= <J@x.org>
To: b@x.org, "B" <B@x.org>
Subject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=
Message-ID: <1@x.org>
 more
X-Other: o
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=q

--q
Content-Type: text/html

<p>one <b>two</b></p>
--q
Content-Type: text/plain
Content-Disposition: attachment; filename=a.txt

attached
--q--
"""


def test_messages_as_text(spark):
    head = "To: b@x.org, \"B\" <B@x.org>\nFrom: Jörg <J@x.org>\nSubject: Grüße"
    assert render.text_view(MIXED) == f"{head}\n\none two\n"
    assert render.text_view(MIXED, html=True) == f"{head}\n\n<p>one <b>two</b></p>\n"
    assert render.text_view(MIXED, full_headers=True).startswith("From: Jörg <J@x.org>\nTo: ") and "X-Other: o\n" in render.text_view(MIXED, full_headers=True)
    assert render.text_view(b"Subject: x\n\n") == "Subject: x\n" and render.text_view(b"") == "\n"
    m = spark.createDataFrame([(1, bytearray(MIXED), "f"), (2, None, "f"), (3, bytearray(b"Content-Type: multipart/mixed; boundary=q\n\nno boundary\n"), "f")], "pk long, raw binary, fallback string")
    assert {r["pk"]: (r["message_id"], r["attachments"]) for r in render.bag_entries(m).collect()} == {1: ("<1@x.org> more", 1), 2: ("", 0), 3: ("", 0)}
    assert "StartBoundaryNotFoundDefect" in render.bag_entries(m).filter("pk = 3").first()["error"]
    d = {r["pk"]: r for r in render.index_documents(m).collect()}
    assert d[1]["content"] == "Jörg <J@x.org>\nb@x.org, \"B\" <B@x.org>\n\nGrüße\n\none two" and d[1]["attachment_text"] == "attached" and d[1]["preview"] == "one two"
    assert [tuple(x) for x in d[1]["suggestions"]] == [("b@x.org", "B"), ("j@x.org", "Jörg")] and [(x["part"], x["filename"]) for x in d[1]["attachments"]] == [(2, "a.txt")]
    assert d[2]["subject"] == "" and render.index_documents(m, False).first()["attachment_text"] == ""
