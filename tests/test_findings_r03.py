"""Steps that grew faster than their input, each held to what it may cost."""

import random

import pyarrow as pa
import pytest

import __spark_entry__  # noqa: F401  registers all queries
from lettermill.operators import search, segments

SF = "/root/testdata/sf0.001"


def test_segments_shuffle_lists_once(spark):
    r = random.Random(3)
    rows = [(pk, " ".join(r.choice(["a", "b", "é", "x1", "-"]) for _ in range(pk % 9))) for pk in range(-5, 9000, 250)] + [(4097, None), (4098, "")]
    messages = spark.createDataFrame(rows, "pk long, body string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # lists of one block come from several batches
    try:
        lists = segments._merged(segments._lists(messages))
        got = [(x["token"], x["block"] * segments.BLOCK + d, list(p)) for x in lists.collect() for d, p in zip(x["docs"], x["positions"], strict=True)]
        keys = [(x["token"], x["block"]) for x in lists.select("token", "block").collect()]
        assert all(list(x["docs"]) == sorted(x["docs"]) for x in lists.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted((x["token"], x["pk"], list(x["positions"])) for x in search.postings(messages).collect())
    assert len(keys) == len(set(keys))
    plan = segments._merged(segments._lists(spark.range(9).selectExpr("id AS pk", "'a b' AS body")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan  # no row for each token


def counted(spark, rows):
    """rows, and an accumulator of how often they were made."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), seen


def test_mailboxes_and_locations_make_each_record_once(spark, tmp_path):
    from lettermill.sources import sinks

    records, seen = counted(spark, spark.range(200).selectExpr("concat(id % 3, '.mbox') AS mailbox", "id AS position", "cast(repeat('From x', 1) AS binary) AS record"))
    sinks.write_mailboxes(records, str(tmp_path / "boxes"))
    assert seen.value == 200
    assert sinks.locations(records).count() == 200 and seen.value == 400


def test_envelopes_of_simple_headers_are_those_of_all_fields(monkeypatch):
    import re

    from lettermill.functions import storage

    dates = [b"Date: Fri, 02 Feb 1996 00:00:00 +0100\n", b"DATE:Mon, 5 Feb 1996\n 01:02:03 -0500\n", b"Received: a; by b;\n\tTue, 6 Feb 1996 10:00:00 GMT\n", b"Resent-Date: nonsense\n", b"Date:\n Sat, 03 Feb 1996 00:00:00 +0000\n", b"X-Date: Fri, 02 Feb 2001 00:00:00 +0100\n", b"Delivery-date: \t Thu, 08 Feb 1996 07:08:09 +0000 \n"]
    r = random.Random(5)
    raws = [b"".join(r.sample(dates, r.randrange(len(dates)))) + end for _ in range(300) for end in (b"\nDate: Fri, 02 Feb 2007 00:00:00 +0000\n", b"", b" \n\nb", b"A: \xff\n\n", b"A: b\r\n\r\n")]
    got = [storage.envelope(x, None, "a@x") for x in raws]
    monkeypatch.setattr(storage, "SIMPLE", re.compile(rb"(?!)"))
    assert got == [storage.envelope(x, None, "a@x") for x in raws]


def test_small_containers_share_batches():
    from lettermill.sources import containers

    class Rows:
        columns = ("path", "kind", "content")
        filter = select = lambda self, *_: self
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    boxes = [{"path": str(k), "kind": "mbox", "content": b"From x\nA: b\n\nc\n\nFrom y\n\nd\n"} for k in range(50)]
    found = list(containers.records(Rows())(iter([pa.RecordBatch.from_pylist(boxes[:30]), pa.RecordBatch.from_pylist(boxes[30:])])))
    assert [b.num_rows for b in found] == [100]
    assert found[0].column("container").to_pylist() == [str(k) for k in range(50) for _ in range(2)]


@pytest.mark.parametrize("name", ["s22_range_reads", "s28_prepared_corpus"])
def test_orders_are_framed_once(spark, monkeypatch, name):
    from lettermill.plans import queries
    from lettermill.sources import sinks

    calls, original = [], sinks.framed
    monkeypatch.setattr(sinks, "framed", lambda m: calls.append(1) or original(m))
    assert queries.QUERIES[name](spark, SF).count() and len(calls) == 1


def test_plain_addresses_need_no_parser(monkeypatch):
    from email.utils import getaddresses

    from lettermill.functions import mail

    r = random.Random(11)
    parts = ["Ann", "B1", " ", " ", "<", ">", "a@x.org", "C_1+d@Ex-a.Org", ",", '"', ".", "@", "é", "\t", "(c)", ";", ":"]
    some = ["Ann <a@x>", "Ann B <a.b@x.org>", "Ann<a@x>", "a@x", "<a@x>", "Ann a@x", "Ann <a@x", "a@x>", "Ann  B <a@x>", "", "Ann <a..b@x>", "Ann <a@x.>", "Ann <a@x>\n"]
    for value in some + ["".join(r.choice(parts) for _ in range(r.randrange(7))) for _ in range(5000)]:
        assert mail.addresses([value]) == tuple(getaddresses([value])), value
        assert mail.addresses([value, "b@y"]) == tuple(getaddresses([value, "b@y"])), value
    mail._kept_addresses.cache_clear()
    monkeypatch.setattr(mail, "getaddresses", None)
    assert mail.addresses(["Ann <C1@Example.org>"]) == (("Ann", "C1@Example.org"),) and mail.addresses([]) == ()


def test_simple_messages_are_read_as_others(monkeypatch):
    import re
    from email import policy
    from email.parser import BytesParser

    from lettermill.functions import mail, render
    from lettermill.operators import identity

    r = random.Random(12)
    lines = [b"From: Ann <C1@Example.org>\n", b"FROM: b@x\n", b"To: s1@example.net, S1@example.net\n", b"Subject:  order\n 1-URGENT\n", b"subject: =?utf-8?q?tw=C3=B6?=\n \n", b"Message-ID: <M1@x>\n", b"Date: Fri, 02 Feb 1996 00:00:00 +0100\n", b"List-Id: one\n", b"list-id:\n two\n", b"X:\n", b"Content-Disposition: attachment; filename=a\n", b"Cc: \xff\n", b"A: b\r\n", b"Content-Transfer-Encoding: base64\n"]
    raws = [b"".join(r.sample(lines, r.randrange(len(lines)))) + end for _ in range(200) for end in (b"\nDear\nFrom here\n", b"\n\n\xc3\xb6", b"", b"\n")]
    read = lambda: [(mail.raw_fields(x), mail.read_message(x), identity._one(x, None), render._document(x, True), render.text_view(x, True), render.bag_entry(x, "f")) for x in raws]
    got = read()
    assert sum(isinstance(mail.message(x), mail.Plain) for x in raws) > 50
    monkeypatch.setattr(mail, "SIMPLE", re.compile(rb"(?!)"))
    monkeypatch.setattr(mail, "header_text", mail._header_text)
    assert type(mail.message(raws[0])) is type(BytesParser(policy=policy.compat32).parsebytes(b""))
    assert got == read()


def test_merged_evidence_finds_blocks_once(spark, tmp_path, monkeypatch):
    from lettermill.operators import identity

    plans, original = [], identity.facts
    monkeypatch.setattr(identity, "facts", lambda found: plans.append(found._jdf.queryExecution().optimizedPlan().toString()) or original(found))
    messages = spark.createDataFrame([(1, b"From: a@x\n\nHi\n-- \nAnn Bee\n")], "pk long, raw binary")
    identity.merge(messages, "a", str(tmp_path / "evidence"))
    assert "RLIKE" not in plans[-1] and [r["normalized"] for r in identity.read(spark, str(tmp_path / "evidence"), "signature_facts").filter("kind = 'name-candidate'").collect()] == ["ann bee"]


def test_dates_are_carried_without_frames_of_a_container(monkeypatch):
    import pandas as pd

    from lettermill.streaming import dates

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    monkeypatch.setattr(pd, "concat", None)
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    state = State()
    turn = lambda *parts: next(dates._carry(("c",), iter([pd.DataFrame(p, columns=["position", "own_date", "path_year"]) for p in parts]), state)).drop(columns="container").values.tolist()
    assert turn([(3, None, 1999), (1, None, 1999)], [(2, "2001-01-01 00:00:00", 1999)]) == [[1, "1999-01-01 00:00:00", "path-year"], [2, "2001-01-01 00:00:00", "date"], [3, "2001-01-01 00:00:00", "previous-message"]]
    assert turn([(4, None, 1999)]) == [[4, "2001-01-01 00:00:00", "previous-message"]] and state.get == ("2001-01-01 00:00:00", 4)
    assert turn([(4, None, 2000), (5, None, 2000)]) == [[4, "2000-01-01 00:00:00", "path-year"], [5, "2000-01-01 00:00:00", "previous-message"]]


def test_simple_parts_are_read_as_email_does(monkeypatch):
    from email import policy
    from email.parser import BytesParser

    from lettermill.functions import mail

    def same(got, want):
        facts = lambda m: (m.items(), m.preamble, m.epilogue, [type(d) for d in m.defects], m.get_content_type(), m.get_content_charset(), m.get_content_disposition(), m.get_filename(), m.get_filename("none"), "content-id" in m, m.is_multipart() or (m.get_payload(), m.get_payload(decode=True)))
        assert facts(got) == facts(want)
        for x, y in zip(got.get_payload(), want.get_payload(), strict=True) if got.is_multipart() else ():
            same(x, y)

    r = random.Random(13)
    outer = [b'Subject: s\nContent-Type: multipart/mixed; boundary="b"\n\n'] * 6 + [b"Content-Type: multipart/mixed;\n\tboundary=b\n\n", b"Content-Type: multipart/mixed\n\n", b'Content-Type: multipart/mixed; boundary="b\n b"\n\n', b"Content-Type: multipart/digest; boundary=b\n\n", b"Content-Transfer-Encoding: base64\nContent-Type: multipart/mixed; boundary=b\n\n", b"Content-Type: text/html\n"]
    lines = [b"--b\n", b"--b--\n", b"--c\n", b"--c--\n", b"\n"] * 5 + [b"--b \n", b"--b--", b"--b", b" --b\n", b"--bb\n", b"hi\n", b"\xc3\xb6\n", b"x\r\n", b"QUJD\n", b"From here\n", b"X: 1\n y\n", b"Content-Transfer-Encoding: base64\n", b"Content-Type: text/html; charset=latin1; name*=utf-8''x%20y\n", b"Content-Type: multipart/mixed; boundary=c\n\n", b"Content-Type: message/rfc822\n\n", b"Content-Disposition: attachment;\n filename=a.exe\n", b"Content-ID: <i>\n"]
    part = lambda: b"--b\n" + b"".join(r.sample(lines[-7:-4] + lines[-2:], r.randrange(3))) + b"\n" + b"".join(r.choices(lines[-14:-7], k=r.randrange(3)))
    raws = [r.choice(outer) + body for _ in range(1500) for body in (b"".join(r.choices(lines, k=r.randrange(16))), b"".join(part() for _ in range(r.randrange(1, 4))) + b"--b--\n" + r.choice([b"", b"\n", b"end"]))]
    nested = b"Content-Type: multipart/mixed; boundary=b\n\npre\n--b\nContent-Type: multipart/alternative; boundary=c\n\n--c\n\nx\n--c\nContent-Type: text/html\n\n<p>\n--c--\n\n\n--b\nContent-Type: image/png; name=\"a b.png\"\n\n1\n--b--\n"
    for raw in [*raws, nested]:
        same(mail.message(raw), BytesParser(policy=policy.compat32).parsebytes(raw))
    monkeypatch.setattr(mail, "BytesParser", None)
    assert [p.get_content_type() for p in mail.message(nested).walk()] == ["multipart/mixed", "multipart/alternative", "text/plain", "text/html", "image/png"]


def test_views_are_built_without_the_parser(monkeypatch):
    from lettermill.functions import mail, view

    monkeypatch.setattr(mail, "BytesParser", None)
    raw = b'Subject: s\nX-A: 1\nx-a: 2\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p onclick=1>x\n--b\nContent-Type: image/png; name="a b.png"\n\nabc\n--b--\n'
    headers, parts = view.show_message(raw)
    assert [h[:2] for h in headers] == [("Subject", 0), ("X-A", 0), ("x-a", 1), ("Content-Type", 0)] and [p[1] for p in parts] == ["html", "attachment"]
    assert view.show_message(raw, only=("headers", "html")) == (headers, parts[:1])


def test_attachments_are_read_without_the_texts(spark, monkeypatch):
    from lettermill.functions import view
    from lettermill.plans import export_queries

    asked, original = [], view.shown
    monkeypatch.setattr(view, "shown", lambda *args, **options: asked.append(options.get("only")) or original(*args, **options))
    assert export_queries.p21_attachments(spark, SF).count() and asked == [("attachment",)]
    monkeypatch.setattr(view, "sanitized", None)
    monkeypatch.setattr(view, "part_text", None)
    raw = b"Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>\n--b\nContent-Type: image/png; name=a\n\nabc\n--b--\n"
    assert view.show_message(raw, only=("attachment",)) == ([], [(2, "attachment", "image/png", "a", False, None, False, b"abc")])
