"""Queries that took too long at size, and a search that left out what it could not try in short."""

import hashlib
import random
import re
import time

from lettermill.functions import mail, signature, storage
from lettermill.operators import identity, quality

FROM = b"From a@x Tue Mar  2 10:00:00 1999\n"


def test_long_words_are_sought_from_their_starts_only(spark):
    texts = spark.range(8).selectExpr("id AS i", "repeat(concat(repeat('é', 80), ' '), 6000) AS text").repartition(4).cache()
    texts.count()

    def seconds(column):
        found = []
        for _ in range(3):
            t = time.perf_counter()
            assert [r[0] for r in quality.text_metrics(texts).select(column).distinct().collect()] == [{"word_count": 6000, "very_long_tokens": 0}[column]]
            found.append(time.perf_counter() - t)
        return min(found)

    assert seconds("very_long_tokens") < 4 * seconds("word_count")


def test_words_are_those_between_white_space(spark):
    r = random.Random(4)
    blanks = [*"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
    ink = [*"aZ!~.\x00\x1b\x7f\x84\x86\x9f\xa1é中\u167f\u1681\u200b\u2027\u202a\u2060\ufeff\uffff\U0001f600"]
    texts = ["".join(r.choice(blanks) if r.random() < 0.2 else r.choice(ink) * r.choice((1, 3, 79, 80, 81, 82)) for _ in range(r.randrange(12))) for _ in range(400)] + ["", *blanks, "x" * 81, "\xa0" + "x" * 80 + "\xa0" + "x" * 81]
    words = [[w for w in re.split("[" + "".join(map(re.escape, blanks)) + "]", t) if w] for t in texts]
    got = quality.text_metrics(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").select("word_count", "very_long_tokens").collect()
    assert [tuple(x) for x in got] == [(len(w), sum(len(x) > 80 for x in w)) for w in words]
    assert sum(x[1] for x in got) > 100


def test_shards_are_replaced_without_a_sort(spark, tmp_path):
    messages = spark.createDataFrame([(k, b"From: a@x\n\nHi\n-- \nAnn Bee\n") for k in range(3)], "pk long, raw binary")
    root = str(tmp_path / "evidence")
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    identity.merge(messages, "a", root)
    plans = [e.physicalPlanDescription() for e in map(store.executionsList().apply, range(first, store.executionsCount()))]
    assert sum("InsertIntoHadoopFsRelationCommand" in p for p in plans) >= 6 and not any("Sort" in p for p in plans if "signature_facts" in p)
    assert {t: identity.read(spark, root, t).count() for t in identity.TABLES} == dict(zip(identity.TABLES, (3, 3, 0, 3, 6, 0), strict=True))
    identity.merge(messages.filter("pk = 1"), "b", root)
    identity.merge(messages.filter("pk > 3"), "a", root)
    assert [(r["pk"], r["shard"]) for t in identity.TABLES for r in identity.read(spark, root, t).select("pk", "shard").distinct().collect()] == [(1, "b")] * 4


def test_plain_messages_of_evidence_need_no_message_objects(monkeypatch):
    raws = [b"From: Ann <C1@X.org>\nTO:  a@x,\n\tB@x\nSubject: s\nto: c@x\nList-Id: =?utf-8?q?tw=C3=B6?=\nX-To: n@x\n\nTo: d@x\n\xc3\xb6\n", b"\nbody", b"A: b\n\n", b"From: \n a@x\n\n"]
    monkeypatch.setattr(mail, "message", None)
    got = [identity._one(x, None) for x in raws]
    assert got[0][1] == [("from", 0, "c1@x.org", "Ann"), ("to", 0, "a@x", ""), ("to", 1, "b@x", ""), ("to", 2, "c@x", "")] and got[0][2] == [("list-id", 0, "twö")] and got[0][3] == "To: d@x\nö\n"
    monkeypatch.undo()
    monkeypatch.setattr(identity, "_pick", lambda _: None)
    assert got == [identity._one(x, None) for x in raws]
    monkeypatch.undo()
    assert [identity._pick(x + b"\n\nb") for x in (b"Content-Type: text/html", b"content-disposition: attachment", b"CONTENT-TRANSFER-ENCODING: base64", b"A: \xff", b"A: b\r")] == [None] * 5


def test_blocks_are_sought_by_falling_sureness_only(spark):
    rows = spark.createDataFrame([(1, "call 555 123 4567\nSent from x\n--\nAnn"), (2, "\x85 a@x.org\xa0 \n　Sent from x  "), (3, " \xa0Best,\n Ann-Lee O'Neil Jr. \x85")], "pk int, body string")
    found = signature.with_block(rows)
    assert [(r["block"]["kind"], r["block"]["lines"]) for r in found.orderBy("pk").collect()] == [("delimiter", ["Ann"]), ("mobile-footer", ["　Sent from x"]), ("signoff", [" \xa0Best,", " Ann-Lee O'Neil Jr."])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN isnull\(_delimiter#\d+\) THEN", plan) and re.search(r"CASE WHEN \(isnull\(_delimiter#\d+\) AND isnull\(_mobile#\d+\)\) THEN", plan)
    names = spark.createDataFrame([(x,) for x in ("Ann", ", Ann B. O'Neil-Smith ,", "a b c d e", "a b c d e f", "a-b-c-d-e", "a-b-c-d-e-f", "A . B", "'", "", "A1", "x" * 61, "Thanks", "My phone", "中 é")], "t string")
    assert [r[0] for r in names.filter(signature.is_name(names.t)).collect()] == ["Ann", ", Ann B. O'Neil-Smith ,", "a b c d e", "a-b-c-d-e", "A . B", "中 é"]


def test_all_readings_of_many_quote_marks_are_tried():
    r = random.Random(6)
    for n in (2, 12, 13, 15):
        for _ in range(4):
            own = [r.random() < 0.5 for _ in range(n)]
            want = b"Subject: x\n\n" + b"".join(b"%sFrom %d\nplain\n" % (b">" * o, k) for k, o in enumerate(own))
            record = FROM + re.sub(rb"(?m)^From ", b">From ", want)  # as mailboxes store it whose quotes are not told from the message's own
            sha = hashlib.sha256(want).hexdigest()
            assert storage.marks(record) == n and storage.recovered(record, sha) == want
            assert storage.recovered(record, sha, first=own[:2]) == want and storage.recovered(record, sha, first=[not own[0]]) is None
            assert storage.recovered(record, sha, alike=True) == (want if len(set(own)) == 1 else None)
    assert storage.recovered(record, "0" * 64) is None


def test_records_of_many_quote_marks_are_dealt_out(spark):
    from lettermill.functions.mail import semantic_bytes
    from lettermill.operators import verify

    sha = lambda x: hashlib.sha256(x).hexdigest()
    raw = b"Subject: x\n\n" + b"".join(b"%sFrom %d\n" % (b">" * (k % 5 == 2 or k == 15), k) for k in range(16))
    record = FROM + re.sub(rb"(?m)^From ", b">From ", raw)
    alike = b"Subject: x\n\n" + b"From x\n" * 40
    right = (sha(raw), sha(semantic_bytes(raw)))
    manifest = [("a", 1, *right), ("a", 2, *right), ("a", 3, right[0], "0" * 64), ("a", 4, sha(alike), sha(semantic_bytes(alike))), ("a", 5, *right), ("b", 1, *right)]
    records = [("a", 1, record), ("a", 2, record + b"x"), ("a", 3, record), ("a", 4, storage.stored(alike, FROM)), ("a", 6, record), ("b", 1, record.replace(b"From 9", b"From 8"))]
    found = verify.record_faults(spark.createDataFrame(manifest, "mailbox string, ordinal int, sha256 string, semantic_sha256 string"), spark.createDataFrame(records, "mailbox string, ordinal int, record binary"))
    assert sorted(map(tuple, found.collect())) == [("a", 2, "raw hash mismatch"), ("a", 3, "semantic hash mismatch"), ("a", 5, "missing record"), ("a", 6, "unexpected record"), ("b", 1, "raw hash mismatch")]
