"""Storing, verifying, evidence and safe HTML."""

import hashlib
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lettermill.functions import html, storage
from lettermill.functions.mail import semantic_bytes
from lettermill.operators import identity, verify
from lettermill.sources import containers, sinks

RAW = [b"Subject: %d\nDate: Tue, 2 Mar 1999 10:00:00 +0000\n\nbody\nFrom here\n>From there\n" % k for k in range(4)] + [b"Subject: none\n\nno end"]


def test_stored_records_can_be_read_back():
    for raw in RAW:
        record = storage.stored(raw, storage.envelope(raw))
        assert b"\nFrom " not in record and storage.recovered(record, hashlib.sha256(raw).hexdigest()) == raw
    assert storage.recovered(record, "0" * 64) is None


def test_envelopes():
    assert storage.envelope(RAW[0], sender="a b") == b"From MAILER-DAEMON Tue Mar  2 10:00:00 1999\n"
    assert storage.envelope(b"x", datetime(2001, 12, 31, 1, 2, 3), "a@b") == b"From a@b Mon Dec 31 01:02:03 2001\n"


def test_json():
    assert storage.strict_json('{"a":1,"b":[]}') == {"a": 1, "b": []}
    for bad in ('{"a":1,"a":1}', '{"b":1,"a":1}', '{"a": 1}'):
        with pytest.raises(ValueError):
            storage.strict_json(bad)


def test_write_verify_read(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(k, datetime(1999 + k % 2, 3, 2), "Archive" if k < 4 else "INFECTED", "a@b", bytearray(r), f"id{k}\t", sha(r), sha(semantic_bytes(r))) for k, r in enumerate(RAW)]
    m = spark.createDataFrame(rows, "position long, date timestamp_ntz, category string, sender string, raw binary, message_id string, sha256 string, semantic_sha256 string")
    records = sinks.framed(m)
    sinks.write_mailboxes(records, str(tmp_path / "out"))
    folder = tmp_path / "out"
    assert {p.name for p in folder.iterdir() if p.is_dir()} == {"mailbox=1999-Archive1.mbox", "mailbox=2000-Archive1.mbox", "mailbox=INFECTED1.mbox"}
    whole = b"".join(p.read_bytes() for p in sorted((folder / "mailbox=1999-Archive1.mbox").glob("part-*")))
    at = {r["position"]: r for r in sinks.locations(records).collect()}
    assert whole[at[2]["byte_offset"] :][: at[2]["byte_length"]] == storage.stored(RAW[2], storage.envelope(RAW[2], sender="a@b"))
    (folder / "again").mkdir()
    (folder / "again/x.mbox").write_bytes(whole)
    found = containers.records(containers.discover(spark, str(folder / "again"))).orderBy("position").collect()
    assert [storage.recovered(bytes(r["envelope"]) + bytes(r["raw"]), sha(RAW[k])) for r, k in zip(found, (0, 2), strict=True)] == [RAW[0], RAW[2]]
    ordinal = records.join(sinks.locations(records).select("mailbox", "position", "ordinal"), ["mailbox", "position"])
    expected = ordinal.select("mailbox", "ordinal", "sha256", "semantic_sha256")
    assert verify.verified(verify.record_faults(expected, ordinal.select("mailbox", "ordinal", "record")))
    broken = ordinal.select("mailbox", "ordinal", F.when(F.col("position") == 1, F.lit(b"From x\nother\n")).otherwise(F.col("record")).alias("record")).filter("mailbox <> 'INFECTED1.mbox'")
    faults = {(r["mailbox"], r["fault"]) for r in verify.record_faults(expected, broken).collect()}
    assert faults == {("2000-Archive1.mbox", "raw hash mismatch"), ("INFECTED1.mbox", "missing record")}
    lines = {(r["mailbox"], r["ordinal"]): r["line"] for r in sinks.integrity_rows(records).collect()}
    assert lines["1999-Archive1.mbox", 2] == f'2\t"id2\\t"\th2:{sha(RAW[2])}\th3:{sha(semantic_bytes(RAW[2]))}'


def test_manifest_faults(spark):
    files = spark.createDataFrame([("data/a%b", bytearray(b"1")), ("data/c", bytearray(b"2")), ("data/new", bytearray(b"3"))], "path string, content binary")
    good = sinks.manifest_lines(files)
    assert verify.verified(verify.manifest_faults(good, files))
    assert sinks.oxum(files.select("path", F.length("content").alias("length"))).first()["oxum"] == "3.3"
    bad = good.filter("line NOT LIKE '%new'").union(spark.createDataFrame([("0" * 64 + "  data/c",), ("nonsense",), ("0" * 64 + "  data/../x",), ("0" * 64 + "  other",), ("0" * 64 + "  data/gone",)], "line string"))
    got = {(r["path"], r["fault"]) for r in verify.manifest_faults(bad, files).collect()}
    assert got == {("data/c", "listed more than once"), ("data/c", "hash mismatch"), ("nonsense", "malformed row"), ("data/../x", "unsafe path"), ("other", "out of scope"), ("data/gone", "missing file"), ("data/new", "not in manifest")}


def test_split_rows(spark):
    got = sinks.split_rows(spark.range(1000).repartition(7), "id", 300).groupBy("file").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("file").collect()
    assert [(r["file"], r["a"], r["b"]) for r in got] == [(0, 0, 299), (1, 300, 599), (2, 600, 899), (3, 900, 999)]


def test_schema_faults(spark):
    assert verify.schema_faults(spark.range(1), "id long") == []
    assert set(verify.schema_faults(spark.range(1), "id string, x int")) == {"missing x", "id is bigint, not string"}


def test_safe_html():
    shown, blocked = html.sanitized('<p onclick="x()">a<script>bad()</script><a href="javascript:x">b</a><a href="https://c">d</a><img src="http://e/f.png"><img src="cid:g"></p>', {"g": "data:image/png;base64,xx"})
    assert blocked and "bad" not in shown and "onclick" not in shown and "javascript" not in shown
    assert '<a href="https://c">d</a>' in shown and "data:image/png" in shown and "http://e" not in shown
    assert html.sanitized('<img src="http://e/f.png">', remote=True)[1] is False


BLOCKS = {
    "Hi\n-- \nAnn B. O'Neil-Smith\n\nann@x.org, http://x.org/a.\nTel +1 (555) 123-4567\n12 34\n": ("delimiter", 2, 6, ["Ann B. O'Neil-Smith", "ann@x.org, http://x.org/a.", "Tel +1 (555) 123-4567", "12 34"]),
    "Hi\n\nGet Outlook for iOS\n\n": ("mobile-footer", 2, 2, ["Get Outlook for iOS"]),
    "Hi\nBest,\n\nAnn\nann@x.org\nCompany\n\nps\n": ("contact-block", 1, 5, ["Best,", "Ann", "ann@x.org", "Company"]),
    "\n".join(f"l{k}" for k in range(30)) + "\nwww.x.org": ("contact-block", 19, 30, [f"l{k}" for k in range(19, 30)] + ["www.x.org"]),
    "www.x.org\n" + "\n".join(f"l{k}" for k in range(30)): None,
    "www.x.org\n" + "\n".join(f"l{k}" for k in range(29)): ("contact-block", 0, 11, ["www.x.org", *(f"l{k}" for k in range(11))]),
    "Hi\n\nRegards\nAnn": ("signoff", 2, 3, ["Regards", "Ann"]),
    "Hi\n\nRegards\n\nAnn Bee\n1\n2": ("signoff", 2, 5, ["Regards", "Ann Bee", "1"]),
    "Hi\n\nRegards\nfax": None,
    "Thanks\nAnn\n3\n4\n5\n6\n7": None,
    "Hi\n> -- \n> Bob": None,
    "Hi\n==\n \n": None,
    "": None,
}


def test_signatures(spark):
    bodies = [*BLOCKS, None]
    found = identity.evidence(spark.createDataFrame(list(enumerate(bodies)), "pk int, body string"))
    got = {r["pk"]: (r["kind"], r["start_line"], r["end_line"], r["lines"]) for r in found.collect()}
    for k, body in enumerate(bodies):
        assert got.get(k) == BLOCKS.get(body), body
    assert not re.search("Python|Arrow", found._jdf.queryExecution().executedPlan().toString())
    first = [(r["line"], r["kind"], r["value"], r["normalized"], round(r["confidence"], 6)) for r in identity.facts(found).filter("pk = 0").orderBy("ordinal").collect()]
    assert first == [
        (0, "text", "Ann B. O'Neil-Smith", "ann b. o'neil-smith", 0.98), (0, "name-candidate", "Ann B. O'Neil-Smith", "ann b. o'neil-smith", 0.686), (1, "text", "ann@x.org, http://x.org/a.", "ann@x.org, http://x.org/a.", 0.98),
        (1, "email", "ann@x.org", "ann@x.org", 0.98), (1, "url", "http://x.org/a.", "http://x.org/a", 0.98), (2, "text", "Tel +1 (555) 123-4567", "tel +1 (555) 123-4567", 0.98), (2, "phone", "+1 (555) 123-4567", "+15551234567", 0.931), (3, "text", "12 34", "12 34", 0.98),
    ]


def test_evidence_of_messages(spark, tmp_path):
    raw = b"From: =?utf-8?q?J=C3=B6rg_Stra=C3=9Fe?= <J@X.org>\nTo: a@x.org, \"B, C\" <b@x.org>\nTo: c@x.org\nBcc: <>\nReply-To: r@x.org\nX-BeenThere: l\nPrecedence: bulk\n\nHi\n--\nAnn\n"
    sha = hashlib.sha256(raw).hexdigest()
    m = spark.createDataFrame([(1, bytearray(raw), sha), (2, bytearray(raw), "0" * 64), (3, None, None)], "pk long, raw binary, sha256 string")
    tables = identity.relations(m)
    people = [tuple(r) for r in tables["header_observations"].collect()]
    assert people == [(1, "from", 0, "j@x.org", "Jörg Straße", "jörg strasse"), (1, "to", 0, "a@x.org", "", ""), (1, "to", 1, "b@x.org", "B, C", "b, c"), (1, "to", 2, "c@x.org", "", "")]
    assert [tuple(r) for r in tables["message_markers"].collect()] == [(1, "precedence", 0, "bulk"), (1, "x-beenthere", 0, "l"), (1, "reply-to", 0, "r@x.org")]
    assert [(r["pk"], r["error"]) for r in tables["extraction_errors"].collect()] == [(2, "ValueError: digest differs from the catalogue")]
    s = identity.summary(tables).first()
    assert s.asDict() == {"messages": 2, "errors": 1, "header_observations": 4, "message_markers": 3, "distinct_addresses": 4, "distinct_nonempty_names": 2, "signature_blocks": 1, "signature_facts": 2}
    root = str(tmp_path / "evidence")
    for _ in range(2):  # a run repeated on one shard changes nothing
        identity.merge(m, "a", root)
        identity.merge(m.filter("pk = 3"), "b", root)
        again = identity.summary({t: identity.read(spark, root, t) for t in identity.TABLES}).first()
        assert again.asDict() == s.asDict() | {"messages": 3}
    identity.merge(m.filter("pk > 9"), "a", root)
    assert identity.read(spark, root, "messages").count() == 1 and identity.read(spark, root, "signature_facts").isEmpty()



def test_correlation(spark):
    asked = identity.requests(spark.createDataFrame([(1, "a"), (2, "b")], "pk long, prompt string"), "m").persist()
    answers = asked.select("id", F.lit("yes").alias("answer"))
    assert identity.correlate(asked, answers).count() == 2
    with pytest.raises(Exception, match="repeated result"):
        identity.correlate(asked, answers.union(answers)).collect()
    with pytest.raises(Exception, match="missing result"):
        identity.correlate(asked, answers.limit(1)).collect()
