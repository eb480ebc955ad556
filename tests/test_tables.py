"""The archive's tables, review sets, settings and exports; what ingest and safe HTML must not lose."""

import hashlib
import itertools
import zipfile
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lettermill.functions import charset, html, settings, storage, text
from lettermill.functions.framing import ENVELOPE
from lettermill.operators import archive, provenance, quality, reconcile, reports, search, verify
from lettermill.sources import exports, sinks
from lettermill.streaming import ingest

FROM = b"From a@x Tue Mar  2 10:00:00 1999\n"


def message(n, date=b"Date: Tue, 2 Mar 1999 10:00:00 +0200\n"):
    return b"From: a@x\n%sMessage-ID: <%d@x>\n\nbody %d\n" % (date, n, n)


def test_resumed_mailbox_inherits_the_catalogued_date(spark, tmp_path):
    assert ENVELOPE.fullmatch(FROM.strip())
    source, target = tmp_path / "in" / "2001", str(tmp_path / "out")
    source.mkdir(parents=True)
    (source / "a.mbox").write_bytes(FROM + message(1) + b"\n")
    assert ingest.ingest(spark, str(tmp_path / "in"), target, 1) == 1
    with (source / "a.mbox").open("ab") as f:
        f.write(FROM + message(2, b"") + b"\n" + FROM + message(3) + b"\n")
    assert ingest.ingest(spark, str(tmp_path / "in"), target, 2) == 1
    got = {r["message_id"]: (r["date"], r["date_source"]) for r in spark.read.parquet(f"{target}/messages").filter("batch = 2").collect()}
    assert got == {"2@x": (datetime(1999, 3, 2, 8), "previous-message"), "3@x": (datetime(1999, 3, 2, 8), "date")}


def test_html_behind_void_and_unclosed_elements():
    show = lambda x: html.sanitized(x)[0].removeprefix(html.POLICY)
    assert show("<p>a</p><embed src=x><p>rest</p>") == "<p>a</p><p>rest</p>"
    assert show("<form action=x><p>a</p><p>b</p>") == "<p>a</p><p>b</p>"
    assert show("<form><p>a</p></form><p>b</p>") == "<p>b</p>"
    assert show("<frameset><frame src=x></frameset><p>a</p>") == "<p>a</p>"
    assert show("a<script>bad()</script>b<script>bad()") == "ab"
    assert show("<object><form></object><p>a</p>") == "<p>a</p>"


@pytest.mark.parametrize("lines", [0, 1, 3, 12, 14])
def test_stored_readings(lines):
    """Every message that a record can have stored is found: its own quote marks, line ends and envelope."""
    raw = b"Subject: x\n\n" + b"".join(b">" * (k % 3) + b"From here %d\nplain\n" % k for k in range(lines))
    for tail in (b"", b"end", b"end\n"):
        for own in (raw + tail, FROM + raw + tail):
            record = storage.stored(own, FROM) if own[:5] != b"From " else FROM + storage.stored(raw + tail, FROM)[len(FROM) :]
            want = own if own[:5] != b"From " else FROM + raw + tail
            sha = hashlib.sha256(want).hexdigest()
            if own[:5] == b"From " and lines:  # the envelope belongs to it, and its body is as it is stored
                sha = hashlib.sha256(want := record).hexdigest()
            assert storage.recovered(record, sha) == want
    quoted = FROM + b"Subject: x\n\n>From a\n>>From b\n>From c\n"
    for choice in itertools.product((b"", b">"), repeat=3):
        want = b"Subject: x\n\n%sFrom a\n%s>From b\n%sFrom c" % choice
        assert storage.recovered(quoted, hashlib.sha256(want).hexdigest()) == want


def test_charsets_by_how_they_read():
    for words, name in (("안녕하세요 반갑습니다 메일입니다", "euc-kr"), ("你好，這是一封信件，謝謝您的來信", "big5"), ("Grüße aus Köln, schöne Straße", "cp1252"), ("これは日本語のメールです。よろしく", "shift_jis"), ("plain", "ascii")):
        assert charset.decode(words.encode(name))[0] == words
    assert charset.decode(b"\xff\xfe\x00\x01\x81")[0] and charset.codec("no such") is None and charset.codec(' "UTF8" ') == "utf-8"


def test_settings():
    assert settings.owner_rules([" Ann ", "# x", "", "ann", "b*@x.org"]) == ["ann", "b*@x.org"]
    for bad in ("a b", "a@", "@b", "a@b@c", "a;b", "<a>"):
        with pytest.raises(ValueError, match="not a mailbox"):
            settings.owner_rules([bad])
    assert settings.owner_aliases("A@x, b@x ; c@x\n# d@x\n e@x # f\n,;") == ["a@x", "b@x", "c@x", "e@x"]
    assert settings.highlights(search.Terms([("from", "ann"), ("date", "2000-01-01"), ("subject", "Hi")], ["hi", "Ann", "x"])) == ["hi", "Ann", "x"]
    bag = "\n".join(f"{k}: {v}" for k, v in settings.BAG_CONSTANTS.items()) + "\nBagging-Timestamp: 2024-01-02T03:04:05+00:00\nBagging-Date: 2024-01-02\nExternal-Identifier: x\nMailbag-Agent: y\nMailbag-Agent-Version: 1\nPayload-Oxum: 12.2"
    assert settings.bag_faults(bag, 12, 2) == []
    assert settings.bag_faults(bag, 13, 2) == ["Payload-Oxum is not 13.2"]
    assert settings.bag_faults(bag.replace("Date: 2024-01-02", "Date: 2024-01-03"), 12, 2) == ["Bagging-Date is not the date of Bagging-Timestamp"]
    assert settings.bag_faults(bag + "\nBag-Type: Mailbag", 12, 2) == ["invalid or repeated field"] and len(settings.bag_faults("", 0, 0)) == len(settings.BAG_CONSTANTS) + len(settings.BAG_FIELDS) + 2


def test_policy(spark):
    kind = lambda a, p=None: spark.range(1).select(reports.classify(F.lit(a), p)["kind"]).first()[0]
    p = reports.Policy()
    assert kind("no-reply@x.org") == "service" and kind("no-reply@x.org", p.changed("replace", service_locals=[])) == "human"
    assert kind("ann@shop.org") == "human" and kind("ann@shop.org", p.changed("extend", service_domains=[r"^shop\."])) == "service"
    with pytest.raises(ValueError, match="unknown mode"):
        p.changed("x")


def test_exports(spark, tmp_path):
    raw = b"Subject: x\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nhi\n--b\nContent-Type: text/x; name=a\nContent-Transfer-Encoding: base64\n\nYWJj\n--b--\n"
    exports.write_message(raw, str(tmp_path / "m.eml"))
    assert (tmp_path / "m.eml").read_bytes() == raw
    with pytest.raises(FileExistsError):
        exports.write_message(raw, str(tmp_path / "m.eml"))
    exports.write_attachment(raw, 2, str(tmp_path / "a"))
    assert (tmp_path / "a").read_bytes() == b"abc"
    with pytest.raises(ValueError, match="no content"):
        exports.write_attachment(raw, 0, str(tmp_path / "b"))
    m = spark.createDataFrame([(1, "Hi!", bytearray(raw)), (2, "hi?", bytearray(b"y")), (2, "hi?", bytearray(b"y")), (3, None, bytearray(b"z"))], "pk long, subject string, raw binary")
    assert exports.write_bundle(m, str(tmp_path / "z.zip")) == 3
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert sorted(z.namelist()) == ["Hi.eml", "hi-2.eml", "message.eml"] and z.read("Hi.eml") == raw
    with pytest.raises(ValueError, match="2 to"):
        exports.write_bundle(m.filter("pk = 1"), str(tmp_path / "y.zip"))
    rows = m.select("pk", "subject")
    for form, end in (("tsv", "\t"), ("csv", ","), ("json", "{")):
        exports.write_table(rows, str(tmp_path / form), form)
        assert any(end in p.read_text() for p in (tmp_path / form).glob("part*"))


def test_numbers_and_offsets_over_ranges(spark):
    rows = spark.createDataFrame([(f"m{k % 3}", k * 7 % 101, bytearray(b"x" * (k % 5))) for k in range(101)], "mailbox string, position long, record binary").repartition(5)
    assert {r["position"]: r["number"] for r in archive.numbered(rows, "position", ranges=6).collect()} == {k: k + 1 for k in range(101)}
    got = {(r["mailbox"], r["position"]): (r["ordinal"], r["byte_offset"], r["byte_length"]) for r in sinks.locations(rows).collect()}
    want = {}
    for box in ("m0", "m1", "m2"):
        at = 0
        for n, (p, k) in enumerate(sorted((k * 7 % 101, k) for k in range(101) if f"m{k % 3}" == box), 1):
            want[box, p] = (n, at, k % 5)
            at += k % 5 + 1
    assert got == want


def test_selections(spark):
    seen = spark.createDataFrame([(1, "v", "/a/b"), (2, "v", "/ab"), (3, "w", "/a"), (4, "w", "/c/d"), (None, "v", "/a")], "pk long, volume string, path string")
    for chosen in ([("v", "/a")], [(None, "/a")], [("w", None)], [(None, None)], [("v", "/ab"), (None, "/c")], []):
        table = spark.createDataFrame(chosen, "volume string, path string")
        assert {r["pk"] for r in provenance.in_selected(seen, table).collect()} == {r["pk"] for r in provenance.in_mailboxes(seen, chosen).collect()}


def test_nearest_ranks(spark):
    values = {"a": [5, 1, 4, 4, 2, 9, 9, 9, 0, 3, 7], "b": [3], "c": [2, 1]}
    rows = spark.createDataFrame([(g, v) for g, x in values.items() for v in x] + [("a", None)], "g string, v int")
    got = {r["g"]: (r["p10"], r["p50"], r["p95"]) for r in quality.nearest_ranks(rows, "g", "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95}).collect()}
    assert got == {g: tuple(sorted(x)[round((len(x) - 1) * s)] for s in (0.1, 0.5, 0.95)) for g, x in values.items()}


def test_review_set(spark, tmp_path):
    v = spark.createDataFrame([("s", "cache", "r1", "d", "x", True), ("s", "archive", "r1", "d", "x", False), ("s", "archive", "r2", "e", "x", False), ("t", "cache", "r3", "d", None, False)], "semantic string, role string, raw string, date string, subject string, autosave boolean")
    (r,) = reconcile.review_cases(v).collect()
    assert (r["distinct_raw"], r["variants"], r["autosaves"], r["date_agrees"], r["subject_agrees"], r["shared_across_stores"]) == (2, 3, 1, False, True, True)


def test_exported_review_set(spark, tmp_path):
    from lettermill.functions.mail import semantic_bytes
    from lettermill.sources import versions

    sha = lambda b: hashlib.sha256(b).hexdigest()
    one, two = message(1), message(1).replace(b"\n\n", b"\nX-Other: 1\n\n", 1)
    semantic = sha(semantic_bytes(one))
    assert semantic == sha(semantic_bytes(two))
    kind = "semantic string, role string, reference string, pk long, sha256 string, raw binary"
    rows = [(semantic, "cache", "b.emlx", None, sha(one), bytearray(one)), (semantic, "cache", "a.emlx", None, sha(two), bytearray(two)), (semantic, "archive", "m@0+5", 77, sha(two), bytearray(two)), ("other", "cache", "c", None, sha(one), bytearray(one))]
    cases, root = spark.createDataFrame([(1, semantic)], "case_number int, semantic string"), str(tmp_path / "set")
    reconcile.export_review(cases, spark.createDataFrame(rows, kind), root)
    files = {r["file"]: bytes(r["raw"]) for r in versions.read(spark, root, "files").collect()}
    top = f"case-01-h3-{semantic[:16]}"
    assert files == {f"{top}/apple-cache/cache-001-h2-{sha(two)[:16]}.eml": two, f"{top}/apple-cache/cache-002-h2-{sha(one)[:16]}.eml": one, f"{top}/canonical-archive/archive-001-message-77-h2-{sha(two)[:16]}.eml": two}
    assert tuple(versions.read(spark, root, "cases").first()) == (1, semantic, 2, 1, len(one) + 2 * len(two))
    with pytest.raises(FileExistsError):
        reconcile.export_review(cases, spark.createDataFrame(rows, kind), root)
    for broken in ((semantic, "cache", "z", None, sha(one), bytearray(two)), (semantic, "cache", "z", None, sha(message(2)), bytearray(message(2)))):
        with pytest.raises(Exception, match="changed since it was indexed"):
            reconcile.export_review(cases, spark.createDataFrame([*rows, broken], kind), str(tmp_path / "new"))
        assert versions.newest(spark, str(tmp_path / "new")) == 0


def test_discarded_tables(spark):
    from lettermill.tables import cut, discard

    one = cut(spark.range(3))
    two = cut(one.filter("id > 0"))
    discard(one)
    assert two.count() == 2
    with pytest.raises(Exception, match="exist|No such|NOT_EXIST"):
        one.count()


def test_bundles_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    m = spark.createDataFrame([(k, "s", bytearray(b"x" * 100)) for k in range(3)], "pk long, subject string, raw binary")
    monkeypatch.setattr(exports, "MOST_BYTES", 299)
    with pytest.raises(ValueError, match="bytes"):
        exports.write_bundle(m, str(tmp_path / "z.zip"))
    assert exports.write_bundle(m.filter("pk < 2"), str(tmp_path / "z.zip")) == 2


def test_small_columns(spark):
    one = spark.range(1)
    assert one.select(text.trigrams(F.lit("AbcD"))).first()[0] == ["abc", "bcd"] and one.select(text.trigrams(F.lit("ab"))).first()[0] == []
    m = spark.createDataFrame([(1, ""), (2, "a@x")], "pk long, sender string")
    assert [r["pk"] for r in quality.missing_senders(m).collect()] == [1]
    rows = spark.createDataFrame([("a", "c1"), ("a", "c1"), ("b", "c9")], "k string, c string")
    assert verify.csv_faults(rows, spark.createDataFrame([("c1", 2), ("c9", 3)], "c string, records long"), "k", "c").count() >= 2
    assert Counter(r["status"] for r in archive.lookup(m, m.filter("pk = 2").withColumn("sha256", F.lit("x")), spark.createDataFrame([], "pk long, generation int, offset long, length int"), spark.createDataFrame([], "generation int, filename string")).collect()) == {"no-message": 1, "no-location": 1}
