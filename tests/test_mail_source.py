"""Mailboxes of any size by byte ranges, and sources that grow under a stream."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lettermill.functions import framing
from lettermill.sources import containers, mail, stores


def message(k, more=""):
    return f"From a{k}@b Tue Mar  2 10:00:{k % 60:02d} 1999\nSubject: s{k}\nMessage-ID: <{k}@b>\nDate: Tue, 2 Mar 1999 10:00:{k % 60:02d} +0000\n\nbody {k}\n{more}\n".encode()


def mailbox(n, seed=1):
    r = random.Random(seed)
    return b"".join(message(k, "x" * r.randint(0, 90) + "\n>From quoted\n From indented\n" * r.randint(0, 2)) for k in range(n))


WRAPPED = b"From XXX Tue Mar  2 10:00:00 1999\nStatus: RO\n\n>From inner@b Tue Mar  2 10:00:01 1999\nSubject: w\n\n>From x\n\n"
DOUBLE = b"From outer@b Tue Mar  2 10:00:00 1999\n>From ???@??? Tue Mar  2 10:00:01 1999\nSubject: d\n\nbody\n\n"
MMDF = b"".join(b"\x01\x01\x01\x01\n" + m[:-1] + b"\x01\x01\x01\x01\n" for m in (message(1), WRAPPED, DOUBLE, message(2)))
CASES = [mailbox(40), b"preamble\n" * 3 + b"\n" + mailbox(7), WRAPPED * 3 + mailbox(5) + DOUBLE * 3, MMDF, b"From ", b"From a\n\nFrom b\n\n\nFrom c", mailbox(3).replace(b"\n", b"\r\n"), mailbox(2)[:-30], b"\nFrom x\n"]


def fields(r):
    return r.position, r.raw, r.envelope, r.rule, r.source_sha256, r.exclusion


@pytest.mark.parametrize("content", CASES)
@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_every_split_gives_the_records_of_the_whole(content, chunk, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "CHUNK", chunk)
    path = tmp_path / "a.mbox"
    path.write_bytes(content)
    if framing.kind_of(str(path), content[:4096]) != "mbox":
        monkeypatch.setattr(framing, "kind_of", lambda *a: "mbox")
    want = [fields(r) for r in framing.mbox(content)]
    n = len(content)
    for split in sorted({1, 2, 3, 5, 64, max(1, n // 3), n}) if chunk > 1 else (max(1, n // 3), n):
        got = [row for b in range(0, n, split) for row in mail.read_range(str(path), b, min(b + split, n), n)]
        assert [(r[2], *r[3:8]) for r in got] == want, split
        assert all(r[8] is None for r in got)


def rows(df):
    return sorted((r["container"], r["kind"], r["position"], bytes(r["raw"]), r["envelope"] and bytes(r["envelope"]), r["rule"], r["exclusion"]) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "mail in"
    (top / "sub").mkdir(parents=True)
    (top / "a.mbox").write_bytes(mailbox(60))
    (top / "sub/mmdf").write_bytes(MMDF)
    (top / "one.eml").write_bytes(b"Subject: x\n\ny\n" * 40)
    (top / "sub/2.emlx").write_bytes(b"15\nSubject: e\n\nbodyrest")
    (top / "note.txt").write_text("no mail")
    (top / ".DS_Store").write_bytes(b"x")
    (top / "sub/_x.mbox").write_bytes(mailbox(2))
    return top


@pytest.mark.parametrize("split", [97, 1000, 1 << 30])
def test_source_reads_what_the_containers_hold(spark, folder, split):
    mail.register(spark)
    want = rows(containers.records(containers.discover(spark, str(folder))))
    assert len(want) == 66
    assert rows(spark.read.format("mail").option("split", split).load(str(folder))) == want
    listed = mail.files(spark, str(folder)).withColumn("start", F.lit(0))
    assert rows(mail.records(listed, split=split)) == want
    assert [f[0] for f in stores.listing(str(folder))] == sorted(r["path"] for r in mail.files(spark, str(folder)).collect())


def test_damaged_records(spark, tmp_path):
    (tmp_path / "m").write_bytes(MMDF[:-6] + b"\n")
    mail.register(spark)
    got = spark.read.format("mail").option("permissive", "true").load(str(tmp_path)).collect()
    assert [(r["raw"] is None, r["error"]) for r in got] == [(False, None)] * 3 + [(True, "record has no closing delimiter")]
    with pytest.raises(Exception, match="closing delimiter"):
        spark.read.format("mail").load(str(tmp_path)).collect()


def test_ranges_begin_where_known_content_ends(spark, tmp_path):
    first, second = mailbox(9), mailbox(4, seed=2)
    (tmp_path / "a.mbox").write_bytes(first + second)
    f = spark.createDataFrame([(f"file:{tmp_path}/a.mbox", len(first + second), len(first))], "path string, length long, start long")
    got = mail.records(f, split=100).collect()
    assert sorted(r["position"] for r in got) == [r.position for r in framing.mbox(first + second, len(first))]


def test_checked_files(spark, folder):
    first = mailbox(60)
    known = spark.createDataFrame([(f"file:{folder}/a.mbox", 100), (f"file:{folder}/one.eml", 10_000)], "path string, length long")
    got = {r["path"].rsplit("/", 1)[1]: r for r in mail.checked(mail.files(spark, str(folder)), known).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert (got["a.mbox"]["sha256"], got["a.mbox"]["prefix_sha256"], got["a.mbox"]["kind"], got["a.mbox"]["seam"]) == (sha(first), sha(first[:100]), "mbox", False)
    assert got["one.eml"]["prefix_sha256"] is None and got["note.txt"]["kind"] is None and got["2.emlx"]["was"] == 0


def test_decisions(tmp_path):
    p = tmp_path / "a.mbox"
    one, two = mailbox(3), mailbox(2, seed=5)
    of = lambda b: {"length": len(b), "sha256": (p.write_bytes(b), stores.seal(str(p), len(b)))[1]}
    known = of(one)
    now = of(one)
    assert mail.decide(str(p), known, **{"length": now["length"], "digest": now["sha256"]}) == ("skip", len(one))
    grown = of(one + two)
    assert mail.decide(str(p), known, grown["length"], grown["sha256"]) == ("resume", len(one))
    for other in (two + one, one[:-1] + b"more\n\n" + two, one[:-40], one + b"end of the last\n" + two):
        now = of(other)
        assert mail.decide(str(p), known, now["length"], now["sha256"]) == ("read", 0)
    assert mail.decide(str(p), None, 1, "x") == ("read", 0)


def test_stream_reads_each_message_of_a_growing_mailbox_once(spark, tmp_path):
    mail.register(spark)
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()

    def turn():  # a new query each time, as after a restart
        q = spark.readStream.format("mail").option("split", 300).load(str(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return [(r["container"].rsplit("/", 1)[1], r["position"]) for r in spark.read.schema(mail.RECORD).parquet(out).orderBy("container", "position").collect()]

    one, two, three = mailbox(12), mailbox(7, seed=2), mailbox(5, seed=3)
    where = lambda b: [("a.mbox", r.position) for r in framing.mbox(b)]
    (source / "a.mbox").write_bytes(one)
    assert turn() == where(one)
    (source / "a.mbox").write_bytes(one + two)
    (source / "b.eml").write_bytes(b"Subject: x\n\nb\n")
    assert turn() == [*where(one + two), ("b.eml", 0)]
    assert turn() == [*where(one + two), ("b.eml", 0)]
    (source / "a.mbox").write_bytes(one + two + three)
    assert turn() == [*where(one + two + three), ("b.eml", 0)]
    (source / "b.eml").write_bytes(b"Subject: y\n\nb\n")
    assert turn() == [*where(one + two + three), ("b.eml", 0), ("b.eml", 0)]
