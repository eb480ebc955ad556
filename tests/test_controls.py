"""Integrity manifests, declarations, checkpoints, the cache's scan and mailboxes of printed mail."""

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lettermill.functions import framing
from lettermill.functions.mail import semantic_bytes
from lettermill.functions.storage import canonical_json
from lettermill.operators import controls, manifests, printed, reconcile
from lettermill.sources import sinks

sha = lambda b: hashlib.sha256(b).hexdigest()
RAW = [b"Subject: %d\nMessage-ID: <%d>\n\nbody\nFrom here\n" % (k, k) for k in range(5)]


def good(code="h1", algorithm="sha256", standard="mbox", **other):
    return canonical_json(manifests.declaration(code, algorithm, standard) | other)


def test_declarations():
    lines = [good(), good("h2", standard="raw"), good("h3", standard="semantic"), canonical_json({k: v for k, v in manifests.declaration("h4", "sha512", "raw").items() if k not in ("input", "canonicalization")} | {"same_input_as": "h2"})]
    standards = manifests.parse_standards(lines)
    assert [(s.code, s.algorithm, s.scope) for s in standards] == [("h1", "sha256", "mbox"), ("h2", "sha256", "message"), ("h3", "sha256", "message"), ("h4", "sha512", "message")]
    assert manifests.parse_token("h4:" + "a" * 128, standards)[0].code == "h4"
    for bad in ("h4:" + "a" * 64, "h9:" + "a" * 64, "h1" + "a" * 64, "h1:" + "A" * 64, None, 5):
        with pytest.raises(ValueError, match="invalid hash token"):
            manifests.parse_token(bad, standards)
    wrong = [[good("h2")], [good(algorithm="crc")], [good(hash_version=True)], [good(hash_version=2)], [good(scope="message")], [good(id="x")], [good(input="x")], [good(canonicalization={"method": "x"})], [good(same_input_as="h1")], [json.dumps(json.loads(good()))], ["[]"], [good(type="x")]]
    for lines in wrong:
        with pytest.raises(ValueError):
            manifests.parse_standards(lines)
    with pytest.raises(ValueError, match="same_input_as"):
        manifests.parse_standards([good(), good("h2", standard="raw", same_input_as="h1")])


def test_manifests_are_written_and_checked(spark, tmp_path):
    rows = [(k, datetime(1999 + k % 2, 3, 2), "Archive", "a@b", bytearray(r), f'i"{k}\t', sha(r), sha(semantic_bytes(r))) for k, r in enumerate(RAW)]
    m = spark.createDataFrame(rows, "position long, date timestamp_ntz, category string, sender string, raw binary, message_id string, sha256 string, semantic_sha256 string")
    records = sinks.framed(m)
    ordered = records.join(sinks.locations(records).select("mailbox", "position", "ordinal"), ["mailbox", "position"])
    boxes = {}
    for r in ordered.orderBy("mailbox", "ordinal").collect():
        boxes[r["mailbox"]] = boxes.get(r["mailbox"], b"") + bytes(r["record"]) + b"\n"
    files = spark.createDataFrame([(k, len(b), sha(b)) for k, b in boxes.items()], "mailbox string, bytes long, sha256 string")
    stored = ordered.select("mailbox", "ordinal", "record")
    out = str(tmp_path / "manifests")
    manifests.write_manifests(manifests.manifest_lines(records, files), out)
    back = manifests.numbered_lines(spark, out).cache()
    assert back.filter("mailbox = '1999-Archive1.mbox'").count() == 7 + 3
    check = lambda lines=back, f=files, s=stored: {tuple(r) for r in manifests.manifest_faults(lines, f, s).collect()}
    assert check() == set()
    a, b = "1999-Archive1.mbox", "2000-Archive1.mbox"
    assert check(f=files.withColumn("bytes", F.col("bytes") + 1)) == {(a, None, "bytes differ"), (b, None, "bytes differ")}
    assert check(f=files.filter(f"mailbox = '{a}'")) == {(b, None, "manifest without a mailbox")}
    assert check(back.filter(f"NOT (mailbox = '{a}' AND at = 10)")) == {(a, None, "messages differ"), (a, 3, "unexpected record")}
    assert check(back.withColumn("line", F.when((F.col("mailbox") == b) & (F.col("at") == 9), F.concat("line", F.lit("x"))).otherwise(F.col("line")))) == {(b, 2, "malformed row"), (b, 2, "unexpected record")}
    assert check(back.withColumn("line", F.when(F.col("at") == 3, F.replace("line", F.lit("h2"), F.lit("h7"))).otherwise(F.col("line")))) == {(a, None, "codes must be h1, h2, ... in order"), (b, None, "codes must be h1, h2, ... in order")}
    broken = stored.withColumn("record", F.when((F.col("mailbox") == a) & (F.col("ordinal") == 1), F.concat("record", F.lit(b"x"))).otherwise(F.col("record")))
    assert check(s=broken) == {(a, 1, "raw hash mismatch")}
    swapped = back.withColumn("line", F.when((F.col("mailbox") == a) & (F.col("at") == 8), F.regexp_replace("line", "^1\t", "2\t")).otherwise(F.col("line")))
    assert (a, 1, "rows are not in order") in check(swapped)
    back.unpersist()


def test_checkpoints(spark, tmp_path):
    folder, root = tmp_path / "archive", str(tmp_path / "controls")
    (folder / "sub").mkdir(parents=True)
    (folder / "a b%.mbox").write_bytes(b"one")
    (folder / "sub/c").write_bytes(b"two" * 1000)
    told = controls.checkpoint(spark, str(folder), root, "x")
    assert {(r["subject"], r["value"], r["byte_length"]) for r in told.collect()} == {("x:a b%.mbox", sha(b"one"), 3), ("x:sub/c", sha(b"two" * 1000), 3000)}
    assert controls.verify(spark, str(folder), root, "x").count() == 2
    (folder / "sub/c").write_bytes(b"two" * 999 + b"twO")
    (folder / "new").write_bytes(b"n")
    with pytest.raises(controls.IntegrityError) as e:
        controls.verify(spark, str(folder), root)
    assert e.value.faults == ["new: not in manifest", "sub/c: hash mismatch"]
    controls.checkpoint(spark, str(folder), root)
    assert controls.verify(spark, str(folder), root).count() == 3 and controls.faults(spark, str(folder), root, 1).count() == 2


def test_cache_scan(spark, tmp_path):
    top = tmp_path / "Mail"
    emlx = lambda raw: b"%d\n" % len(raw) + raw + b"<plist/>"
    for name, content in (("V2/Acc/INBOX.mbox/1.emlx", emlx(RAW[0])), ("V2/acc/INBOX.mbox/2.partial.emlx", b"x"), ("V2/Acc/INBOX.mbox/3.emlx", b"999\nshort"), ("V2/MailData/4.EMLX", emlx(RAW[1])), ("V2/Acc/note.txt", b"x"), ("V2/Acc/5.emlx", b"no length")):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    services = spark.createDataFrame([("ACC", "imap")], "account string, service string")
    scan = reconcile.cache_scan(spark, str(top), services)
    got = {r["path"]: (r["service"], r["state"], r["sha256"], r["semantic_sha256"]) for r in scan.collect()}
    assert got == {
        "V2/Acc/INBOX.mbox/1.emlx": ("imap", "complete", sha(RAW[0]), sha(semantic_bytes(RAW[0]))), "V2/acc/INBOX.mbox/2.partial.emlx": ("imap", "partial", None, None), "V2/Acc/INBOX.mbox/3.emlx": ("imap", "unreadable", None, None),
        "V2/MailData/4.EMLX": ("unknown", "complete", sha(RAW[1]), sha(semantic_bytes(RAW[1]))), "V2/Acc/5.emlx": ("imap", "unreadable", None, None),
    }
    assert {tuple(r) for r in reconcile.cache_inventory(scan).collect()} == {("imap", 3, 1, 2), ("unknown", 1, 0, 0)}


def test_printed_mail_as_a_mailbox(spark, tmp_path):
    page = "From: Ann <a@x>\nMessage-ID: <old>\nDate: Tue, 2 Mar 1999 10:00:00 +0000\nSubject: é\nX-Other: o\n\nbody\nFrom here"
    rows = spark.createDataFrame([("scan.pdf", "f" * 64, page)], "source_name string, source_sha256 string, text string")
    found = printed.derived(printed.messages(printed.pages(rows)))
    raw = bytes(found.first()["raw"])
    want = f"Message-ID: <page-{'f' * 64}-p1@derived.invalid>\nX-Derived: printed-email\nX-Transcription-Status: machine-unreviewed\nX-Source-Name: scan.pdf\nX-Source-SHA256: {'f' * 64}\nX-Source-Page: 1\nFrom: Ann <a@x>\nX-Observed-Message-ID: <old>\nDate: Tue, 2 Mar 1999 10:00:00 +0000\nSubject: é\nMIME-Version: 1.0\nContent-Type: text/plain; charset=\"utf-8\"\nContent-Transfer-Encoding: 8bit\n\nbody\nFrom here\n"
    assert raw.decode() == want
    out = tmp_path / "mbox"
    sinks.write_mbox(found.select(F.lit(1).alias("position"), "raw"), str(out))
    (r,) = framing.mbox(b"".join(p.read_bytes() for p in sorted(out.glob("part-*"))))
    assert r.raw.replace(b"\n>From ", b"\nFrom ") == raw and r.envelope.startswith(b"From MAILER-DAEMON Tue Mar  2 10:00:00 1999")
    with pytest.raises(Exception, match="exist"):
        sinks.write_mbox(found.select(F.lit(1).alias("position"), "raw"), str(out))
