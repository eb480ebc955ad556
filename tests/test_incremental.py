"""Growing sources, versions, carried dates, range reads and signs of life."""

import hashlib
import json
import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lettermill.functions import storage
from lettermill.operators import archive, export
from lettermill.operators.ingest import inherit_dates
from lettermill.sources import mail, versions
from lettermill.streaming import dates, ingest, status
from tests.test_mail_source import mailbox

FROM = b"From a@x Tue Mar  2 10:00:00 1999\n"


def message(n, date=True):
    return FROM + b"From: a@x\n%sMessage-ID: <%d@x>\n\nbody %d\n\n" % (b"Date: Tue, 2 Mar 1999 10:00:00 +0200\n" if date else b"", n, n)


def catalogue(spark, target):
    return {(r["message_id"], r["disposition"]): r for r in spark.read.schema(ingest.MESSAGE).parquet(f"{target}/messages").collect()}


def test_stream_and_ingest_know_each_others_containers(spark, tmp_path):
    source, target = tmp_path / "in" / "2001", str(tmp_path / "out")
    source.mkdir(parents=True)

    def turn():
        ingest.start(spark, str(tmp_path / "in"), target, str(tmp_path / "checkpoint"), split=150).awaitTermination(120)

    (source / "a.mbox").write_bytes(b"".join(map(message, range(5))))
    turn()
    assert ingest.ingest(spark, str(tmp_path / "in"), target, 1) == 0  # the stream has told what it read
    with (source / "a.mbox").open("ab") as f:
        f.write(message(5, date=False) + message(6))
    turn()
    got = catalogue(spark, target)
    assert {k[0] for k in got} == {f"{k}@x" for k in range(7)} and {k[1] for k in got} == {"archived"}
    assert (got["5@x", "archived"]["date"], got["5@x", "archived"]["date_source"]) == (datetime(1999, 3, 2, 8), "previous-message")
    with (source / "a.mbox").open("ab") as f:
        f.write(message(7))
    assert ingest.ingest(spark, str(tmp_path / "in"), target, 1, split=100) == 1
    assert {k[0] for k in catalogue(spark, target)} == {f"{k}@x" for k in range(8)}
    run = spark.read.schema(ingest.RUN).parquet(f"{target}/runs").first()
    assert (run["batch"], run["containers"], run["records"], run["errors"], run["changed"]) == (1, 1, 1, 0, 0)
    turn()  # reads the tail once more, as its offset is its own: a duplicate, never a second archived message
    assert sum(k[1] == "archived" for k in catalogue(spark, target)) == 8


def test_a_container_touched_while_it_is_read_keeps_its_checkpoint(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.mbox").write_bytes(message(1))
    (source / "b.mbox").write_bytes(message(2))
    narrow = ingest.narrow

    def slow(*a):
        found = narrow(*a)
        with (source / "a.mbox").open("ab") as f:
            f.write(message(3))
        return found

    monkeypatch.setattr(ingest, "narrow", slow)
    assert ingest.ingest(spark, str(source), target, 1) == 2
    assert [r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(f"{target}/containers").collect()] == ["b.mbox"]
    assert spark.read.parquet(f"{target}/runs").first()["changed"] == 1
    monkeypatch.setattr(ingest, "narrow", narrow)
    assert ingest.ingest(spark, str(source), target, 2) == 1
    got = catalogue(spark, target)
    assert {("1@x", "archived"), ("1@x", "duplicate"), ("3@x", "archived"), ("2@x", "archived")} == set(got)
    assert ingest.ingest(spark, str(source), target, 3) == 0


def test_dates_carried_over_batches_are_those_of_one_batch(spark, tmp_path):
    at = lambda k: datetime(1999, 1, 1 + k)
    rows = [("a", 0, None), ("a", 1, None), ("a", 2, at(3)), ("a", 3, None), ("b", 0, datetime(1, 1, 2)), ("b", 5, None), ("c", 0, None), ("c", 9, None), ("a", 7, None), ("a", 8, at(1)), ("a", 9, None), ("b", 6, datetime(9999, 12, 31)), ("b", 7, None)]
    kind = "container string, position long, own_date timestamp_ntz, path_year int"
    df = spark.createDataFrame([(*r, 2001) for r in rows], kind)
    want = {(r["container"], r["position"]): (r["date"], r["date_source"]) for r in inherit_dates(df).collect()}
    for cuts in ((4, 9), (1, 2, 3, 7, 11), (13,)):
        source, out = tmp_path / f"in{cuts[0]}", str(tmp_path / f"out{cuts[0]}")
        for lo, hi in zip((0, *cuts), (*cuts, len(rows)), strict=True):
            if hi > lo:
                spark.createDataFrame([(*r, 2001) for r in rows[lo:hi]], kind).coalesce(1).write.mode("append").parquet(str(source))
            q = dates.carried(spark.readStream.schema(kind).parquet(str(source))).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
            q.awaitTermination(120)
        assert {(r["container"], r["position"]): (r["date"], r["date_source"]) for r in spark.read.parquet(out).collect()} == want


def test_range_reads(spark, tmp_path):
    from lettermill.functions import framing

    raws = [b"Subject: %d\n\nbody\nFrom here\n>From there\n>>From x %d\n" % (k, k) for k in range(200)] + [b"no end"]
    records = [storage.stored(r, storage.envelope(r)) + b"\n" for r in raws]
    content = b"".join(records)
    (tmp_path / "a.mbox").write_bytes(content)
    at = [r.position for r in framing.mbox(content)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    name = f"file:{tmp_path}/a.mbox"
    rows = [(k, "ok", name, at[k], len(records[k]) - 1, sha(raws[k])) for k in range(0, 201, 3)]
    rows += [(1001, "ok", name, at[4], 60, "0" * 64), (1002, "no-location", None, None, None, None), (1003, "ok", f"file:{tmp_path}/none", 0, 5, "x"), (1004, "ok", name, len(content) - 3, 50, "x"), (1005, "ok", name, at[5], len(records[5]), sha(records[5])), (None, "ok", name, at[9], len(records[9]), sha(raws[9]))]
    found = spark.createDataFrame(rows, "pk long, status string, filename string, offset long, length long, sha256 string")
    for gap, window in ((0, 1 << 30), (1 << 20, 1 << 30), (64, 1000)):
        got = archive.read_ranges(found, gap, window).collect()
        by = {r["pk"]: (r["status"], r["raw"] and bytes(r["raw"])) for r in got}
        assert {k: by[k] for k in range(0, 201, 3)} == {k: ("ok", raws[k]) for k in range(0, 201, 3)}
        assert [by[k][0] for k in (1001, 1002, 1003, 1004)] == ["damaged", "no-location", "no-container", "damaged"]
        assert by[1005] == ("ok", records[5]) and by[None] == ("ok", raws[9])
        asked = sum(r[4] or 0 for r in rows)
        read = sum(r["fetched"] for r in got)
        assert read <= asked if gap == 0 else read <= len(content) * 1.2
    small = spark.createDataFrame([(name, bytearray(content))], "filename string, content binary")
    assert {r["pk"]: r["raw"] and bytes(r["raw"]) for r in archive.read_records(found, small).filter("pk < 1000").collect()} == {k: raws[k] for k in range(0, 201, 3)}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    of = lambda n: {"a": spark.range(n), "b": spark.range(2 * n)}
    with pytest.raises(ValueError, match="nothing is published"):
        versions.read(spark, root, "a")
    assert versions.publish(of(5), root, {"a": 5, "b": 10}) == 1
    old = versions.read(spark, root, "a")
    with pytest.raises(ValueError, match="not published"):
        versions.publish(of(6), root, {"b": 11})
    assert versions.newest(spark, root) == 1 and versions.read(spark, root, "b").count() == 10
    broken = {"a": spark.range(3), "b": spark.range(3).withColumn("x", F.raise_error(F.lit("killed")).cast("int"))}
    with pytest.raises(Exception, match="killed"):
        versions.publish(broken, root)
    assert versions.newest(spark, root) == 1 and len(os.listdir(f"{root}/versions")) == 1
    assert versions.publish({"a": spark.range(7), "b": spark.range(0)}, root, {"a": 7, "b": 0}) == 2
    assert old.count() == 5  # a reader goes on with the version that it has begun
    assert [versions.read(spark, root, t).count() for t in "ab"] == [7, 0] and versions.read(spark, root, "b", 1).count() == 10
    assert versions.prune(spark, root, keep=1) == 1 and versions.read(spark, root, "a").count() == 7


def test_two_that_publish_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    versions.publish({"a": spark.range(1)}, root)
    monkeypatch.setattr(versions, "newest", lambda *a: 0)  # as one that began before the other was done
    with pytest.raises(Exception, match="exists"):
        versions.publish({"a": spark.range(2)}, root)
    monkeypatch.undo()
    assert versions.read(spark, root, "a").count() == 1 and len(os.listdir(f"{root}/versions")) == 1


def test_signs_of_life(spark, tmp_path):
    folder, source = str(tmp_path / "status"), tmp_path / "in"
    source.mkdir()
    (source / "a.mbox").write_bytes(mailbox(6))
    os.makedirs(folder)
    mail.register(spark)
    listener = status.watch(spark, folder)
    try:
        q = spark.readStream.format("mail").load(str(source)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        path, deadline = f"{folder}/{q.runId}.json", time.time() + 60
        while not (os.path.exists(path) and json.loads(open(path).read())["messages"] == 6) and time.time() < deadline:
            time.sleep(0.3)
        other = spark.newSession()
        seen = export.history(other, folder).filter(F.col("run") == str(q.runId))
        late = F.current_timestamp() + F.expr("INTERVAL 1 DAY")
        assert [r["state"] for r in export.effective(seen).collect()] == ["running"] and [r["state"] for r in export.effective(seen, late).collect()] == ["stale"]
        q.stop()
        while json.loads(open(path).read())["state"] == "running" and time.time() < deadline:
            time.sleep(0.3)
        last = export.history(other, folder).filter(F.col("run") == str(q.runId)).first()
        assert (last["state"], last["messages"], last["error"]) == ("finished", 6, None)
    finally:
        spark.streams.removeListener(listener)
