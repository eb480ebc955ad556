"""Exports, histories, inventories and the table function."""

from datetime import datetime

from pyspark.sql import functions as F

from lettermill.functions.framing import Record
from lettermill.operators import export
from lettermill.sources import udtf


def test_address_book(spark):
    m = spark.createDataFrame([(1, " Ann@x.org ", "Sent"), (2, "ann@x.org", "Archive"), (3, "", "Archive"), (4, "a<b", "Sent")], "pk long, sender string, category string")
    r = spark.createDataFrame([(1, "bob@x.org", "to"), (1, "--x@y", "to"), (2, "a&amp;b@x", "cc"), (2, "c\x07@x", "cc"), (2, "d" * 901 + "@x", "to")], "pk long, address string, role string")
    got = {x["address"]: (x["is_owner"], x["spellings"], x["fault"]) for x in export.address_book(m, r).collect()}
    assert got["ann@x.org"] == (True, 2, None) and got["bob@x.org"] == (False, 1, None)
    assert {k[:9]: v[2] for k, v in got.items() if v[2]} == {"": "empty address", "a<b": "needs escaping", "--x@y": "delimiter prefix", "a&amp;b@x": "character entity", "c\x07@x": "control or non-printing character", "d" * 9: "too long"}
    assert [x["address"] for x in export.detected_owners(m, ["ann"], []).collect()] == ["ann@x.org"]


def test_history(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run": "a", "state": "running", "phase": "x", "started_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:10:00Z", "messages": 5}')
    (tmp_path / "b.json").write_text('{"run": "b", "state": "done", "started_at": "2024-02-01T00:00:00Z"}')
    (tmp_path / "c.json").write_text("not json")
    rows = export.history(spark, str(tmp_path)).collect()
    assert [r["run"] for r in rows] == ["b", "a", None] and rows[2]["error"]
    at = F.lit("2024-01-01 00:10:30").cast("timestamp")
    assert {r["run"]: r["state"] for r in export.effective(export.history(spark, str(tmp_path)), at).collect()}["a"] == "running"
    assert {r["run"]: r["state"] for r in export.effective(export.history(spark, str(tmp_path))).collect()}["a"] == "stale"


def test_scalars(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    assert [show(export.duration(F.lit(x))) for x in (0.0, 59.2, 61.0, 3600.0, -5.0)] == ["0s", "1m 0s", "1m 1s", "1h 0m 0s", "0s"]
    assert show(export.status_line(F.lit("  a \n b "))) == "a b" and show(export.status_line(F.lit(" "))) == "working"
    risky = lambda m, f: show(export.is_risky(F.lit(m), F.lit(f)))
    assert not risky("image/PNG", "x.PNG") and risky("image/png", "x.exe") and risky("text/html", "x.txt")


def test_inventories(spark):
    files = spark.createDataFrame([("a", bytearray(b"BABYL Options:\n")), ("b", bytearray(b"From x")), ("c.TXT", bytearray(b"x")), ("d", bytearray(b"%PDF-1")), ("e", bytearray(b"")), ("f", bytearray(b"\xff\xfe"))], "path string, content binary").withColumn("length", F.length("content"))
    assert {r["format"]: r["files"] for r in export.format_inventory(files).collect()} == dict.fromkeys(["babyl", "mbox", "text", "pdf", "empty", "other"], 1)
    seen = spark.createDataFrame([(datetime(1999, 1, 1), "date", "a", None), (datetime(1999, 5, 1), "date", "", None), (None, None, None, "bad")], "date timestamp_ntz, date_source string, sender string, error string")
    assert {tuple(r) for r in export.audit(seen).collect()} == {(1999, "date", 2, 1, 0), (None, None, 1, 0, 1)}
    kept = export.within_budget(spark.createDataFrame([(1, 5), (2, 4), (3, 9)], "n int, size long"), "n", "size", 10)
    assert [r["fits"] for r in kept.orderBy("n").collect()] == [True, True, False]


def test_table_function(spark):
    udtf.register(spark)
    udtf.register(spark, "lines", lambda content: (Record(k, x) for k, x in enumerate(content.split(b"\n"))))
    box = b"From a Tue Mar  2 08:00:00 1999\nSubject: 1\n\nx\n\nFrom a Tue Mar  2 08:00:00 1999\nSubject: 2\n\ny\n"
    spark.createDataFrame([("p", "mbox", bytearray(box)), ("q", "mbox", None)], "path string, kind string, content binary").createOrReplaceTempView("files")
    assert spark.sql("SELECT r.* FROM files, LATERAL mail_records(path, kind, content) r").count() == 2
    assert spark.sql("SELECT r.* FROM files, LATERAL lines(path, kind, content) r").count() == 10
