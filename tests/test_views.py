"""Printed pages, message views and text metrics against brute force."""

import base64
import re

from lettermill.functions import view
from lettermill.operators import printed, quality


def test_printed_pages(spark):
    text = "\n \nDate: a\nSubject: one \n  two\t\nTo: b\n\nbody\n\nmore\n\n\fDate: x\nnot a field\n\n\f\fSubject: s\r\nDate: d\r\nFROM: f"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc int, text string")
    got = {(r["doc"], r["page"]): r for r in printed.messages(printed.pages(rows)).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (1, 4)]
    assert [(h["name"], h["value"]) for h in got[1, 1]["headers"]] == [("Date", "a"), ("Subject", "one  two"), ("To", "b")]
    assert got[1, 1]["body"] == "body\n\nmore" and got[1, 1]["classification"] == "printed-email"
    assert not got[1, 2]["headers"] and got[1, 2]["body"] == "Date: x\nnot a field" and got[1, 3]["classification"] == "non-message"
    assert got[1, 4]["classification"] == "printed-email" and got[1, 4]["body"] == ""


def test_message_views(spark):
    png = base64.b64encode(b"\x89PNG").decode()
    mixed = (
        'Subject: =?utf-8?q?h=C3=A4?=\nX-A: 1\nx-a: 2\nContent-Type: multipart/related; boundary="b"\n\n'
        '--b\nContent-Type: text/html\n\n<img src="cid:i"><img src="http://x/y"><script>1</script>\n--b\nContent-Type: text/html\n\n<p>\n'
        f"--b\nContent-Type: image/png\nContent-ID: <i>\nContent-Transfer-Encoding: base64\n\n{png}\n--b\nContent-Type: application/x; name=../a.exe\nContent-Disposition: attachment\n\nz\n--b--\n"
    ).encode()
    old = b"Subject: x\n\n <x-html>\n<b>old</b></x-html> \n"
    rows = spark.createDataFrame([(1, bytearray(mixed)), (2, bytearray(old)), (3, b"Subject: y\n\nplain"), (4, b""), (5, None), (6, b"Content-Type: application/x\n\nq")], "pk int, raw binary")
    found = view.shown(rows)
    got = {r["pk"]: r for r in found.select("pk", "v", view.preferred().alias("preferred")).collect()}
    assert {k: r["preferred"] for k, r in got.items()} == {1: 1, 2: view.LEGACY, 3: 0, 4: 0, 5: view.RAW, 6: view.RAW}
    assert [(h["name"], h["occurrence"], h["value"]) for h in got[1]["v"]["headers"]][:3] == [("Subject", 0, "hä"), ("X-A", 0, "1"), ("x-a", 1, "2")]
    html = got[1]["v"]["parts"][0]
    assert f"data:image/png;base64,{png}" in html["text"] and "http://x/y" not in html["text"] and "script" not in html["text"] and html["remote_blocked"]
    assert "<b>old</b>" in got[2]["v"]["parts"][0]["text"] and "x-html" not in got[2]["v"]["parts"][0]["text"]
    files = {r["part"]: r for r in view.attachments(found, "pk").collect()}
    assert files[3]["preview"] == "image" and files[3]["inline"] and files[3]["content_base64"] == png and files[3]["filename"] == "attachment-3"
    assert files[4]["risky"] and files[4]["filename"] == "a.exe" and files[4]["bytes"] == 1


def brute(t):
    words = re.findall(r"\S+", t)
    lines = t.splitlines()
    heavy = sum(len(x.strip()) >= 8 and sum(c.isalnum() for c in x) / len(x.strip()) < 0.2 for x in lines)
    control = sum(ord(c) < 32 and c not in "\n\r\t\f" for c in t)
    runs, long = len(re.findall(r"([^\s])\1{5,}", t)), sum(len(w) > 80 for w in words)
    wrong = sum(map(t.count, quality.MOJIBAKE))
    artifacts = 10 * t.count("�") + 5 * wrong + 20 * control + 5 * runs + 2 * long + heavy
    emails = len(re.findall(r"(?i)\b[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[a-z]{2,}\b", t))
    fields = len(re.findall(r"(?im)^\s*(?:from|to|cc|bcc|subject|date|sent):\s*\S", t))
    return (len(t.encode()), len(t), len(lines), len(words), t.count("\f"), emails, fields, t.count("�"), wrong, control, runs, long, heavy, artifacts * 1e6 / max(len(t), 1))


def test_text_metrics(spark):
    texts = ["", " ", "a", "a\n", "To: x\n cc : y\n\n\nDate:\nz", "ä@ö.de, a.b@c.org", "======== !!\n---- ab ----\n........", "Ã¤ â€ �\x01\x0b\x1c", "x" * 81 + " " + "y" * 80, "a b\x85c d\fe\r\nf", "é" * 7 + "q" * 6, "😀" * 9]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    got = {r["i"]: tuple(r)[2:] for r in quality.text_metrics(rows).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i][:-1] == want[:-1] and abs(got[i][-1] - want[-1]) < 1e-6, (t, got[i], want)
    assert set(got[len(texts)]) == {None}
