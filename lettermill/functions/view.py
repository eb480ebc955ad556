"""A message as it is shown: headers with occurrences, body parts made safe, attachments with their bytes."""

from __future__ import annotations

import base64
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator
from email.message import Message

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.charset import decode
from lettermill.functions.html import sanitized
from lettermill.functions.mail import Simple, header_text, message, part_text, raw_fields
from lettermill.functions.text import safe_filename
from lettermill.operators.export import is_risky

#: What of a message is shown: its headers, and parts of these roles.
SHOWN = ("headers", "text", "html", "attachment", "other")
#: Numbers that stand for the whole source and for a body that is one x-html element.
RAW, LEGACY = -1, -2
X_HTML = re.compile(rb"[ \t\r\n]*<x-html>[ \t\r\n]*(.*?)[ \t\r\n]*</x-html>[ \t\r\n]*", re.I | re.S)
BODY_START = re.compile(rb"\r\n\r\n|\n\n|\r\r")

SCHEMA = (
    "headers array<struct<name: string, occurrence: int, value: string>>, "
    "parts array<struct<part: int, role: string, mime_type: string, filename: string, inline: boolean, text: string, remote_blocked: boolean, content: binary>>"
)


def _content(part: Message) -> bytes:
    data = part.get_payload(decode=True)
    return data if isinstance(data, bytes) else str(part.get_payload() or "").encode("utf-8", "replace") if not part.is_multipart() else b""


def legacy_html(raw: bytes, m: Message) -> str | None:
    """The text of a body that is one x-html element as a whole."""
    at = None if m.is_multipart() else BODY_START.search(raw)
    found = at and X_HTML.fullmatch(raw, at.end())
    return decode(found[1], m.get_content_charset())[0] if found else None


def _headers(raw: bytes, m: Message) -> list[tuple[str, int, str]]:
    if isinstance(m, Simple):
        return m.head.texts
    values: dict[bytes, list[bytes]] = defaultdict(list)
    for name, value in raw_fields(raw):
        values[name].append(value)
    seen: Counter = Counter()
    charset = m.get_content_charset()
    headers = []
    for name in m.keys():
        key = name.lower().encode("utf-8", "surrogateescape")
        k = seen[key]
        seen[key] += 1
        headers.append((name, k, header_text(values[key][k], charset)[0] if k < len(values[key]) else ""))
    return headers


def show_message(raw: bytes, remote: bool = False, only: Collection[str] = SHOWN) -> tuple[list[tuple], list[tuple]]:
    """A row of SCHEMA, its structs as tuples. Parts have the role text, html, attachment or other; images of content ids are put into the html. What isn't in `only` is not read."""
    m = message(raw)
    leaves = [(k, p) for k, p in enumerate(m.walk()) if not p.is_multipart()]
    images = {}
    for _, p in leaves if "html" in only else ():
        cid = str(p.get("Content-ID", "")).strip("<>")
        if cid and p.get_content_maintype() == "image":
            images[cid] = f"data:{p.get_content_type()};base64,{base64.b64encode(_content(p)).decode('ascii')}"
    old = legacy_html(raw, m)
    parts = []
    for k, p in leaves:
        kind = p.get_content_type()
        given, disposition = p.get_filename(), p.get_content_disposition()
        role = "attachment" if disposition == "attachment" or given is not None or kind.startswith("image/") or kind == "application/pdf" else {"text/plain": "text", "text/html": "html"}.get(kind, "other")
        legacy = old is not None and role != "attachment"
        if legacy:
            role, k = "html", LEGACY
        if role not in only:
            continue
        text, blocked = (None, False) if role in ("attachment", "other") else (old if legacy else part_text(p), False)
        if role == "html":
            text, blocked = sanitized(text, images, remote)
        name = header_text(given.encode("utf-8", "surrogateescape"))[0] if given else ""
        inline = disposition == "inline" or p.get("Content-ID") is not None
        parts.append((k, role, kind, name, inline, text, blocked, _content(p) if role == "attachment" else None))
    return _headers(raw, m) if "headers" in only else [], parts


def _lists(rows: list[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    return struct_lists(list(itertools.chain.from_iterable(rows)), map(len, rows), kind)


def struct_lists(flat: list[tuple], lengths: Iterable[int], kind: pa.ListType) -> pa.ListArray:
    """Tuples as lists of structs, of these lengths, built by columns, as Arrow takes far longer over a dict for each struct."""
    columns = zip(*flat, strict=True) if flat else [()] * kind.value_type.num_fields
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(itertools.accumulate(lengths, initial=0), pa.int32()), structs, type=kind)


def shown(records: DataFrame, raw: str = "raw", remote: bool = False, only: Collection[str] = SHOWN) -> DataFrame:
    """records with `v`, a struct of SCHEMA. Null bytes: null. remote: remote images stay in html. only: whether headers are read, and parts of which roles; the others are left out."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(SCHEMA)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(raw).to_pylist()
            found = [([], []) if x is None else show_message(bytes(x), remote, only) for x in data]
            columns = [_lists([x[k] for x in found], f.type) for k, f in enumerate(arrow)]
            yield b.append_column("v", pa.StructArray.from_arrays(columns, fields=list(arrow), mask=pa.array([x is None for x in data], pa.bool_())))

    return records.mapInArrow(run, StructType([*records.schema.fields, StructType().add("v", kind)["v"]]))


def preferred(v: str = "v") -> Column:
    """The part to show first: the html part with the most text, else the first plain one, else the source."""
    of = lambda role: F.filter(f"{v}.parts", lambda p: p["role"] == role)
    size = lambda p: F.length(F.trim(p["text"]))
    longest = F.aggregate(of("html"), F.lit(None).cast("struct<part: int, n: int>"), lambda a, p: F.when(a.isNull() | (size(p) > a["n"]), F.struct(p["part"].alias("part"), size(p).alias("n"))).otherwise(a))
    return F.coalesce(longest["part"], F.try_element_at(of("text"), F.lit(1))["part"], F.lit(RAW))


def attachments(messages: DataFrame, *keys: str) -> DataFrame:
    """(*keys, part, filename, mime_type, bytes, inline, preview, risky, content_base64): a row for each attachment of messages (with `v`)."""
    rows = messages.select(*keys, F.explode(F.filter("v.parts", lambda p: p["role"] == "attachment")).alias("a"))
    name = F.when(F.col("a.filename") == "", F.concat(F.lit("attachment-"), F.col("a.part").cast("string"))).otherwise(safe_filename(F.col("a.filename")))
    preview = F.when(F.col("a.mime_type").startswith("image/"), "image").when(F.col("a.mime_type") == "application/pdf", "pdf")
    return rows.select(
        *keys, F.col("a.part").alias("part"), name.alias("filename"), F.col("a.mime_type").alias("mime_type"), F.length("a.content").cast("long").alias("bytes"),
        F.col("a.inline").alias("inline"), preview.alias("preview"), is_risky(F.col("a.mime_type"), name).alias("risky"), F.base64("a.content").alias("content_base64"),
    )
