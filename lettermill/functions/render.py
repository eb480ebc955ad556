"""A message as text to be read, as a document to be indexed, and as a line of a bag's list; each from one parse."""

from __future__ import annotations

from collections.abc import Iterator
from email.message import Message

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.mail import addresses, header_text, html_text, is_attachment, message, part_text, preferred_text, raw_fields
from lettermill.functions.text import preview

# The header fields that a text view shows and that an index document begins with, in order.
SHOWN, INDEXED = ("To", "From", "Cc", "Subject", "Date"), ("From", "To", "Cc", "Subject", "Date")
_ROLES = ("From", "To", "Cc", "Bcc")


def _fields(raw: bytes, m: Message) -> list[tuple[str, str]]:
    """(name, decoded value) of all header fields in order."""
    charset = m.get_content_charset()
    return [(name, header_text(value, charset)[0]) for (_, value), name in zip(raw_fields(raw), m.keys(), strict=False)]


def _texts(m: Message, kind: str) -> list[str]:
    return [part_text(p) for p in m.walk() if not p.is_multipart() and p.get_content_type() == kind and not is_attachment(p)]


def _first(fields: list[tuple[str, str]], name: str) -> str | None:
    name = name.lower()
    return next((v for n, v in fields if n.lower() == name), None)


def text_view(raw: bytes, full_headers: bool = False, html: bool = False) -> str:
    """Header fields (chosen ones, or all), an empty line and the plain parts; the HTML ones as text where there are none, or as they are with `html`."""
    m = message(raw)
    fields = _fields(raw, m)
    head = fields if full_headers else [(n, v) for n in SHOWN if (v := _first(fields, n)) is not None]
    parts = _texts(m, "text/html") if html else _texts(m, "text/plain") or [html_text(x) for x in _texts(m, "text/html")]
    body = "\n\n".join(parts)
    return "\n".join(f"{n}: {v}" for n, v in head) + ("\n\n" + body.rstrip("\n") if body else "") + "\n"


def text_views(messages: DataFrame, full_headers: bool = False, html: bool = False) -> DataFrame:
    """(pk, text) of messages (pk, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("pk"), pa.array([text_view(x or b"", full_headers, html) for x in b.column("raw").to_pylist()], pa.string())], names=["pk", "text"])

    return messages.select(F.col("pk").cast("long").alias("pk"), "raw").mapInArrow(run, "pk long, text string")


def bag_entry(raw: bytes, fallback: str) -> tuple[str, int, str]:
    """(message id unfolded, number of attachments, names of the parser's defects); what can't be read is listed under the fallback id with its error."""
    try:
        m = message(raw)
        own = " ".join(x.strip() for x in str(m.get("Message-ID") or "").splitlines())
        return own, sum(is_attachment(p) for p in m.walk()), "; ".join(type(d).__name__ for d in m.defects)
    except Exception as e:  # noqa: BLE001  of any kind
        return fallback, 0, f"{type(e).__name__}: {e}"


def bag_entries(messages: DataFrame) -> DataFrame:
    """(pk, message_id, attachments, error) of messages (pk, raw, fallback)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [bag_entry(raw or b"", fallback) for raw, fallback in zip(b.column("raw").to_pylist(), b.column("fallback").to_pylist(), strict=True)]
            ids, n, errors = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("pk"), pa.array(ids, pa.string()), pa.array(n, pa.int32()), pa.array(errors, pa.string())], names=["pk", "message_id", "attachments", "error"])

    return messages.select(F.col("pk").cast("long").alias("pk"), "raw", "fallback").mapInArrow(run, "pk long, message_id string, attachments int, error string")


_ATTACHMENT = pa.struct([("ordinal", pa.int32()), ("part", pa.int32()), ("filename", pa.string()), ("mime_type", pa.string())])
_ADDRESS = pa.struct([("address", pa.string()), ("display_name", pa.string())])
_DOCUMENT = "pk long, headers string, body string, attachment_text string, attachments array<struct<ordinal: int, part: int, filename: string, mime_type: string>>, suggestions array<struct<address: string, display_name: string>>, subject string"


def _document(raw: bytes, attached_text: bool) -> tuple:
    m = message(raw)
    fields = _fields(raw, m)
    names: dict[str, str] = {}
    for name, address in addresses([v for role in _ROLES for v in m.get_all(role, [])]):
        address = address.strip().lower()
        if address:
            names[address] = names.get(address) or header_text(name.encode("utf-8", "surrogateescape"))[0].strip()
    attached = [(k, p) for k, p in enumerate(m.walk()) if not p.is_multipart() and is_attachment(p)]
    listed = [{"ordinal": n, "part": k, "filename": header_text((p.get_filename() or "").encode("utf-8", "surrogateescape"))[0], "mime_type": p.get_content_type()} for n, (k, p) in enumerate(attached, 1)]
    text = "\n".join(part_text(p) for _, p in attached if p.get_content_maintype() == "text") if attached_text else ""
    return "\n".join(_first(fields, n) or "" for n in INDEXED), preferred_text(m), text, listed, [{"address": a, "display_name": n} for a, n in sorted(names.items())], _first(fields, "Subject") or ""


def index_documents(messages: DataFrame, attached_text: bool = True) -> DataFrame:
    """(pk, content, attachment_text, attachments, suggestions, preview, subject) of messages (pk, raw): content is five header fields, a line each, and the preferred text; attachment_text: of text attachments, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(_ATTACHMENT), pa.list_(_ADDRESS), pa.string())
        for b in batches:
            columns = zip(*[_document(x or b"", attached_text) for x in b.column("raw").to_pylist()], strict=True) if b.num_rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("pk"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["pk", "headers", "body", "attachment_text", "attachments", "suggestions", "subject"])

    found = messages.select(F.col("pk").cast("long").alias("pk"), "raw").mapInArrow(run, _DOCUMENT)
    return found.select("pk", F.concat_ws("\n", "headers", "body").alias("content"), "attachment_text", "attachments", "suggestions", preview(F.col("body")).alias("preview"), "subject")
