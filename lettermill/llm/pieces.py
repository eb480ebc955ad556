"""SentencePiece encoding and decoding by a table of distinct chunks.

The piece model never joins a character to a whitespace marker that follows it, so a text falls into chunks (a run of
markers and what follows it) whose segmentations don't depend on one another. The distinct chunks of all texts are counted,
and those that occur most often, as many as a worker can hold, are segmented once and broadcast as the table; the ids of a
text are the table's entries put together by position. Rarer chunks are segmented where they occur, and kept in a second
table that is emptied when full; it never holds long chunks, so a worker's memory is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import cut, in_arrow, tune, worker_state

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Entries of the broadcast table, of a worker's own, the longest chunk that they keep, and distinct chunks that a task counts at a time.
HEAD_ROWS, TABLE_ROWS, TABLE_CHARS, COUNTERS = 150_000, 150_000, 48, 200_000


def chunks(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class PieceTable:
    """What each distinct chunk gives: its ids, and its ids and its decoded text as bytes."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces cross whitespace markers: chunks are not independent")
        if self.sp.encode(f"a {MARK}b", out_type=str) != self.sp.encode("a  b", out_type=str) or len(self.sp.encode("a  b ")) == len(self.sp.encode("a b")):
            raise ValueError("the model rewrites white space: chunks are not independent")
        self.shown = [self.surface(i, p) for i, p in enumerate(pieces)]
        self.mark = self.sp.piece_to_id(MARK)
        self.head: dict[str, tuple[int, bytes, bytes]] = {}
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def surface(self, i: int, piece: str) -> bytes:
        if self.sp.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.sp.is_unknown(i):
            return " ⁇ ".encode()
        return b"" if self.sp.is_control(i) else piece.replace(MARK, " ").encode()

    def segment(self, chunk: str) -> tuple[int, bytes, bytes]:
        # the library puts the first marker there itself
        ids = self.sp.encode(chunk[1:]) if len(chunk) > 1 else [self.mark]
        return len(ids), ",".join(map(str, ids)).encode(), b"".join(map(self.shown.__getitem__, ids))

    def rows(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """An entry for each chunk of the text, in order. An empty text has none."""
        if not text:
            return []
        head, known, found = self.head, self.known, []
        for chunk in chunks(text):
            row = head.get(chunk) or known.get(chunk)
            if row is None:
                row = self.segment(chunk)
                if len(chunk) <= TABLE_CHARS:
                    if len(known) >= TABLE_ROWS:
                        known.clear()
                    known[chunk] = row
            found.append(row)
        return found

    def count(self, text: str) -> int:
        return sum(row[0] for row in self.rows(text))

    def encode(self, text: str) -> list[int]:
        return [int(x) for row in self.rows(text) for x in row[1].split(b",")]

    def decoded(self, rows: list[tuple[int, bytes, bytes]]) -> bytes:
        """The text of the ids, without the marker that encoding puts first."""
        return b"".join([row[2] for row in rows])[1:]


def piece_table(model: str) -> PieceTable:
    """This worker's table for a model."""
    return worker_state("pieces", model, lambda: PieceTable(model))


def head_table(docs: DataFrame, model: str, rows: int = HEAD_ROWS) -> dict[str, tuple[int, bytes, bytes]]:
    """The chunks that occur more than once and at least as often as any left out, at most `rows` of them, each segmented once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["chunk", "n"])
            n.clear()
            return b

        for b in batches:
            for text in b.column("text").to_pylist():
                n.update(chunks(text))
                if len(n) > COUNTERS:
                    yield flush()
        yield flush()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = piece_table(model)
        for b in batches:
            found = [t.segment(c) for c in b.column("chunk").to_pylist()]
            cols = zip(*found, strict=True) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("chunk"), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True))], names=["chunk", "n", "ids", "shown"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = cut(in_arrow(texts, "pieces", count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).filter(f"n > 1 AND length(chunk) <= {TABLE_CHARS}"))
    often = F.floor(16 * F.log2("n")).cast("int")
    least, total = None, 0
    for r in counted.groupBy(often.alias("often")).count().orderBy(F.desc("often")).collect():  # 16 rows for each doubling
        total += r["count"]
        if total > rows:
            break
        least = r["often"]
    if least is None:
        return {}
    found = in_arrow(counted.filter(often >= least).select("chunk"), "pieces", segment, "chunk string, n int, ids binary, shown binary").collect()  # `rows` at most
    return {r["chunk"]: (r["n"], bytes(r["ids"]), bytes(r["shown"])) for r in found}


def encode_decode(docs: DataFrame, model: str, with_ids: bool = False, head_rows: int = HEAD_ROWS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, and with_ids the columns `ids` and `decoded` too.

    model: path of a SentencePiece model, the same on every node. Null text: as empty (no ids, digests of nothing).
    Repeated rows give repeated results, a null doc_id stays null, other columns are not looked at, an empty table gives
    no rows. Whole texts of any length are encoded.
    """
    tune(docs.sparkSession)
    more = ", ids array<int>, decoded string" if with_ids else ""

    held = docs.sparkSession.sparkContext.broadcast(head_table(docs, model, head_rows))  # head_rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = piece_table(model)
        t.head = held.value
        for b in batches:
            n, ids, back, lists, shown = [], [], [], [], []
            for text in b.column("text").to_pylist():
                rows = t.rows(text)
                n.append(sum([row[0] for row in rows]))
                joined = b",".join([row[1] for row in rows])
                ids.append(hashlib.sha256(joined).hexdigest())
                out = t.decoded(rows)
                back.append(hashlib.sha256(out).hexdigest())
                if with_ids:
                    lists.append([int(x) for x in joined.split(b",")] if joined else [])
                    shown.append(out.decode())
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(lists, pa.list_(pa.int32())), pa.array(shown, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_arrow(rows, "pieces", run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
