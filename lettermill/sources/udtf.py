"""Containers as a table function, for SQL: `SELECT r.* FROM files, LATERAL mail_records(path, kind, content) r`; other parsers register the same way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lettermill.functions import framing

RECORD = "position long, raw binary, envelope binary, exclusion string"
Parser = Callable[[bytes], Iterator[framing.Record]]


def register(spark: SparkSession, name: str = "mail_records", parser: Parser | None = None) -> None:
    """Register a table function over (path, kind, content); parser: for containers of a kind of its own, else by kind."""

    class Records:
        def eval(self, path: str, kind: str, content: bytes):
            if content is None:
                return
            for r in parser(content) if parser else framing.records(kind, content):
                yield r.position, r.raw, r.envelope, r.exclusion

    spark.udtf.register(name, udtf(Records, returnType=RECORD))
