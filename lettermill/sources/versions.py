"""Several tables published together: immutable versions, and a numbered pointer that appears by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, *names: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(n.rstrip("/") for n in names))


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, source, target, over: bool) -> None:
    """One atomic step of the store; not over: an error if the target is there."""
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if over else kind.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, target).getUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(source), context.makeQualified(target), options)


def _write_text(spark: SparkSession, path, text: str) -> None:
    out = _fs(spark, path).create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path) -> str:
    stream = _fs(spark, path).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file as a whole: readers see the old or the new text."""
    target = _path(spark, path)
    fresh = _path(spark, str(target.getParent()), f".{target.getName()}.{uuid.uuid4().hex}")
    _write_text(spark, fresh, text)
    _rename(spark, fresh, target, over=True)


def _pointers(spark: SparkSession, root: str) -> dict[int, object]:
    folder = _path(spark, root, "pointers")
    fs = _fs(spark, folder)
    if not fs.exists(folder):
        return {}
    found = [s.getPath() for s in fs.listStatus(folder)]
    return {int(p.getName()): p for p in found if p.getName().isdigit()}


def newest(spark: SparkSession, root: str) -> int:
    """The number of the version that readers see; 0: none is published."""
    return max(_pointers(spark, root), default=0)


def point(spark: SparkSession, root: str, number: int, text: str) -> None:
    """The pointer of that number, with its text, by one rename; an error if another run has set it."""
    fresh = _path(spark, root, "pointers", f".{uuid.uuid4().hex}")
    _write_text(spark, fresh, text)
    _rename(spark, fresh, _path(spark, root, "pointers", f"{number:012d}"), over=False)


def pointed(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, str | None]:
    """(number, text) of the newest pointer, or of that number; (0, None) if there is none."""
    pointers = _pointers(spark, root)
    at = number or max(pointers, default=0)
    return at, _read_text(spark, pointers[at]) if at else None


def publish(tables: dict[str, DataFrame], root: str, expected: dict[str, int] | None = None, filled: tuple[str, ...] = ()) -> int:
    """Put tables in place together, as a new version of root; its number.

    They are written to a folder of their own and counted as they are written; a table that has not as many rows as expected, or none though it must be filled, is an error, and nothing is published. Then a pointer with the next
    number appears by one rename. Readers see the version before or this one, of all tables; a run that ends early leaves only a folder that no pointer names. Of two that
    publish at once the later fails.
    """
    spark = next(iter(tables.values())).sparkSession
    number, name = newest(spark, root) + 1, uuid.uuid4().hex
    folder = _path(spark, root, "versions", name)
    try:
        for table, rows in tables.items():
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder.toString()}/{table}")
            n = seen.get.get("rows", 0)
            if expected is not None and n != expected.get(table, n):
                raise ValueError(f"{table}: {n} rows instead of {expected[table]}: not published")
            if table in filled and not n:
                raise ValueError(f"{table}: no rows: not published")
        point(spark, root, number, name)
    except BaseException:
        _fs(spark, folder).delete(folder, True)
        raise
    return number


def read(spark: SparkSession, root: str, table: str, number: int | None = None) -> DataFrame:
    """A table of the newest version, or of that number. Read several tables of one number to have them of one version."""
    name = pointed(spark, root, number)[1]
    if name is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/versions/{name}/{table}")


def prune(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest versions, and what runs that ended early have left; how many folders went. Not while another run publishes, and with `keep` large enough for readers under way."""
    pointers = _pointers(spark, root)
    kept = {_read_text(spark, pointers[n]) for n in sorted(pointers)[-keep:]}
    for n in sorted(pointers)[:-keep]:
        _fs(spark, pointers[n]).delete(pointers[n], False)
    folder = _path(spark, root, "versions")
    fs = _fs(spark, folder)
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in kept] if fs.exists(folder) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
