"""Queries on values and sizes that the smallest tables lack, each against its SQL."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers all queries
from lettermill.functions import text
from lettermill.plans import queries


@pytest.fixture
def against_sql(spark, tmp_path):
    """A function that runs a query and its SQL on tables given as SQL, and compares the rows."""

    def compare(name, **tables):
        c = duckdb.connect()
        for t, sql in tables.items():
            c.sql(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        want = c.sql(queries.ORACLE_SQL[name])
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))

    return compare


def test_byte_sizes_of_halves(spark, against_sql):
    against_sql("i16_byte_sizes", documents="SELECT k AS doc_id, k AS n_chars FROM range(0, 40000, 3) t(k)")
    rows = spark.createDataFrame([(1280,), (1792,), (1023,), (1024,), (1048575,), (5 << 18,), (7 << 18,), (5 << 28,), (1 << 62,)], "n long")
    got = [r["s"] for r in rows.select(text.byte_size(rows["n"]).alias("s")).collect()]
    assert got == ["1.2 KiB", "1.8 KiB", "1023 B", "1.0 KiB", "1024.0 KiB", "1.2 MiB", "1.8 MiB", "1.2 GiB", "4294967296.0 GiB"]


def test_csv_rows_of_long_numbers(against_sql):
    against_sql("k05_csv_rows", documents="SELECT k AS doc_id, 's' || k AS source FROM range(99990, 100010) t(k)")


def test_signature_blocks_of_long_numbers(against_sql):
    against_sql("i10_signature_blocks", orders="SELECT k AS o_orderkey FROM range(999990, 1000020) t(k)")


def test_simple_messages_are_parsed_as_email_does():
    from email import policy
    from email.parser import BytesParser

    from lettermill.functions.mail import message, read_message

    for raw in (b"A: x\nB:  \n y\nB: z \n\nHi\xc3\xb6\n\n", b"A: x\n \n\n", b"\nonly", b"A: x\r\n\r\nb", b"From x\nA: b\n\nc", b"A: \xff\n\nb", b"A: x\nno end", b"Content-Type: text/html\n\n<p>", b": x\n\ny", b"A:\tb\n\n"):
        want, got = BytesParser(policy=policy.compat32).parsebytes(raw), message(raw)
        assert (got.items(), got.get_payload(), got.get_payload(decode=True), got.is_multipart()) == (want.items(), want.get_payload(), want.get_payload(decode=True), want.is_multipart())
        full = read_message(raw)
        for fields in (["sha256", "semantic_sha256"], ["message_id"], ["sender", "subject", "defects"], ["body", "own_date"]):
            assert read_message(raw, fields=fields) == {n: full[n] for n in fields}


def test_one_row_group_is_dealt_out(spark, tmp_path):
    from pyspark.sql import functions as F

    from lettermill.tables import dealt

    path = str(tmp_path / "one")
    spark.range(40_000).coalesce(1).write.parquet(path)
    found = dealt(spark.read.parquet(path), 5_000)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) <= 6_000


def test_manifests_parse_each_message_once(spark, against_sql, monkeypatch):
    from lettermill.functions import mail

    seen, original = spark.sparkContext.accumulator(0), mail.parsed

    def parsed(records, **options):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return original(records.mapInArrow(run, records.schema), **options)

    monkeypatch.setattr(mail, "parsed", parsed)
    against_sql("k04_integrity_manifests", orders="SELECT k AS o_orderkey, k % 50 AS o_custkey, TIMESTAMP '1996-01-02' + INTERVAL (k) DAY AS o_orderdate, CASE WHEN k % 9 = 0 THEN 'P' ELSE 'O' END AS o_orderstatus, '5-LOW' AS o_orderpriority FROM range(300) t(k)")
    assert seen.value == 300
