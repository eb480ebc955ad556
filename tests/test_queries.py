"""Every registered query against its SQL on the smallest tables; plans of the hot ones."""

import os

import duckdb
import pytest

import __spark_entry__
from lettermill.operators import reports, search
from lettermill.plans import export_queries, mail_queries, queries, views  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if x is None or x != x else round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False)), key=repr), list(df.columns)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        assert normal(got) == normal(duck.sql(queries.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    m, r = views.messages(spark, SF), views.recipients(spark, SF)
    found = search.select(m, r, search.parse("to:s1 any:c12"))
    assert plan(found).count("LeftSemi") >= 2
    assert "LeftAnti" in plan(reports.meaningful(m, r, reports.owners(m)))
    assert "TakeOrderedAndProject" in plan(search.page(found, "subject", True, 10))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan(search.select(m, r, search.parse("date:1996-01-02")))
    assert "WindowGroupLimit" in plan(queries.QUERIES["w06_outliers"](spark, SF))


def test_parser():
    t = search.parse('subject:"Big News" x:y plain after:2001-02-03')
    assert t.selectors == [("subject", "big news"), ("after", "2001-02-03")] and t.phrases == ["x:y", "plain"]
    for bad in ("from:", "date:2001-13-01"):
        with pytest.raises(ValueError):
            search.parse(bad)


def test_owner_resolution(spark):
    m = spark.createDataFrame([(1, "A@x.org", "Sent"), (2, "b@x.org", "Archive")], "pk long, sender string, category string")
    assert [r["address"] for r in reports.resolve_owners(m, ["b@X.org"], []).collect()] == ["b@x.org"]
    assert [r["address"] for r in reports.resolve_owners(m, [], ["a@"]).collect()] == ["a@x.org"]
    for addresses, aliases in ((["c@x.org"], []), ([], ["b@"]), ([], [])):
        with pytest.raises(ValueError):
            reports.resolve_owners(m, addresses, aliases)
