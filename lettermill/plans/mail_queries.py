"""Queries over messages built from the driver's tables: the record functions run as they do on mail, and SQL knows what must come out."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import html, mail
from lettermill.operators import identity, quality, verify
from lettermill.plans.queries import query
from lettermill.plans.views import table
from lettermill.sources import containers, sinks
from lettermill.tables import cut, dealt, shared_folder

#: A message of each order, in SQL that both engines read alike but for the date's format.
_RAW = """concat('From: Ann <C', o_custkey, '@Example.org>', chr(10), 'To: s1@example.net, S1@example.net', chr(10), 'Subject:  order', chr(10), ' ', o_orderpriority, chr(10),
'Message-ID: <M', o_orderkey, '@example.org>', chr(10), 'Date: ', {date}, ' +0100', chr(10), chr(10), 'Dear ', o_orderstatus, chr(10), 'From here', chr(10))"""
_SQL_RAW = _RAW.format(date="strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S')")
_ORDERS = f"(SELECT *, {_SQL_RAW} AS raw FROM orders)"
_ENVELOPE = "concat('From c', o_custkey, '@example.org ', strftime(o_orderdate - INTERVAL 1 HOUR, '%a %b '), lpad(CAST(day(o_orderdate - INTERVAL 1 HOUR) AS VARCHAR), 2, ' '), strftime(o_orderdate - INTERVAL 1 HOUR, ' %H:%M:%S %Y'), chr(10))"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_RAW.format(date="date_format(o_orderdate, 'EEE, dd MMM yyyy HH:mm:ss')"))
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"))
    return orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", raw.cast("binary").alias("raw"))


@query(f"""SELECT o_orderkey, 'm' || o_orderkey || '@example.org' AS message_id, sha256(raw) AS sha256, 'c' || o_custkey || '@example.org' AS sender, 's1@example.net/to' AS recipients,
'order ' || o_orderpriority AS subject, o_orderdate - INTERVAL 1 HOUR AS date, 'date' AS date_source, 'Dear ' || o_orderstatus || chr(10) || 'From here' || chr(10) AS body, 0 AS defects FROM {_ORDERS}""")
def p01_parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mail.with_date(mail.parsed(_messages(spark, sf_dir), fields=("message_id", "sha256", "sender", "recipients", "subject", "own_date", "received", "body_date", "body", "defects")))
    people = F.array_join(F.transform("m.recipients", lambda r: F.concat(r["address"], F.lit("/"), r["role"])), ",")
    return found.select("o_orderkey", "m.message_id", "m.sha256", "m.sender", people.alias("recipients"), "m.subject", F.col("own_date").alias("date"), "date_source", "m.body", F.size("m.defects").alias("defects"))


#: The semantic hash of a message of `_SQL_RAW`.
_SEMANTIC = """sha256(concat('lettermill/hash/semantic/v1', chr(0), 'from:Ann <C', o_custkey, '@Example.org>', chr(13), chr(10), 'to:s1@example.net, S1@example.net', chr(13), chr(10), 'date:', strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S'), ' +0100', chr(13), chr(10),
'message-id:<M', o_orderkey, '@example.org>', chr(13), chr(10), 'subject:order ', o_orderpriority, chr(13), chr(10), chr(13), chr(10), 'Dear ', o_orderstatus, chr(13), chr(10), 'From here', chr(13), chr(10)))"""


@query(f"SELECT o_orderkey, {_SEMANTIC} AS semantic FROM {_ORDERS}")
def i30_semantic_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.parsed(_messages(spark, sf_dir), fields=("semantic_sha256",)).select("o_orderkey", F.col("m.semantic_sha256").alias("semantic"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select(F.col("o_orderkey").alias("position"), F.col("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "P", "INFECTED").otherwise("Archive").alias("category"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("sender"), "raw", F.col("o_custkey").alias("owner"))


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.framed(_placed(spark, sf_dir))


_STORED = f"(SELECT *, {_ENVELOPE} || replace(raw, chr(10) || 'From here', chr(10) || '>From here') AS record, CASE WHEN o_orderstatus = 'P' THEN 'INFECTED1.mbox' ELSE year(o_orderdate) || '-Archive1.mbox' END AS mailbox FROM {_ORDERS})"


@query(f"""SELECT mailbox, o_orderkey AS position, CAST(row_number() OVER w AS INTEGER) AS ordinal, CAST(coalesce(sum(octet_length(encode(record)) + 1) OVER (PARTITION BY mailbox ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
octet_length(encode(record)) AS byte_length FROM {_STORED} WINDOW w AS (PARTITION BY mailbox ORDER BY o_orderkey)""")
def k01_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.locations(_framed(spark, sf_dir))


@query(f"""SELECT o_custkey AS container, CAST(coalesce(sum(octet_length(encode(record)) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position, sha256(replace(raw, chr(10) || 'From here', chr(10) || '>From here')) AS sha256 FROM {_STORED}""")
def s05_mailbox_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _framed(spark, sf_dir).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("position", "record"))).alias("r"))  # a customer has a few orders
    content = F.concat_ws("\n", F.transform("r", lambda r: r["record"].cast("string"))).cast("binary")
    boxes = one.select(F.col("owner").cast("string").alias("path"), F.lit("mbox").alias("kind"), content.alias("content"))
    return containers.records(boxes).select(F.col("container").cast("long").alias("container"), "position", F.sha2("raw", 256).alias("sha256"))


@query(f"""SELECT mailbox, ordinal, CASE WHEN o_orderkey % 7 = 0 THEN 'raw hash mismatch' ELSE 'missing record' END AS fault FROM (SELECT mailbox, o_orderkey, CAST(row_number() OVER (PARTITION BY mailbox ORDER BY o_orderkey) AS INTEGER) AS ordinal FROM {_STORED}) WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def v01_record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = mail.parsed(_framed(spark, sf_dir), fields=("sha256", "semantic_sha256"))
    r = cut(hashed.select("mailbox", "position", "record", "m.sha256", "m.semantic_sha256"))
    placed = r.join(sinks.locations(r).select("mailbox", "position", "ordinal"), ["mailbox", "position"])
    touched = placed.filter("position % 11 <> 0 OR position % 7 = 0").select("mailbox", "ordinal", F.when(F.col("position") % 7 == 0, F.concat("record", F.lit(b"x"))).otherwise(F.col("record")).alias("record"))
    return verify.record_faults(placed.select("mailbox", "ordinal", "sha256", "semantic_sha256"), touched)


_SIGNED = "'Hello' || chr(10) || chr(10) || '-- ' || chr(10) || 'Ann Bee' || chr(10) || c_custkey || '@example.org' || chr(10) || '+1 555 ' || (1000000 + c_custkey)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.evidence(dealt(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("pk"), F.expr(_SIGNED).alias("body")))


_FACTS = """SELECT pk, ordinal, line, kind, value, normalized, confidence FROM (SELECT c_custkey AS pk, unnest(range(0, 6))::INTEGER AS ordinal, unnest([0, 0, 1, 1, 2, 2])::INTEGER AS line, unnest(['text', 'name-candidate', 'text', 'email', 'text', 'phone']) AS kind,
unnest(['Ann Bee', 'Ann Bee', c_custkey || '@example.org', c_custkey || '@example.org', '+1 555 ' || (1000000 + c_custkey), '+1 555 ' || (1000000 + c_custkey)]) AS value,
unnest(['ann bee', 'ann bee', c_custkey || '@example.org', c_custkey || '@example.org', '+1 555 ' || (1000000 + c_custkey), '+1555' || (1000000 + c_custkey)]) AS normalized,
unnest([0.98::DOUBLE, 0.98::DOUBLE * 0.70::DOUBLE, 0.98::DOUBLE, 0.98::DOUBLE, 0.98::DOUBLE, 0.98::DOUBLE * 0.95::DOUBLE]) AS confidence FROM customer)"""


@query(_FACTS)
def i09_signature_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.facts(_evidence(spark, sf_dir))


#: Bodies of all four rules and of none, by number; quoted text and long texts before and after. No line is a number alone where no block must be: seven digits are a telephone number.
_BODY = """CASE {k} % 7 WHEN 0 THEN concat('Hi', chr(10), repeat(concat('line', chr(10)), 40), '--', chr(10), 'Ann Bee', chr(10), chr(10), {k}, chr(10), '> quoted', chr(10), '--', chr(10), 'Not seen')
WHEN 1 THEN concat('Hi', chr(10), 'Sent from my phone ', {k}, chr(10), chr(10), 'On Monday X wrote:', chr(10), 'call 555 123 4567')
WHEN 2 THEN concat('Hi', chr(10), 'Regards,', chr(10), chr(10), 'Bo ', chr(9), 'Li', chr(10), 'www.Example.org/', {k}, '.', chr(10), chr(10), 'bye')
WHEN 3 THEN concat('Hi', chr(13), chr(10), 'Thanks', chr(10), 'Cy Di', chr(10), 'x', {k}) WHEN 4 THEN concat('Hi', chr(10), '--', chr(10), '  ') WHEN 5 THEN concat('Thanks', chr(10), 'x', {k}) ELSE concat('From: x', chr(10), '--', chr(10), 'Ann') END"""


@query(f"""SELECT o_orderkey AS pk, CASE o_orderkey % 7 WHEN 0 THEN 'delimiter' WHEN 1 THEN 'mobile-footer' WHEN 2 THEN 'contact-block' ELSE 'signoff' END AS kind, CASE o_orderkey % 7 WHEN 0 THEN 0.98 WHEN 1 THEN 0.97 WHEN 2 THEN 0.88 ELSE 0.64 END::DOUBLE AS confidence,
CASE o_orderkey % 7 WHEN 0 THEN 42 ELSE 1 END AS start_line, CASE o_orderkey % 7 WHEN 0 THEN 44 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 3 END AS end_line,
CASE o_orderkey % 7 WHEN 0 THEN 'Ann Bee|' || o_orderkey WHEN 1 THEN 'Sent from my phone ' || o_orderkey WHEN 2 THEN 'Regards,|Bo ' || chr(9) || 'Li|www.Example.org/' || o_orderkey || '.' ELSE 'Thanks|Cy Di|x' || o_orderkey END AS lines FROM orders WHERE o_orderkey % 7 < 4""")
def i10_signature_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey"))
    found = identity.evidence(o.select(F.col("o_orderkey").alias("pk"), F.expr(_BODY.format(k="o_orderkey")).alias("body")))
    return found.withColumn("lines", F.array_join("lines", "|"))


def _relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = _messages(spark, sf_dir).select(F.col("o_orderkey").alias("pk"), F.concat(F.lit(b"List-Id: one\nlist-id: =?utf-8?q?tw=C3=B6?=\nPrecedence: bulk\n"), "raw", F.lit(b"-- \nAnn Bee\n")).alias("raw"))
    return identity.relations(m)


@query("""SELECT o_orderkey AS pk, unnest(['from', 'to', 'to']) AS role, unnest([0, 0, 1])::INTEGER AS ordinal, unnest(['c' || o_custkey || '@example.org', 's1@example.net', 's1@example.net']) AS address, unnest(['Ann', '', '']) AS display_name, unnest(['ann', '', '']) AS normalized_name FROM orders""")
def p16_header_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir)["header_observations"]


@query("SELECT o_orderkey AS pk, unnest(['list-id', 'list-id', 'precedence']) AS header, unnest([0, 1, 0])::INTEGER AS ordinal, unnest(['one', 'twö', 'bulk']) AS value FROM orders")
def p16_message_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir)["message_markers"]


@query("""SELECT count(*) AS messages, 0::BIGINT AS errors, 3 * count(*) AS header_observations, 3 * count(*) AS message_markers, count(DISTINCT o_custkey) + CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS distinct_addresses, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END::BIGINT AS distinct_nonempty_names, count(*) AS signature_blocks, 2 * count(*) AS signature_facts FROM orders""")
def a17_evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.summary(_relations(spark, sf_dir))


@query("""SELECT o_orderkey AS pk, 'ann bee' AS normalized, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS shard FROM orders""")
def k20_merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards, of which one is extracted twice, the first time with messages that it no longer has."""
    m = _messages(spark, sf_dir).select(F.col("o_orderkey").alias("pk"), F.concat("raw", F.lit(b"-- \nAnn Bee\n")).alias("raw"))
    root = f"{shared_folder(spark)}/lettermill/evidence-{uuid.uuid4().hex}"
    for shard, which in (("a", "pk % 6 = 0 OR pk % 3 = 1"), ("b", "pk % 3 <> 0"), ("a", "pk % 3 = 0")):
        identity.merge(m.filter(which), shard, root)
    return identity.read(spark, root, "signature_facts").filter("kind = 'name-candidate'").select("pk", "normalized", "shard")


@query("""SELECT sha256(o_orderkey || chr(10) || '{"model":"m","input":"' || o_orderpriority || '"}') AS id, upper(o_orderpriority) AS answer FROM orders""")
def j26_correlated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pk"), F.col("o_orderpriority").alias("prompt"))
    asked = identity.requests(o, "m")
    return identity.correlate(asked, asked.select("id", F.upper(F.get_json_object("body", "$.input")).alias("answer")))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND (lang = 'en' OR doc_id % 2 = 0)")
def f22_pdf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mime = F.when(F.col("lang") == "en", "Application/PDF").otherwise("text/plain")
    name = F.concat(F.lit("f"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".txt"))
    head = F.when(F.col("doc_id") % 3 == 0, F.lit(b"junk %PDF-1.4")).otherwise(F.lit(b"none"))
    return d.filter(quality.is_pdf(mime, name, head.cast("string"))).select("doc_id")


@query("""SELECT s_suppkey, 'root/Mail' || s_suppkey AS maildir, 'root/Box' AS package, 'root/plain.eml' AS plain, 'acct' || s_suppkey AS account FROM supplier""")
def s14_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    at = lambda *p: containers.hierarchy(F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p]))
    gmail = containers.gmail_account(F.concat(F.lit("x/acct"), k, F.lit("/[Gmail].mbox/All/1.emlx")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", at("root/Mail", k, "/cur/1:2,S").alias("maildir"), at("root/Box.mbox/Messages/1.emlx").alias("package"), at("root/plain.eml").alias("plain"), gmail.alias("account"))


@query("""SELECT account, CASE WHEN list_contains(have, 'ews') THEN 'ews' WHEN list_contains(have, 'imap') THEN 'imap' WHEN list_contains(have, 'pop') THEN 'pop' ELSE 'unknown' END AS service
FROM (SELECT c_custkey % 997 AS account, list(CASE c_mktsegment WHEN 'BUILDING' THEN 'ews' WHEN 'MACHINERY' THEN 'imap' WHEN 'AUTOMOBILE' THEN 'pop' ELSE 'other' END) AS have FROM customer GROUP BY c_custkey % 997)""")
def s21_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "ews").when(F.col("c_mktsegment") == "MACHINERY", "imap").when(F.col("c_mktsegment") == "AUTOMOBILE", "pop").otherwise("other")
    return containers.services(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 997).alias("account"), kind.alias("service")))


@query()
def i19_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: mail.html_text(x or ""))

    text = F.pandas_udf(run, "string")
    return dealt(table(spark, sf_dir, "pages").select("page_id", "html"), 2_000).select("page_id", text("html").alias("text"))


@query()
def i20_safe_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html.sanitized(x or "") for x in s], columns=["html", "blocked"])

    safe = F.pandas_udf(run, "html string, blocked boolean")
    return dealt(table(spark, sf_dir, "pages").select("page_id", "html"), 2_000).select("page_id", safe("html").alias("s")).select("page_id", "s.html", "s.blocked")
