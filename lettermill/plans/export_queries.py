"""Queries of exports and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import view
from lettermill.operators import export, printed, provenance, quality
from lettermill.plans import views as V
from lettermill.plans.queries import query
from lettermill.plans.views import table
from lettermill.tables import dealt


@query("""SELECT address, bool_or(sent) AS is_owner, count(DISTINCT original) AS spellings, NULL::VARCHAR AS fault FROM (
SELECT lower(trim(sender)) AS address, sender AS original, category = 'Sent' AS sent FROM messages UNION ALL SELECT lower(trim(address)), address, FALSE FROM recipients) GROUP BY address""")
def k18_address_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.address_book(V.messages(spark, sf_dir), V.recipients(spark, sf_dir))


@query("SELECT lower(sender) AS address, count(*) AS messages FROM messages WHERE regexp_matches(sender, '^c[0-9]*5@example\\.org$') GROUP BY 1")
def k19_detected_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.detected_owners(V.messages(spark, sf_dir), ["c*5@example.org"], [])


@query("SELECT doc_id, source, CAST(sum(n_chars) OVER w AS BIGINT) AS total, sum(n_chars) OVER w <= 50000 AS fits FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)")
def w08_expansion_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.within_budget(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 50_000, "source").select("doc_id", "source", "total", "fits")


@query("SELECT user_id AS run, CASE WHEN event_type = 'click' AND epoch(TIMESTAMP '2024-01-15' - max_ts) > 60 THEN 'stale' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS state FROM (SELECT user_id, event_type, max(ts) AS max_ts FROM events GROUP BY 1, 2)")
def w09_stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").cast("timestamp").alias("updated_at"))
    status = runs.select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("state"), F.lit("").alias("phase"), "updated_at")
    return export.effective(status, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("run", "state")


@query("""SELECT doc_id, CASE WHEN n >= 3600 THEN printf('%dh %dm %ds', n // 3600, n // 60 % 60, n % 60) WHEN n >= 60 THEN printf('%dm %ds', n // 60, n % 60) ELSE printf('%ds', n) END AS shown FROM (SELECT doc_id, CAST(ceil(n_chars / 3.0) AS BIGINT) AS n FROM documents)""")
def i16_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", export.duration(F.col("n_chars") / 3.0).alias("shown"))


@query("SELECT doc_id, NOT ((lang = 'en' AND doc_id % 3 = 0) OR (lang = 'de' AND doc_id % 3 = 1)) AS risky FROM documents")
def f29_risky_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("lang") == "en", "image/PNG").when(F.col("lang") == "de", "application/pdf").otherwise("text/html")
    name = F.concat(F.lit("a.b"), F.when(F.col("doc_id") % 3 == 0, ".PNG").when(F.col("doc_id") % 3 == 1, ".pdf").otherwise(".exe"))
    return table(spark, sf_dir, "documents").select("doc_id", export.is_risky(mime, name).alias("risky"))


@query("""SELECT CASE doc_id % 4 WHEN 0 THEN 'mbox' WHEN 1 THEN 'text' WHEN 2 THEN 'pdf' ELSE 'other' END AS format, count(*) AS files, CAST(sum(octet_length(encode(text)) + CASE doc_id % 4 WHEN 0 THEN 5 WHEN 2 THEN 5 ELSE 1 END) AS BIGINT) AS bytes FROM documents GROUP BY 1""")
def s31_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 4 == 0, "From ").when(F.col("doc_id") % 4 == 2, "%PDF-").otherwise("=")
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 1, ".TXT").otherwise(".x")).alias("path"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"))
    return export.format_inventory(files.withColumn("length", F.length("content")))


@query("""SELECT year(date) AS year, date_source, count(*) AS messages, 0::BIGINT AS missing_senders, 0::BIGINT AS errors FROM (
SELECT ts AS date, CASE WHEN event_type = 'error' THEN 'received' ELSE 'date' END AS date_source FROM events) GROUP BY 1, 2""")
def s32_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return export.audit(e.select(F.col("ts").alias("date"), F.when(F.col("event_type") == "error", "received").otherwise("date").alias("date_source"), F.lit("x").alias("sender"), F.lit(None).cast("string").alias("error")))


@query("""WITH n AS (WITH e AS (SELECT pk, volume, list_filter(string_split(path, '/'), lambda p: p <> '') AS names FROM paths),
x AS (SELECT pk, volume, unnest(list_transform(range(0, len(names) + 1), lambda i: array_to_string(list_slice(names, 1, i), '/'))) AS path FROM e)
SELECT volume, path, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth, count(DISTINCT pk) AS messages FROM x GROUP BY volume, path),
p AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS parent FROM n),
h AS (SELECT volume, parent FROM p WHERE depth > 0 GROUP BY volume, parent HAVING max(messages) = 1 AND count(*) > 1)
SELECT volume, path, depth, messages FROM p WHERE (volume, parent) NOT IN (SELECT volume, parent FROM h)""")
def i39_collapsed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.collapsed(provenance.tree(V.paths(spark, sf_dir)))


@query("""SELECT doc_id, octet_length(encode(text)) AS byte_count, length(text) AS character_count, len(regexp_extract_all(text, '[^\\s\\x{A0}\\x{85}\\x{0B}]+')) AS word_count, len(regexp_extract_all(text, '(?im)^\\s*(?:from|to|cc|bcc|subject|date|sent):\\s*\\S')) AS mail_header_count,
length(text) - length(replace(text, chr(65533), '')) AS replacement_count, (length(text) - length(replace(text, 'Ã', ''))) + (length(text) - length(replace(text, 'Â', ''))) + (length(text) - length(replace(text, 'â€', ''))) // 2 + (length(text) - length(replace(text, 'ðŸ', ''))) // 2 AS mojibake_count,
len(list_filter(regexp_split_to_array(text, '[\\s\\x{A0}]+'), lambda w: length(w) > 80)) AS very_long_tokens FROM documents""")
def p19_text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.text_metrics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "byte_count", "character_count", "word_count", "mail_header_count", "replacement_count", "mojibake_count", "very_long_tokens")


@query("""SELECT o_orderkey AS document, 1 AS page, CASE WHEN o_orderstatus = 'P' THEN 'non-message' ELSE 'printed-email' END AS classification, o_orderpriority || ' and more' AS subject, 'Dear ' || o_custkey || chr(10) || 'bye' AS body FROM orders
UNION ALL SELECT o_orderkey, 2, 'non-message', NULL, 'page two of ' || o_orderkey FROM orders""")
def s25_printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.col(c).cast("string")
    who = F.when(F.col("o_orderstatus") == "P", "X-By: ").otherwise("From: ")
    text = F.concat(F.lit("\n\nDate: 1999\nSUBJECT: "), F.col("o_orderpriority"), F.lit("\n   and more\n"), who, key("o_custkey"), F.lit("\n\nDear "), key("o_custkey"), F.lit("\nbye\n\f"), F.lit("page two of "), key("o_orderkey"), F.lit("\n\f"))
    found = printed.messages(printed.pages(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"), text.alias("text"))))
    return found.select("document", "page", "classification", printed.field("subject").alias("subject"), "body")


def _mixed(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """A message with a plain part, an html part where the key is even, and a picture for each order; `only` these of it are read."""
    key = F.col("o_orderkey").cast("string")
    part = lambda kind, body: F.concat(F.lit(f"--b\nContent-Type: {kind}\n\n"), body, F.lit("\n"))
    html = F.when(F.col("o_orderkey") % 2 == 0, part("text/html", F.concat(F.lit("<p onclick='x'>"), key, F.lit("</p>")))).otherwise("")
    raw = F.concat(F.lit('Subject: s\nX-A: 1\nx-a: 2\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n'), part("text/plain", key), html, part("image/png; name=\"a b.png\"", key), F.lit("--b--\n"))
    return view.shown(dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("pk"), raw.cast("binary").alias("raw")), only=only)


@query("SELECT o_orderkey AS pk, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS preferred, CAST(5 AS BIGINT) AS headers, 1 AS last_x_a FROM orders")
def p12_message_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.element_at(F.filter("v.headers", lambda h: F.lower(h["name"]) == "x-a"), -1)["occurrence"]
    return _mixed(spark, sf_dir, "headers", "text", "html").select("pk", view.preferred().alias("preferred"), F.size("v.headers").cast("long").alias("headers"), last.alias("last_x_a"))


@query("""SELECT o_orderkey AS pk, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS part, 'a_b.png' AS filename, 'image/png' AS mime_type, CAST(length(CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS bytes,
FALSE AS inline, 'image' AS preview, FALSE AS risky, base64(encode(CAST(o_orderkey AS VARCHAR))) AS content_base64 FROM orders""")
def p21_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.attachments(_mixed(spark, sf_dir, "attachment"), "pk")
