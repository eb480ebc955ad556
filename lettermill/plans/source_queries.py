"""Queries over mailbox files that Spark writes from the driver's tables and reads again by ranges, and over streams of those tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.functions import mail as mailfn
from lettermill.functions import render
from lettermill.operators import archive, controls, manifests, printed, reconcile, reports, segments
from lettermill.plans import views as V
from lettermill.plans.mail_queries import _ORDERS, _SEMANTIC, _STORED, _framed, _messages, _placed
from lettermill.plans.queries import PADDED, query
from lettermill.sources import mail, prepare, sinks, versions
from lettermill.streaming import dates
from lettermill.tables import cut, shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lettermill/{name}-{uuid.uuid4().hex}"


def _mailboxes(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the mailboxes of all orders."""
    folder = _folder(spark, "mailboxes")
    sinks.write_mailboxes(_framed(spark, sf_dir), folder)
    return folder


def _split(spark: SparkSession, folder: str) -> int:
    """Bytes of a mailbox for one task: a few ranges for each core where the mailboxes are small, so that these too are cut; never more than usual."""
    total = mail.files(spark, folder).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return min(mail.SPLIT, max(64 << 10, total // (4 * spark.sparkContext.defaultParallelism)))


@query(f"""SELECT mailbox, sha256(replace(raw, chr(10) || 'From here', chr(10) || '>From here')) AS sha256 FROM {_STORED}""")
def s05_split_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail.register(spark)
    folder = _mailboxes(spark, sf_dir)
    found = spark.read.format("mail").option("split", _split(spark, folder)).load(folder)
    return found.select(F.regexp_extract("container", "/mailbox=([^/]+)/", 1).alias("mailbox"), F.sha2("raw", 256).alias("sha256"))


@query(f"""SELECT o_orderkey AS pk, CASE WHEN o_orderkey % 7 = 0 THEN 'damaged' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 7 <> 0 THEN sha256(raw) END AS sha256 FROM {_ORDERS} WHERE o_orderkey % 3 = 0""")
def s22_range_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _mailboxes(spark, sf_dir)
    stored = mail.records(mail.files(spark, folder).withColumn("start", F.lit(0)), split=_split(spark, folder))
    key = F.regexp_extract(F.col("raw").cast("string"), r"Message-ID: <M(\d+)@", 1).cast("long")
    places = cut(stored.select(key.alias("pk"), F.col("container").alias("filename"), F.col("position").alias("offset"), F.col("size").alias("length")))
    known = _placed(spark, sf_dir).select(F.col("position").cast("long").alias("pk"), F.when(F.col("position") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("raw", 256)).alias("sha256"))
    found = places.filter("pk % 3 = 0").join(known, "pk").withColumn("status", F.lit("ok"))
    return archive.read_ranges(found).select("pk", "status", F.sha2("raw", 256).alias("sha256"))


@query("""WITH g AS (SELECT *, count(own_date) OVER w AS seen, row_number() OVER w AS n FROM stream WINDOW w AS (PARTITION BY container ORDER BY position)),
y AS (SELECT *, CASE WHEN n = 1 AND own_date IS NULL THEN make_timestamp(path_year, 1, 1, 0, 0, 0) END AS year_date FROM g)
SELECT CAST(container AS VARCHAR) AS container, position, coalesce(own_date, year_date, last_value(coalesce(own_date, year_date) IGNORE NULLS) OVER (PARTITION BY container ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS date,
CASE WHEN own_date IS NOT NULL THEN 'date' WHEN year_date IS NOT NULL THEN 'path-year' ELSE 'previous-message' END AS date_source FROM y""")
def r04_carried_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream arrives in three parts, each a micro-batch of its own; the state of each container passes from one to the next."""
    s = V.stream(spark, sf_dir).withColumn("path_year", F.lit(1999))
    source, out = _folder(spark, "stream"), _folder(spark, "dates")
    low, high = s.agg(F.min("position"), F.max("position")).first()
    for k in range(3):
        part = s if low is None else s.filter(F.least(F.lit(2), F.floor((F.col("position") - low) * 3 / (high - low + 1))) == k)
        part.select("container", "position", "own_date", "path_year").write.mode("append").parquet(source)
        found = dates.carried(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
        if low is None:
            break
    return spark.read.schema("container string, position long, date timestamp_ntz, date_source string").parquet(out)


@query("""SELECT 'senders' AS part, sender AS name, count(*) AS messages FROM messages GROUP BY sender UNION ALL SELECT 'subjects', subject, count(*) FROM messages GROUP BY subject""")
def r11_published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables put in place together, over an older version of both."""
    m = V.messages(spark, sf_dir)
    root = _folder(spark, "index")
    of = lambda rows: {c: rows.groupBy(F.col(c[:-1]).alias("name")).agg(F.count(F.lit(1)).alias("messages")) for c in ("senders", "subjects")}
    versions.publish(of(m.filter("pk % 2 = 0")), root)
    number = versions.publish(of(m), root, {"senders": m.select("sender").distinct().count()})
    parts = [versions.read(spark, root, t, number).select(F.lit(t).alias("part"), "name", "messages") for t in ("senders", "subjects")]
    return parts[0].unionByName(parts[1])


@query("""WITH b AS (SELECT pk, CASE WHEN pk % 5 = 0 THEN concat('on the ', body) ELSE body END AS body FROM bodies WHERE pk % 7 <> 0 OR pk % 10 = 0)
SELECT pk FROM b WHERE contains(""" + PADDED.format("body") + """, ' on the ')""")
def k12_segmented_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added in three parts, some replaced, some removed and a few of these added again, merged: what a rebuild would give."""
    b = V.bodies(spark, sf_dir).select("pk", "body")
    root = _folder(spark, "segments")
    changed = F.when(F.col("pk") % 5 == 0, F.concat(F.lit("on the "), F.col("body"))).otherwise(F.col("body"))
    for k in range(3):
        segments.add(b.filter(F.col("pk") % 3 == k), root)
    segments.add(b.filter("pk % 5 = 0").withColumn("body", changed), root)
    segments.remove(b.filter("pk % 7 = 0"), root)
    segments.add(b.filter("pk % 70 = 0").withColumn("body", changed), root)
    segments.compact(spark, root)
    return segments.phrase(spark, root, ["on", "the"])


@query(f"""SELECT mailbox, sha256(replace(raw, chr(10) || 'From here', chr(10) || '>From here')) AS sha256, 'eml' AS form FROM {_STORED} WHERE mailbox <> 'INFECTED1.mbox'""")
def s28_prepared_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' mailboxes but the quarantined one, split into messages; as many as there are orders of the others, or nothing is published."""
    root = _folder(spark, "prepared")
    expected = _placed(spark, sf_dir).filter(sinks.mailbox_name(F.col("date"), F.col("category")) != "INFECTED1.mbox").count()
    prepare.prepare(spark, _mailboxes(spark, sf_dir), root, "messages", include=("**/part-*",), exclude=("mailbox=INFECTED1.mbox/*",), expected=expected)
    return versions.read(spark, root, "prepared").select(F.regexp_extract("source", "/mailbox=([^/]+)/", 1).alias("mailbox"), F.sha2("raw", 256).alias("sha256"), "form")


@query("""SELECT event_id AS observation_pk, event_type AS disposition, 'user ' || user_id AS detail, n_name AS path FROM events JOIN nation ON n_nationkey = user_id % 30 WHERE user_id % 7 = 3 ORDER BY 1""")
def f18_review_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("observation_pk"), (F.col("user_id") % 7).alias("run_pk"), (F.col("user_id") % 30).alias("source_pk"), F.col("event_type").alias("disposition"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("detail"))
    return reports.review(e, V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source_pk"), F.col("n_name").alias("path")), run=3)


@query(f"""SELECT o_orderkey AS pk, concat('To: s1@example.net, S1@example.net', chr(10), 'From: Ann <C', o_custkey, '@Example.org>', chr(10), 'Subject: order ', o_orderpriority, chr(10), 'Date: ', strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S'), ' +0100', chr(10), chr(10), 'Dear ', o_orderstatus, chr(10), 'From here', chr(10)) AS text FROM {_ORDERS}""")
def p13_text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.text_views(_orders(spark, sf_dir))


@query(f"""SELECT o_orderkey AS pk, '<M' || o_orderkey || '@example.org>' AS message_id, 0 AS attachments, '' AS error FROM {_ORDERS}""")
def p17_bag_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.bag_entries(_orders(spark, sf_dir).withColumn("fallback", F.lit("none")))


@query(f"""SELECT o_orderkey AS pk, concat('Ann <C', o_custkey, '@Example.org>', chr(10), 's1@example.net, S1@example.net', chr(10), chr(10), 'order ', o_orderpriority, chr(10), strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S'), ' +0100', chr(10), 'Dear ', o_orderstatus, chr(10), 'From here', chr(10)) AS content,
'c' || o_custkey || '@example.org=Ann,s1@example.net=' AS suggestions, 'Dear ' || o_orderstatus || ' From here' AS preview, 'order ' || o_orderpriority AS subject FROM {_ORDERS}""")
def p07_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = F.array_join(F.transform("suggestions", lambda s: F.concat(s["address"], F.lit("="), s["display_name"])), ",")
    return render.index_documents(_orders(spark, sf_dir)).select("pk", "content", people.alias("suggestions"), "preview", "subject")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select(F.col("o_orderkey").alias("pk"), "raw")


_REVIEWED = f"(SELECT *, sha256(raw) AS h2, {_SEMANTIC} AS h3 FROM {_ORDERS})"


@query(f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM {_REVIEWED} WHERE o_orderkey % 100 = 7 QUALIFY n <= 20),
v AS (SELECT n, h3, h2, 'cache' AS role, 'a' AS place, o_orderkey FROM c UNION ALL SELECT n, h3, sha256(replace(raw, 'To:', 'X-Seen: 1' || chr(10) || 'To:')), 'archive', 'b', o_orderkey FROM c)
SELECT CAST(n AS INTEGER) AS case_number, role, 'case-' || lpad(CAST(n AS VARCHAR), 2, '0') || '-h3-' || left(h3, 16) || CASE role WHEN 'cache' THEN '/apple-cache/cache-001-h2-' || left(h2, 16) ELSE '/canonical-archive/archive-001-message-' || o_orderkey || '-h2-' || left(h2, 16) END || '.eml' AS file, h2 AS sha256 FROM v""")
def k22_review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty of some orders as review cases: a cached message each, and the archive's with one more header field."""
    m = mailfn.parsed(_orders(spark, sf_dir).filter("pk % 100 = 7"), fields=("semantic_sha256",)).select("pk", "raw", F.col("m.semantic_sha256").alias("semantic"))
    first = m.orderBy("pk").limit(20).select("semantic", F.row_number().over(Window.orderBy("pk")).alias("case_number"))  # twenty rows
    cache = m.select("semantic", F.lit("cache").alias("role"), F.concat(F.lit("o"), F.col("pk").cast("string")).alias("reference"), F.lit(None).cast("long").alias("pk"), F.sha2("raw", 256).alias("sha256"), "raw")
    seen = F.replace(F.col("raw").cast("string"), F.lit("To:"), F.lit("X-Seen: 1\nTo:")).cast("binary")
    kept = m.select("semantic", F.lit("archive").alias("role"), F.concat(F.lit("m"), F.col("pk").cast("string")).alias("reference"), "pk", F.sha2(seen, 256).alias("sha256"), seen.alias("raw"))
    root = _folder(spark, "review")
    reconcile.export_review(first, cache.unionByName(kept), root)
    return versions.read(spark, root, "files").select("case_number", "role", "file", "sha256")


@query(f"""SELECT mailbox, n AS at, concat(n, chr(9), '"m', o_orderkey, '@example.org"', chr(9), 'h2:', sha256(raw), chr(9), 'h3:', semantic) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY o_orderkey) AS n, {_SEMANTIC} AS semantic FROM {_STORED})""")
def k04_integrity_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all mailboxes' manifests, written and read again."""
    found = mailfn.parsed(_framed(spark, sf_dir), fields=("message_id", "sha256", "semantic_sha256"))
    records = cut(found.select("mailbox", "position", "record", "m.message_id", "m.sha256", "m.semantic_sha256"))
    files = records.groupBy("mailbox").agg(F.sum(F.length("record") + 1).alias("bytes"), F.lit("0" * 64).alias("sha256"))
    folder = _folder(spark, "manifests")
    manifests.write_manifests(manifests.manifest_lines(records, files), folder)
    heads = len(manifests.REQUIRED) + 4
    return manifests.numbered_lines(spark, folder).filter(F.col("at") > heads).select("mailbox", (F.col("at") - heads).alias("at"), "line")


@query(f"""SELECT mailbox, CAST(sum(octet_length(encode(record)) + 1) AS BIGINT) AS bytes, 0::BIGINT AS faults FROM {_STORED} GROUP BY mailbox""")
def x06_checked_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mailboxes' bytes by the evidence of a checkpoint that a check has found to hold, and the faults of that check."""
    folder, root = _mailboxes(spark, sf_dir), _folder(spark, "controls")
    controls.checkpoint(spark, folder, root)
    n = controls.faults(spark, folder, root).count()
    box = F.regexp_extract("subject", "mailbox=([^/]+)/part-", 1)
    return controls.verify(spark, folder, root).filter(box != "").groupBy(box.alias("mailbox")).agg(F.sum("byte_length").alias("bytes"), F.lit(n).cast("long").alias("faults"))


@query("""SELECT o_orderkey AS pk, concat('Message-ID: <page-', sha256(o_orderkey || ''), '-p1@derived.invalid>', chr(10), 'X-Derived: printed-email', chr(10), 'X-Transcription-Status: machine-unreviewed', chr(10), 'X-Source-Name: ', o_orderkey, '.pdf', chr(10), 'X-Source-SHA256: ', sha256(o_orderkey || ''), chr(10), 'X-Source-Page: 1', chr(10),
'From: c', o_custkey, '@example.org', chr(10), 'Subject: ', o_orderpriority, ' and more', chr(10), 'MIME-Version: 1.0', chr(10), 'Content-Type: text/plain; charset="utf-8"', chr(10), 'Content-Transfer-Encoding: 8bit', chr(10), chr(10), 'Dear ', o_orderstatus, chr(10)) AS raw FROM orders""")
def k25_printed_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    name = F.col("o_orderkey").cast("string")
    page = F.concat(F.lit("From: c"), F.col("o_custkey").cast("string"), F.lit("@example.org\nX-Seen: 1\nSubject: "), F.col("o_orderpriority"), F.lit("\n and more\n\nDear "), F.col("o_orderstatus"), F.lit("\n\n\f"))
    rows = o.select(F.col("o_orderkey").alias("pk"), F.concat(name, F.lit(".pdf")).alias("source_name"), F.sha2(name, 256).alias("source_sha256"), page.alias("text"))
    return printed.derived(printed.messages(printed.pages(rows))).select("pk", F.col("raw").cast("string").alias("raw"))
