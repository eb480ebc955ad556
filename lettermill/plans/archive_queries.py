"""Queries of the archive's own tables: reading by number, dictionaries, upserts, gates, review sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators import archive, reconcile, reports, search
from lettermill.plans import views as V
from lettermill.plans.queries import _CACHE, _SUGGESTIONS, SEARCHABLE, _stores, _suggestions, query
from lettermill.plans.views import table

_PLACES = """known AS (SELECT pk, sha256(sender) AS sha256 FROM messages WHERE pk % 11 <> 0),
places AS (SELECT pk, pk % 30 AS generation, pk * 3 AS "offset", 10 AS length FROM messages WHERE pk % 5 <> 0),
generations AS (SELECT n_nationkey AS generation, n_name AS filename FROM nation)"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = V.messages(spark, sf_dir)
    known = m.filter("pk % 11 <> 0").select("pk", F.sha2("sender", 256).alias("sha256"))
    places = m.filter("pk % 5 <> 0").select("pk", (F.col("pk") % 30).alias("generation"), (F.col("pk") * 3).alias("offset"), F.lit(10).alias("length"))
    return known, places, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("generation"), F.col("n_name").alias("filename"))


@query(f"""WITH {_PLACES} SELECT a.pk, CASE WHEN k.pk IS NULL THEN 'no-message' WHEN g.filename IS NULL THEN 'no-location' ELSE 'ok' END AS status, coalesce(g.filename, '') AS filename,
CASE WHEN g.filename IS NOT NULL THEN p."offset" ELSE -1 END AS "offset", CASE WHEN g.filename IS NOT NULL THEN p.length ELSE -1 END AS length, coalesce(k.sha256, '') AS sha256
FROM (SELECT DISTINCT l_partkey AS pk FROM lineitem) a LEFT JOIN known k USING (pk) LEFT JOIN (places p JOIN generations g USING (generation)) USING (pk)""")
def j12_message_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive.lookup(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pk")), *_places(spark, sf_dir))
    return found.fillna(-1, ["offset", "length"]).fillna("", ["filename", "sha256"])


@query("""WITH d AS (SELECT doc_id AS pk, unhex(substr(hex(encode(text)), 9, 80)) AS raw FROM documents)
SELECT pk, CASE WHEN pk % 4 = 3 THEN 'no-location' WHEN pk % 5 = 4 THEN 'no-container' WHEN pk % 9 = 0 THEN 'damaged' ELSE 'ok' END AS status, CASE WHEN pk % 4 < 3 AND pk % 5 < 4 AND pk % 9 > 0 THEN hex(raw) END AS raw FROM d""")
def s23_read_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), F.encode("text", "UTF-8").alias("content"))
    raw = F.substring("content", F.lit(5), F.lit(40))
    messages = d.select("pk", F.when(F.col("pk") % 9 == 0, "x").otherwise(F.sha2(raw, 256)).alias("sha256"))
    places = d.select("pk", F.col("pk").alias("generation"), F.lit(4).alias("offset"), F.lit(40).alias("length"))
    generations = d.filter("pk % 4 <> 3").select(F.col("pk").alias("generation"), F.col("pk").cast("string").alias("filename"))
    containers = d.filter("pk % 5 <> 4").select(F.col("pk").cast("string").alias("filename"), "content")
    return archive.read_records(archive.lookup(d, messages, places, generations), containers).withColumn("raw", F.hex("raw"))


@query(f"""WITH {_PLACES} SELECT c.conv_id AS pk, c.turn AS ordinal, g.filename, p."offset" FROM conversations c JOIN known k ON k.pk = c.conv_id JOIN places p ON p.pk = c.conv_id JOIN generations g USING (generation)""")
def j23_attachment_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pk"), F.col("turn").alias("ordinal"))
    return archive.attachment_places(a, *_places(spark, sf_dir)).select("pk", "ordinal", "filename", "offset")


@query(f"""SELECT pk, sender, (SELECT count(*) > 60 FROM messages WHERE {SEARCHABLE} AND contains(sender, '3@')) AS has_more FROM messages WHERE {SEARCHABLE} AND contains(sender, '3@') ORDER BY lower(sender), pk LIMIT 60""")
def t06_page_with_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.searchable(V.messages(spark, sf_dir)).filter(F.col("sender").contains("3@"))
    return archive.page_with_more(found, "sender", False, 60).select("pk", "sender", "has_more")


@query(f"SELECT pk, date FROM messages WHERE {SEARCHABLE} AND contains(lower(subject), 'urgent 9') ORDER BY date DESC, pk DESC LIMIT 40")
def t04_recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.messages(spark, sf_dir)
    of = lambda rows: search.select(rows, V.recipients(spark, sf_dir), search.parse("subject:'urgent 9'"))
    return archive.recent_first(of(archive.newest(reports.searchable(m), 1000)), of(m), "date", True, 40).select("pk", "date")


_WANTED = [7, 3, 7, 32, 999_999_999, 1, 2, 3, 4, 5, 6, 33, 34]


@query(f"""WITH w AS (SELECT CAST(min(n) AS BIGINT) AS n, pk FROM (SELECT unnest({_WANTED}) AS pk, unnest(range(0, {len(_WANTED)})) AS n) GROUP BY pk),
placed AS (SELECT CAST(row_number() OVER (ORDER BY n) AS INTEGER) AS place, pk FROM w)
SELECT place, pk, subject, left(body, 30) AS preview FROM placed JOIN messages USING (pk) LEFT JOIN (SELECT pk, body FROM bodies WHERE pk % 2 = 1) USING (pk)""")
def t14_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.bodies(spark, sf_dir).filter("pk % 2 = 1").select("pk", F.left("body", F.lit(30)).alias("preview"))
    return archive.previews(spark, _WANTED, V.messages(spark, sf_dir), p)


@query("""WITH known AS (SELECT s_suppkey AS address_pk, 's' || s_suppkey || '@example.net' AS address FROM supplier WHERE s_suppkey % 2 = 0),
fresh AS (SELECT address FROM (SELECT sender AS address FROM messages UNION SELECT address FROM recipients) WHERE address NOT IN (SELECT address FROM known))
SELECT address_pk, address FROM known UNION ALL SELECT row_number() OVER (ORDER BY address) + (SELECT max(address_pk) FROM known), address FROM fresh""")
def k07_address_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("long").alias("address_pk"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@example.net")).alias("address"))
    used = V.messages(spark, sf_dir).select(F.col("sender").alias("address")).union(V.recipients(spark, sf_dir).select("address"))
    return archive.extend_dictionary(known, used)


@query("SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) AS at FROM events GROUP BY user_id")
def k09_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("at"))
    return archive.upsert(e.filter("at % 3 = 0"), e.filter("at % 3 <> 0"), ["user_id"], "at")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) + CASE WHEN event_id % 2 = 1 THEN coalesce(n, 0) ELSE 0 END AS ordinal FROM events LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY user_id) USING (user_id)")
def k11_evidence_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    none = spark.createDataFrame([], "user_id long, ordinal long")
    first = archive.append_evidence(none, e.filter("event_id % 2 = 0"), "user_id", "event_id")
    return first.unionByName(archive.append_evidence(first, e.filter("event_id % 2 = 1"), "user_id", "event_id"))


@query(_SUGGESTIONS.replace(f"FROM messages WHERE {SEARCHABLE} UNION", f"FROM messages WHERE {SEARCHABLE} AND pk % 3 > 0 UNION").replace(f"USING (pk) WHERE {SEARCHABLE})", f"USING (pk) WHERE {SEARCHABLE} AND pk % 3 > 0)"))
def k13_index_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.searchable(V.messages(spark, sf_dir)).select("pk", "date", "sender")
    seen = m.select("pk", "date", F.col("sender").alias("address")).union(m.join(V.recipients(spark, sf_dir), "pk").select("pk", "date", "address"))
    return archive.without_messages(_suggestions(spark, sf_dir), seen, m.filter("pk % 3 = 0").select("pk"))


@query("SELECT pk, subject || '!' AS subject FROM messages WHERE pk % 13 = 0")
def k15_changed_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.messages(spark, sf_dir)
    return archive.changed_subjects(m, m.select("pk", F.when(F.col("pk") % 13 == 0, F.concat("subject", F.lit("!"))).otherwise(F.col("subject")).alias("subject")))


@query(f"SELECT 'f' || (pk % 5) AS filename, count(*) AS messages, count(*) FILTER ({SEARCHABLE}) AS searchable FROM messages GROUP BY 1 UNION ALL SELECT NULL, count(*), count(*) FILTER ({SEARCHABLE}) FROM messages")
def a09_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.messages(spark, sf_dir)
    return archive.totals(m, m.select("pk", F.concat(F.lit("f"), (F.col("pk") % 5).cast("string")).alias("filename")))


@query("""WITH f AS (SELECT source AS filename, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS x, count(*) FILTER (doc_id % 7 = 0 AND doc_id % 2 = 0) AS leaked FROM documents GROUP BY source)
SELECT filename, CASE WHEN filename = 'src1' THEN 'missing' ELSE 'record count differs' END AS fault FROM f WHERE filename IN ('src1', 'src2')
UNION ALL SELECT filename, 'index count differs' FROM f WHERE filename NOT IN ('src1', 'src2') AND x <> n UNION ALL SELECT filename, 'quarantined message indexed' FROM f WHERE leaked > 0""")
def v06_rebuild_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("filename"), F.col("doc_id").alias("pk"))
    n = d.groupBy("filename").agg(F.count(F.lit(1)).alias("records"))
    counted = n.filter("filename <> 'src1'").withColumn("records", F.when(F.col("filename") == "src2", F.col("records") + 1).otherwise(F.col("records")))
    return archive.rebuild_gate(n, counted, d.filter("pk % 2 = 0"), d.filter("pk % 14 = 0"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 1 THEN 'gone' WHEN doc_id % 10 = 2 THEN 'new' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (1, 2, 3, 4)")
def r02_changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("length"), F.lit(1).alias("modified"))
    after = d.withColumn("length", F.when(F.col("doc_id") % 10 == 3, F.col("length") + 1).otherwise(F.col("length"))).withColumn("modified", F.when(F.col("doc_id") % 10 == 4, 2).otherwise(1))
    return archive.changed_sources(d.filter("doc_id % 10 <> 2"), after.filter("doc_id % 10 <> 1"))


@query("SELECT conv_id AS pk, lower(role) AS address, coalesce(arg_min(left(text, 6), turn) FILTER (length(text) % 3 > 0 AND text <> ''), '') AS name FROM conversations WHERE role <> '' GROUP BY conv_id, lower(role)")
def p11_first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pk"), F.col("turn").alias("ordinal"), F.lower("role").alias("address"), F.when(F.length("text") % 3 > 0, F.left("text", F.lit(6))).otherwise("").alias("name"))
    return archive.first_names(c)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'v ' || lang WHEN 1 THEN '/mnt/' || source ELSE 'Unknown source volume' END AS label FROM documents")
def p15_volume_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    json = F.to_json(F.struct(F.when(k == 0, F.concat(F.lit("v "), "lang")).otherwise("").alias("volume_label"), F.when(k < 2, F.concat(F.lit("/mnt/"), "source")).alias("current_mount_path")))
    return d.select("doc_id", archive.volume_label(json).alias("label"))


@query("""SELECT pk, CASE WHEN pk % 2 = 0 OR pk % 3 = 0 THEN sender ELSE '' END AS candidates, CASE WHEN pk % 2 = 0 THEN 'sender' WHEN pk % 3 = 0 THEN 'return_path' ELSE '' END AS candidate_field,
CASE WHEN pk % 7 = 0 THEN 'recoverable-from' WHEN pk % 2 = 0 OR pk % 3 = 0 THEN 'recoverable-fallback-header' WHEN pk % 5 = 0 THEN 'recoverable-source-envelope' WHEN pk % 11 = 0 THEN 'gmail-chat-or-export' WHEN pk % 13 = 0 THEN 'invalid-from' ELSE 'no-from-or-fallback' END AS kind FROM messages""")
def p20_missing_sender_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.messages(spark, sf_dir)
    when = lambda k, c: F.when(F.col("pk") % k == 0, c)
    one = F.array("sender")
    rows = m.select("pk", when(7, one).alias("from_addresses"), when(13, F.lit("?")).alias("from_value"), when(2, F.array(F.upper("sender"), F.lit(""))).alias("sender"), F.array().cast("array<string>").alias("reply_to"), when(3, one).alias("return_path"), when(5, F.lit("From x")).alias("envelope"), when(11, F.lit("1")).alias("thread"))
    return archive.missing_kind(rows).select("pk", F.array_join("candidates", ",").alias("candidates"), "candidate_field", "kind")


@query(f"WITH {_CACHE} SELECT DISTINCT c.cache_pk, a.pk, semantic FROM cache c JOIN archive a USING (semantic) WHERE a.pk IS NOT NULL AND c.raw NOT IN (SELECT raw FROM archive WHERE pk IS NOT NULL)")
def j19_semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.semantic_pairs(*_stores(spark, sf_dir))


@query(f"""WITH {_CACHE}, known AS (SELECT DISTINCT pk, semantic FROM archive WHERE pk IS NOT NULL), met AS (SELECT cache_pk, service, pk FROM cache JOIN known USING (semantic)),
kinds AS (SELECT service, count(*) AS compared, count(*) FILTER (e) AS exact, count(*) FILTER (NOT e AND s) AS semantic, count(*) FILTER (NOT e AND NOT s) AS cache_only FROM (
  SELECT service, raw IN (SELECT raw FROM archive WHERE pk IS NOT NULL) AS e, semantic IN (SELECT semantic FROM known) AS s FROM cache) GROUP BY service),
files AS (SELECT source AS service, count(*) FILTER (doc_id % 5 > 1) AS complete_emlx, count(*) FILTER (doc_id % 5 = 0) AS partial_emlx, count(*) FILTER (doc_id % 5 = 1) AS unreadable_emlx FROM documents GROUP BY source)
SELECT service, complete_emlx, partial_emlx, unreadable_emlx, coalesce(compared, 0) AS compared, coalesce(exact, 0) AS exact, coalesce(semantic, 0) AS semantic, coalesce(cache_only, 0) AS cache_only,
(SELECT count(DISTINCT pk) FROM met m WHERE m.service = f.service) AS archive_matches, (SELECT count(*) FROM (SELECT cache_pk FROM met m WHERE m.service = f.service GROUP BY cache_pk HAVING count(DISTINCT pk) > 1)) AS ambiguous,
(SELECT count(*) FROM cache c WHERE c.service = f.service AND cache_pk % 2 = 0) AS header_pairs, (SELECT count(*) FROM cache c WHERE c.service = f.service AND cache_pk % 4 = 0) AS formatting_only
FROM files f LEFT JOIN kinds USING (service)""")
def a13_service_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, stored = _stores(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    state = F.when(F.col("doc_id") % 5 == 0, "partial").when(F.col("doc_id") % 5 == 1, "unreadable").otherwise("complete")
    compared = cache.filter("cache_pk % 2 = 0").select("cache_pk", (F.col("cache_pk") % 4 == 0).alias("only_formatting"))
    return reconcile.service_report(cache, stored, d.select(F.col("source").alias("service"), state.alias("state")), compared)


_VARIANTS = f"""{_CACHE}, variants AS (SELECT semantic, 'cache' AS role, raw, service AS date, CAST(cache_pk % 2 AS VARCHAR) AS subject, cache_pk % 3 = 0 AS autosave FROM cache
UNION ALL SELECT semantic, 'archive', raw, 'src1', CAST(pk % 2 AS VARCHAR), false FROM archive WHERE pk IS NOT NULL),
cases AS (SELECT semantic, count(DISTINCT raw) AS distinct_raw, count(*) AS variants, count(*) FILTER (autosave) AS autosaves, count(DISTINCT coalesce(date, '')) = 1 AS date_agrees, count(DISTINCT coalesce(subject, '')) = 1 AS subject_agrees,
  bool_and(coalesce(date, '') <> '') AS date_on_all, bool_and(coalesce(subject, '') <> '') AS subject_on_all, count(DISTINCT role || raw) > count(DISTINCT raw) AS shared_across_stores FROM variants GROUP BY semantic HAVING count(DISTINCT raw) > 1)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, stored = _stores(spark, sf_dir)
    c = cache.select("semantic", F.lit("cache").alias("role"), "raw", F.col("service").alias("date"), (F.col("cache_pk") % 2).cast("string").alias("subject"), (F.col("cache_pk") % 3 == 0).alias("autosave"))
    a = stored.filter("pk IS NOT NULL").select("semantic", F.lit("archive").alias("role"), "raw", F.lit("src1").alias("date"), (F.col("pk") % 2).cast("string").alias("subject"), F.lit(False).alias("autosave"))
    return reconcile.review_cases(c.unionByName(a))


@query(f"WITH {_VARIANTS} SELECT * FROM cases")
def p23_review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)


@query(f"WITH {_VARIANTS} SELECT count(*) AS cases, coalesce(sum(variants), 0)::BIGINT AS variants, coalesce(sum(distinct_raw), 0)::BIGINT AS distinct_raw, count(*) FILTER (shared_across_stores) AS shared, count(*) FILTER (NOT date_agrees) AS date_differs, count(*) FILTER (NOT subject_agrees) AS subject_differs FROM cases")
def a30_review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.review_totals(_cases(spark, sf_dir))


@query(r"""SELECT doc_id, 0 AS place, 'subject' AS name, lang || ' ' || source AS value FROM documents UNION ALL SELECT doc_id, 1, 'x-source', source || ' a b' FROM documents""")
def p18_relaxed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("Subject: "), "lang", F.lit("\r\n\t "), "source", F.lit("\r\nno field\r\nX-Source:  "), "source", F.lit("  a\t \tb \r\n\r\nBody: x"))
    rows = reconcile.relaxed_headers(d.select("doc_id", raw.alias("raw")), "raw")
    return rows.select("doc_id", F.posexplode("headers").alias("place", "h")).select("doc_id", "place", "h.name", "h.value")
