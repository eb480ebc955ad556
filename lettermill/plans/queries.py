"""The registered queries, each an operator over the driver's tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import text as X
from lettermill.operators import ingest, provenance, quality, reconcile, reports, search
from lettermill.plans import views as V
from lettermill.plans.views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
PADDED = "(' ' || array_to_string(" + TOKENS + ", ' ') || ' ')"


def query(sql: str | None = None):
    """Register a query under its function's name; sql sees the mail relations of views.SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {V.SQL.strip()},\nresult AS ({sql})\nSELECT * FROM result"
        return f

    return add


SEARCHABLE = "category IN ('Archive', 'Sent')"


@query(f"""
WITH m AS (SELECT pk, sender, category, year(date) AS year FROM messages WHERE {SEARCHABLE}),
p AS (SELECT year, sender AS address FROM m UNION SELECT m.year, r.address FROM m JOIN recipients r USING (pk))
SELECT s.year, s.sent, s.received, n.people FROM (SELECT year, count(*) FILTER (category = 'Sent') AS sent, count(*) FILTER (category <> 'Sent') AS received FROM m GROUP BY year) s
LEFT JOIN (SELECT year, count(*) AS people FROM p GROUP BY year) n USING (year)""")
def a01_yearly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.yearly(V.messages(spark, sf_dir), V.recipients(spark, sf_dir))


_TOP = """SELECT address, count(*) AS messages, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day FROM ({}) x
WHERE address NOT IN (SELECT sender FROM messages WHERE category = 'Sent') GROUP BY address ORDER BY messages DESC, address LIMIT 25"""
_WINDOW = f"{SEARCHABLE} AND date >= TIMESTAMP '1994-01-01' AND date < TIMESTAMP '1997-01-01'"


@query(_TOP.format(f"SELECT sender AS address, date FROM messages WHERE {_WINDOW}"))
def a02_top_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_senders(V.messages(spark, sf_dir), 1994, 1996, 25)


@query(_TOP.format(f"SELECT r.address, m.date FROM messages m JOIN recipients r USING (pk) WHERE {_WINDOW}"))
def a03_top_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_recipients(V.messages(spark, sf_dir), V.recipients(spark, sf_dir), 1994, 1996, 25)


_OWNERS = "SELECT DISTINCT sender AS address FROM messages WHERE category = 'Sent'"
_MEANINGFUL = f"""
SELECT r.address FROM recipients r JOIN messages m USING (pk) WHERE r.role IN ('to', 'bcc') AND {SEARCHABLE} AND m.sender IN (SELECT address FROM owner) AND r.address NOT IN (SELECT address FROM owner)
UNION SELECT m.sender FROM messages m JOIN recipients r USING (pk) WHERE r.role = 'to' AND {SEARCHABLE} AND r.address IN (SELECT address FROM owner) AND m.sender NOT IN (SELECT address FROM owner)"""


@query(f"WITH owner AS ({_OWNERS}) {_MEANINGFUL}")
def j10_meaningful_correspondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.messages(spark, sf_dir)
    return reports.meaningful(m, V.recipients(spark, sf_dir), reports.owners(m))


@query(f"""WITH owner AS ({_OWNERS}), meaningful AS ({_MEANINGFUL}),
seen AS (SELECT pk, strftime(date, '%Y-%m-%d') AS day, sender AS address FROM messages WHERE {SEARCHABLE} UNION SELECT m.pk, strftime(m.date, '%Y-%m-%d'), r.address FROM messages m JOIN recipients r USING (pk) WHERE {SEARCHABLE})
SELECT address, min(day) AS first_day, max(day) AS last_day, count(DISTINCT pk) AS messages FROM seen WHERE address IN (SELECT address FROM meaningful) GROUP BY address""")
def a04_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.messages(spark, sf_dir)
    return reports.contacts(m, V.recipients(spark, sf_dir), reports.owners(m))


def _classes_sql() -> str:
    """The address rules as SQL, from the same policy."""
    p = reports.Policy()
    hit = lambda x, patterns: " OR ".join(f"regexp_matches({x}, '{q.replace(chr(39), chr(39) * 2)}', 'i')" for q in patterns)
    return f"""WITH used AS (SELECT DISTINCT address FROM (SELECT sender AS address FROM messages UNION SELECT address FROM recipients UNION SELECT lower(source) || '-owner@lists.' || lang || '.org' FROM documents
  UNION SELECT CASE doc_id % 9 WHEN 0 THEN 'no-reply@' || source WHEN 1 THEN source WHEN 2 THEN 'a@b@' || source WHEN 3 THEN 'x@alerts.' || source || '.org' WHEN 4 THEN '@' || source WHEN 5 THEN source || '@' WHEN 6 THEN 'a@-' || source WHEN 7 THEN repeat(lang, 25) || '@x.org' ELSE 'info@' || lang || '.org' END FROM documents)),
parts AS (SELECT address, string_split(address, '@')[1] AS local, CASE WHEN contains(address, '@') THEN substr(address, instr(address, '@') + 1) ELSE '' END AS domain FROM used),
judged AS (SELECT address, CASE WHEN {hit("address", p.allowed)} THEN 'human allow-pattern' WHEN NOT contains(address, '@') OR contains(domain, '@') THEN 'bogus malformed-at-sign' WHEN {hit("local", p.bogus_locals)} THEN 'bogus invalid-local-part'
WHEN domain = '' OR {hit("domain", p.bogus_domains)} THEN 'bogus invalid-domain' WHEN {hit("domain", p.list_domains)} OR {hit("local", p.list_locals)} THEN 'mailing-list mailing-list-pattern'
WHEN {hit("domain", p.service_domains)} OR {hit("local", p.service_locals)} THEN 'service service-pattern' WHEN length(local) > {p.longest_local} THEN 'bogus long-local-part' ELSE 'human no-exclusion-rule' END AS c FROM parts)
SELECT address, string_split(c, ' ')[1] AS kind, string_split(c, ' ')[2] AS reason FROM judged"""


@query(_classes_sql())
def f23_address_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 9
    source, lang, at = F.col("source"), F.col("lang"), F.lit("@")
    odd = (
        F.when(k == 0, F.concat(F.lit("no-reply@"), source)).when(k == 1, source).when(k == 2, F.concat(F.lit("a@b@"), source)).when(k == 3, F.concat(F.lit("x@alerts."), source, F.lit(".org"))).when(k == 4, F.concat(at, source))
        .when(k == 5, F.concat(source, at)).when(k == 6, F.concat(F.lit("a@-"), source)).when(k == 7, F.concat(F.repeat(lang, 25), F.lit("@x.org"))).otherwise(F.concat(F.lit("info@"), lang, F.lit(".org")))
    )
    used = V.messages(spark, sf_dir).select(F.col("sender").alias("address")).union(V.recipients(spark, sf_dir).select("address"))
    used = used.union(d.select(F.concat(F.lower(source), F.lit("-owner@lists."), lang, F.lit(".org")))).union(d.select(odd)).distinct()
    return used.withColumn("c", reports.classify(F.col("address"))).select("address", "c.kind", "c.reason")


@query("SELECT DISTINCT sender FROM messages WHERE (sender LIKE 'c1%@example.org' OR sender LIKE 'c_@%') AND sender NOT LIKE '%0@example.org'")
def f24_owner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.messages(spark, sf_dir).select("sender").distinct()
    return m.filter(reports.owner_rule(F.col("sender"), ["c1*@example.org", "c?"], ["*0@example.org"]))


def _found(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return search.select(V.messages(spark, sf_dir), V.recipients(spark, sf_dir), search.parse(text), V.bodies(spark, sf_dir))


@query(f"SELECT pk FROM messages WHERE {SEARCHABLE} AND (contains(sender, 'c12') OR pk IN (SELECT pk FROM recipients WHERE contains(address, 'c12')))")
def f02_search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "any:c12").select("pk")


@query(f"""SELECT pk, sender FROM messages WHERE {SEARCHABLE} AND contains(sender, '7@') AND contains(lower(subject), 'urgent') AND pk IN (SELECT pk FROM recipients WHERE role = 'to' AND contains(address, 's1'))
AND pk NOT IN (SELECT pk FROM messages WHERE date < TIMESTAMP '1995-01-02') AND date < TIMESTAMP '1997-06-01'""")
def f03_search_roles_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "to:S1 from:7@ subject:Urgent after:1995-01-01 before:1997-06-01").select("pk", "sender")


@query(f"SELECT pk, date FROM messages WHERE {SEARCHABLE} AND date >= TIMESTAMP '1996-03-04' AND date < TIMESTAMP '1996-03-05'")
def f06_search_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "date:1996-03-04").select("pk", "date")


@query(f"SELECT pk FROM bodies WHERE contains({PADDED.format('body')}, ' the ') AND contains({PADDED.format('body')}, ' on the ')")
def f09_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(V.bodies(spark, sf_dir), ["the", "on the"])


@query("SELECT pk FROM bodies WHERE contains(" + PADDED.format("body") + ", ' on the ')")
def f09_phrase_by_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase_postings(search.postings(V.bodies(spark, sf_dir)), ["on", "the"])


@query(f"""SELECT pk FROM (SELECT pk FROM bodies WHERE contains({PADDED.format("body")}, ' the ') UNION SELECT pk FROM attachments WHERE contains({PADDED.format("content")}, ' the '))
WHERE pk IN (SELECT pk FROM bodies WHERE contains({PADDED.format("body")}, ' of ') UNION SELECT pk FROM attachments WHERE contains({PADDED.format("content")}, ' of '))""")
def f10_phrases_with_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(V.bodies(spark, sf_dir), ["the", "of"], V.attachments(spark, sf_dir))


@query(f"SELECT pk, subject, date FROM messages WHERE {SEARCHABLE} AND contains(lower(subject), 'high') ORDER BY lower(subject) DESC, pk DESC LIMIT 50 OFFSET 20")
def t01_page_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(_found(spark, sf_dir, "subject:high"), "subject", True, 50, 20).select("pk", "subject", "date")


@query(f"SELECT pk, sender FROM (SELECT * FROM messages WHERE {SEARCHABLE} ORDER BY date DESC, pk DESC LIMIT 80) ORDER BY lower(sender), pk")
def t03_newest_by_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.newest_then(reports.searchable(V.messages(spark, sf_dir)), "sender", False, 80).select("pk", "sender")


@query(f"""SELECT p.pk, p.date, coalesce((SELECT string_agg(DISTINCT r.address, ',' ORDER BY r.address) FROM recipients r WHERE r.pk = p.pk), '') AS recipients
FROM (SELECT * FROM messages WHERE {SEARCHABLE} ORDER BY date DESC, pk DESC LIMIT 100) p""")
def a05_page_with_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = search.page(reports.searchable(V.messages(spark, sf_dir)), "date", True, 100)
    return search.with_recipients(chosen, V.recipients(spark, sf_dir)).select("pk", "date", "recipients")


@query(f"SELECT least(count(*), 100000) AS n, CASE WHEN count(*) <= 100000 THEN count(*) END AS exact FROM messages WHERE {SEARCHABLE} AND contains(lower(subject), 'low')")
def a06_capped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.capped_count(_found(spark, sf_dir, "subject:low"), 100_000)


@query(f"SELECT subject, count(*) AS messages, max(date) AS last_seen FROM messages WHERE {SEARCHABLE} AND contains(lower(subject), 'urg') GROUP BY subject ORDER BY messages DESC, last_seen DESC, lower(subject) LIMIT 20")
def a15_subject_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.subject_suggestions(V.messages(spark, sf_dir), "URG", 20)


_SUGGESTIONS = f"""SELECT s.address, coalesce(n.display_name, '') AS display_name, s.messages, s.last_seen FROM (
  SELECT address, count(*) AS messages, max(date) AS last_seen FROM (
    SELECT pk, date, sender AS address FROM messages WHERE {SEARCHABLE} UNION SELECT m.pk, m.date, r.address FROM messages m JOIN recipients r USING (pk) WHERE {SEARCHABLE}) GROUP BY address) s
LEFT JOIN (SELECT 's' || s_suppkey || '@example.net' AS address, s_name AS display_name FROM supplier) n USING (address)"""


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@example.net")).alias("address"), F.col("s_name").alias("display_name"))
    return search.address_suggestions(V.messages(spark, sf_dir), V.recipients(spark, sf_dir), names)


@query(_SUGGESTIONS)
def a16_address_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggestions(spark, sf_dir)


@query(f"SELECT * FROM ({_SUGGESTIONS}) WHERE contains(lower(address), 'net') OR contains(lower(display_name), 'net') ORDER BY messages DESC, last_seen DESC, lower(address) LIMIT 15")
def t07_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggest(_suggestions(spark, sf_dir), "net", 15)


@query(r"""SELECT pk, array_to_string(list_slice(regexp_extract_all(body, '\S+'), 1, 18), ' ') || CASE WHEN len(regexp_extract_all(body, '\S+')) > 18 THEN '…' ELSE '' END AS preview FROM bodies""")
def i08_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bodies(spark, sf_dir).select("pk", X.preview(F.col("body")).alias("preview"))


@query("SELECT DISTINCT pk FROM paths WHERE (volume LIKE '%example.com' AND (path = '/de' OR starts_with(path, '/de/'))) OR (path = '/en' OR starts_with(path, '/en/'))")
def f11_mailbox_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = V.paths(spark, sf_dir)
    volumes = paths.filter(F.col("volume").endswith("example.com")).select("volume", F.lit("/de").alias("path")).distinct()
    return provenance.in_selected(paths, volumes.unionByName(spark.createDataFrame([(None, "/en")], volumes.schema)))


@query("""WITH e AS (SELECT pk, volume, list_filter(string_split(path, '/'), lambda p: p <> '') AS names FROM paths),
x AS (SELECT pk, volume, unnest(list_transform(range(0, len(names) + 1), lambda i: array_to_string(list_slice(names, 1, i), '/'))) AS path FROM e)
SELECT volume, path, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth, count(DISTINCT pk) AS messages FROM x GROUP BY volume, path""")
def a08_mailbox_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.tree(V.paths(spark, sf_dir))


@query("""SELECT pk, CAST(row_number() OVER (PARTITION BY pk ORDER BY volume = 'en' DESC, volume, path) AS INTEGER) AS place, volume, path FROM (
SELECT DISTINCT md5(lower(body)) AS pk, volume, mailbox AS path FROM bodies)""")
def t10_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bodies(spark, sf_dir).select(F.md5(F.lower("body")).alias("pk"), "volume", F.col("mailbox").alias("path"))
    return provenance.locations(b, "en")


@query("SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P')")
def f19_files_with_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("pk"))
    return provenance.with_observations(table(spark, sf_dir, "customer").select("c_custkey"), seen, "c_custkey")


@query("""SELECT user_id, control, completed_at, action FROM (SELECT user_id, event_id % 3 AS control, ts AS completed_at, event_type AS action, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_type DESC) AS n
FROM events WHERE event_type <> 'error') WHERE n = 1""")
def f16_latest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("control"), F.when(F.col("event_type") != "error", F.col("ts")).alias("completed_at"), F.col("event_type").alias("action"))
    return provenance.latest_check(checks, "user_id", "control")


@query("""WITH r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY container ORDER BY position) = 1 AND own_date IS NULL THEN make_timestamp(path_year, 1, 1, 0, 0, 0) END AS year_date FROM stream)
SELECT container, position, coalesce(own_date, year_date, last_value(coalesce(own_date, year_date) IGNORE NULLS) OVER (PARTITION BY container ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS date,
CASE WHEN own_date IS NOT NULL THEN 'date' WHEN year_date IS NOT NULL THEN 'path-year' ELSE 'previous-message' END AS date_source FROM r""")
def w01_inherited_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.inherit_dates(V.stream(spark, sf_dir))


@query("""SELECT u.container, u.position, (SELECT arg_max(p.own_date, p.position) FROM stream p WHERE p.container = u.container AND p.position < u.position AND p.own_date IS NOT NULL) AS previous,
(SELECT arg_min(n.own_date, n.position) FROM stream n WHERE n.container = u.container AND n.position > u.position AND n.own_date IS NOT NULL) AS following FROM stream u WHERE u.own_date IS NULL""")
def w02_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.neighbours(V.stream(spark, sf_dir))


@query("SELECT pk, sha256, CASE WHEN row_number() OVER w = 1 THEN 'archived' ELSE 'duplicate' END AS disposition, min(pk) OVER (PARTITION BY sha256) AS winner FROM (SELECT pk, sha256(body) AS sha256 FROM bodies) WINDOW w AS (PARTITION BY sha256 ORDER BY pk)")
def w03_first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_occurrences(V.bodies(spark, sf_dir).select("pk", F.sha2("body", 256).alias("sha256")), ["sha256"], ["pk"])


@query("SELECT pk, mailbox, CAST(row_number() OVER (PARTITION BY mailbox, volume ORDER BY pk) AS INTEGER) AS turn FROM bodies")
def w00_fair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.fair_order(V.bodies(spark, sf_dir), "mailbox", "volume", order="pk").select("pk", "mailbox", "turn")


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn) AS INTEGER) AS occurrence FROM conversations")
def w05_occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("name", F.lower("role"))
    return ingest.fair_order(c.withColumn("at", F.col("turn")).drop("turn"), "conv_id", "name", order="at").select("conv_id", F.col("at").alias("turn"), "role", F.col("turn").alias("occurrence"))


@query("SELECT mailbox, n FROM (SELECT lower(mailbox) AS mailbox, count(*) AS n FROM bodies GROUP BY lower(mailbox)) WHERE n > 1")
def w07_duplicate_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bodies(spark, sf_dir).groupBy(F.lower("mailbox").alias("mailbox")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""WITH f AS (SELECT doc_id, octet_length(encode(text)) AS length, sha256(text) AS sha FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 4 = 0 THEN 'read' WHEN doc_id % 4 = 1 THEN 'skip' WHEN doc_id % 4 = 2 AND length > 64 THEN 'resume' WHEN doc_id % 4 = 2 THEN 'skip' ELSE 'read' END AS decision FROM f""")
def f28_read_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.encode("text", "UTF-8")
    n = F.when(F.col("doc_id") % 4 == 2, F.least(F.length(b), F.lit(64))).otherwise(F.length(b))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("kind"), F.length(b).alias("length"), F.sha2(b, 256).alias("sha256"), F.sha2(F.substring(b, F.lit(1), n), 256).alias("prefix_sha256"), "doc_id", n.alias("was"))
    known = docs.filter("doc_id % 4 > 0").select("path", "kind", F.col("was").alias("length"), F.when(F.col("doc_id") % 4 == 3, F.lit("other")).otherwise(F.col("prefix_sha256")).alias("sha256"))
    return ingest.decide(docs, known)


@query("SELECT container, position, own_date FROM (SELECT *, row_number() OVER (PARTITION BY container ORDER BY position DESC) AS n FROM stream JOIN (SELECT container, CAST(floor(max(position) * 0.4) AS BIGINT) AS edge FROM stream GROUP BY container) USING (container) WHERE position < edge) WHERE n = 1")
def f15_resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.stream(spark, sf_dir)
    return ingest.resume_after(s, s.groupBy("container").agg(F.floor(F.max("position") * 0.4).alias("cursor")))


@query("""WITH c AS (SELECT container, CAST(floor(max(position) * 0.4) AS BIGINT) AS edge FROM stream GROUP BY container),
h AS (SELECT container, arg_max(own_date, position) AS last FROM stream JOIN c USING (container) WHERE position < edge AND own_date IS NOT NULL GROUP BY container),
f AS (SELECT container, position, own_date, path_year, row_number() OVER (PARTITION BY container ORDER BY position) AS n FROM stream JOIN c USING (container) WHERE position >= edge),
y AS (SELECT f.*, last, CASE WHEN n = 1 AND own_date IS NULL AND last IS NULL THEN make_timestamp(path_year, 1, 1, 0, 0, 0) END AS year_date FROM f LEFT JOIN h USING (container))
SELECT container, position, coalesce(own_date, year_date, last_value(coalesce(own_date, year_date) IGNORE NULLS) OVER (PARTITION BY container ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), last) AS date,
CASE WHEN own_date IS NOT NULL THEN 'date' WHEN year_date IS NOT NULL THEN 'path-year' ELSE 'previous-message' END AS date_source FROM y""")
def r01_resumed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.stream(spark, sf_dir)
    cursors = s.groupBy("container").agg(F.floor(F.max("position") * 0.4).alias("cursor"))
    fresh = s.join(cursors, "container").filter("position >= cursor").drop("cursor")
    return ingest.inherit_dates(fresh, ingest.resume_after(s.filter("own_date IS NOT NULL"), cursors))


@query("""WITH a AS (SELECT doc_id, lang FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, lang, 'only first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT doc_id, lang, 'only second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def f14_snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ingest.changed(d.filter("doc_id % 7 <> 0"), d.filter("doc_id % 5 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang"))))


@query("SELECT source, CAST(count(DISTINCT lang) AS VARCHAR) AS payload FROM documents GROUP BY source")
def s35_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").cast("string").alias("payload"))
    return ingest.register(kinds.union(kinds), ["source"], "payload")


@query("SELECT year(o_orderdate) AS year, o_orderstatus AS disposition, count(*) AS messages, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, CAST(sum(o_custkey) AS BIGINT) AS bytes FROM orders GROUP BY 1, 2")
def a23_ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counters(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("disposition"), F.col("o_custkey").alias("bytes")))


@query("""SELECT least(99.9, round(100 * a / b, 6)) AS percent, round(t * (b - a) / a, 6) AS eta_seconds FROM (SELECT CAST(sum(n_chars) FILTER (doc_id % 2 = 0) AS DOUBLE) AS a, CAST(sum(n_chars) AS DOUBLE) AS b, 60.0::DOUBLE AS t FROM documents)""")
def a24_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0
    return ingest.progress(d.select(F.when(even, F.col("n_chars")).otherwise(0).alias("bytes_done"), F.col("n_chars").alias("bytes_total"), even.alias("done"), F.lit(60.0).alias("seconds")))


_CACHE = """cache AS (SELECT doc_id AS cache_pk, source AS service, sha256(text) AS raw, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS semantic FROM documents WHERE doc_id % 3 = 0),
archive AS (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS pk, sha256(text) AS raw, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS semantic FROM documents WHERE doc_id % 3 > 0
  UNION ALL SELECT doc_id + 1000000000, sha256(text || '!'), sha256(regexp_replace(lower(text || '!'), '[^\\p{L}\\p{N}]+', ' ', 'g')) FROM documents WHERE doc_id % 6 < 2)"""
_OUTCOME = """SELECT c.*, CASE WHEN raw IN (SELECT raw FROM archive WHERE pk IS NOT NULL) THEN 'exact' WHEN semantic IN (SELECT semantic FROM archive WHERE pk IS NOT NULL) THEN 'semantic' ELSE 'cache-only' END AS outcome FROM cache c"""


def _stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hashes = lambda t: (F.sha2(t, 256).alias("raw"), F.sha2(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "), 256).alias("semantic"))
    raw, semantic = hashes(F.col("text"))
    d = table(spark, sf_dir, "documents")
    edited = d.filter("doc_id % 6 < 2").select((F.col("doc_id") + 1_000_000_000).alias("pk"), *hashes(F.concat("text", F.lit("!"))))
    cache = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("cache_pk"), F.col("source").alias("service"), raw, semantic)
    return cache, d.filter("doc_id % 3 > 0").select(F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("pk"), raw, semantic).unionByName(edited)


@query(f"WITH {_CACHE} {_OUTCOME}")
def f13_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.match(*_stores(spark, sf_dir))


@query(f"WITH {_CACHE} SELECT count(DISTINCT pk) AS messages FROM archive WHERE pk IS NOT NULL AND semantic IN (SELECT semantic FROM cache)")
def a10_represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.represented(*_stores(spark, sf_dir))


_AMBIGUOUS = "SELECT semantic, count(DISTINCT pk) AS messages, count(DISTINCT raw) AS raws FROM archive WHERE pk IS NOT NULL GROUP BY semantic HAVING count(DISTINCT raw) > 1"


@query(f"WITH {_CACHE} {_AMBIGUOUS}")
def a11_ambiguous_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.ambiguous(_stores(spark, sf_dir)[1])


@query(f"WITH {_CACHE} SELECT semantic, c.cached, a.messages FROM ({_AMBIGUOUS}) a JOIN (SELECT semantic, count(*) AS cached FROM cache GROUP BY semantic) c USING (semantic) ORDER BY messages DESC, cached DESC, semantic LIMIT 20")
def a12_ambiguous_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.ambiguous_ranking(*_stores(spark, sf_dir), 20)


@query(f"""WITH {_CACHE}, o AS ({_OUTCOME}) SELECT service, count(*) AS records, count(*) FILTER (outcome = 'exact') AS exact, count(*) FILTER (outcome = 'semantic') AS semantic, count(*) FILTER (outcome = 'cache-only') AS cache_only,
count(DISTINCT raw) AS distinct_raw, count(DISTINCT o.semantic) AS distinct_semantic, count(*) FILTER (o.semantic IN (SELECT semantic FROM ({_AMBIGUOUS}))) AS ambiguous FROM o GROUP BY service""")
def a13_service_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.service_rollup(*_stores(spark, sf_dir))


_SIDES = f"""l AS (SELECT pk AS pair, unnest({TOKENS.format("body")}) AS item FROM bodies), r AS (SELECT pk AS pair, unnest({TOKENS.format("content")}) AS item FROM attachments),
d AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.item, b.item) AS item, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS only_left, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS only_right
  FROM (SELECT pair, item, count(*) AS n FROM l GROUP BY 1, 2) a FULL JOIN (SELECT pair, item, count(*) AS n FROM r GROUP BY 1, 2) b ON a.pair = b.pair AND a.item = b.item)"""


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = V.bodies(spark, sf_dir).select(F.col("pk").alias("pair"), F.explode(X.tokens(F.col("body"))).alias("item"))
    right = V.attachments(spark, sf_dir).select(F.col("pk").alias("pair"), F.explode(X.tokens(F.col("content"))).alias("item"))
    return reconcile.multiset_delta(left, right, "pair", "item")


@query(f"WITH {_SIDES} SELECT * FROM d WHERE only_left + only_right > 0")
def u08_multiset_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)


@query(f"WITH {_SIDES} SELECT item, CAST(sum(only_left + only_right) AS BIGINT) AS occurrences, count(DISTINCT pair) AS pairs FROM d WHERE only_left + only_right > 0 GROUP BY item")
def a14_delta_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.delta_ranking(_delta(spark, sf_dir), "pair", "item")


@query("SELECT l_partkey, arg_min(l_suppkey, l_suppkey) AS l_suppkey, score FROM (SELECT l_partkey, l_suppkey, l_quantity AS score, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity) AS n FROM lineitem) WHERE n = 1 GROUP BY l_partkey, score")
def a20_best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.best_candidates(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("score")), "l_partkey", "l_suppkey", "score")


@query("SELECT key, side FROM (SELECT doc_id AS key, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT conv_id, 'right' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE FALSE)")
def j27_payload_against_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").alias("key")
    return reconcile.both_ways(table(spark, sf_dir, "documents").select(key), table(spark, sf_dir, "labels").select(key), "key")


@query("SELECT conv_id AS file, turn AS ordinal, CASE WHEN turn % 4 = 3 THEN 'missing' WHEN turn % 4 = 2 THEN 'different' END AS fault FROM conversations WHERE turn % 4 >= 2 AND (turn % 4 = 3 OR md5(text) <> md5(text || 'x'))")
def j28_manifest_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("ordinal"), "text")
    found = c.filter("ordinal % 4 <> 3").select("file", "ordinal", F.md5(F.when(F.col("ordinal") % 4 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("digest"))
    return reconcile.by_ordinal(c.select("file", "ordinal", F.md5("text").alias("digest")), found, "file", "ordinal", "digest")


@query("SELECT pk, date FROM messages WHERE date < TIMESTAMP '1995-06-01' AND category IN ('Archive', 'Sent')")
def f20_early_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.early_dates(V.messages(spark, sf_dir), "1995-06-01").select("pk", "date")


@query("SELECT pk, sender FROM messages ORDER BY md5(pk || ':20260827'), pk LIMIT 100")
def t11_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.seeded_sample(V.messages(spark, sf_dir), "pk", 20260827, 100).select("pk", "sender")


@query("""WITH d AS (SELECT o_orderkey, list_sort(list(epoch_us(l_shipdate))) AS hops FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey),
k AS (SELECT o_orderkey, CASE WHEN len(hops) >= 3 THEN hops[2:len(hops) - 1] ELSE hops END AS kept FROM d)
SELECT o_orderkey, (kept[(len(kept) + 1) // 2]::DOUBLE + kept[len(kept) // 2 + 1]::DOUBLE) / 2 AS received FROM k""")
def a18_trimmed_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("hops"))  # an order has at most seven lines
    return hops.select("o_orderkey", quality.trimmed_median(F.col("hops")).alias("received"))


@query(f"""WITH l AS (SELECT pk, token, count(*) AS n FROM (SELECT pk, unnest({TOKENS.format("body")}) AS token FROM bodies) GROUP BY 1, 2), r AS (SELECT pk, token, count(*) AS n FROM (SELECT pk, unnest({TOKENS.format("content")}) AS token FROM attachments) GROUP BY 1, 2),
j AS (SELECT coalesce(l.pk, r.pk) AS pk, coalesce(l.n, 0) AS x, coalesce(r.n, 0) AS y FROM l FULL JOIN r ON l.pk = r.pk AND l.token = r.token)
SELECT k.pk, round(coalesce(s.v, 1.0), 9) AS similarity FROM (SELECT DISTINCT pk FROM bodies WHERE pk IN (SELECT pk FROM attachments)) k LEFT JOIN (SELECT pk, sum(least(x, y))::DOUBLE / sum(greatest(x, y))::DOUBLE AS v FROM j GROUP BY pk) s USING (pk)""")
def a21_weighted_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.weighted_jaccard(V.bodies(spark, sf_dir).select("pk", F.col("body").alias("t")), V.attachments(spark, sf_dir).select("pk", F.col("content").alias("t")), "pk", "t")


_RESULTS = "SELECT source AS engine, doc_id AS document, CASE WHEN n_chars < 300 THEN 'short' ELSE 'ok' END AS status, n_chars AS chars FROM documents"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("engine"), F.col("doc_id").alias("document"), F.when(F.col("n_chars") < 300, "short").otherwise("ok").alias("status"), F.col("n_chars").alias("chars"))


@query(f"""SELECT engine, count(*) AS documents, count(*) FILTER (status <> 'ok') AS errors, CAST(sum(chars) AS BIGINT) AS chars, median(chars) AS median_chars,
list_sort(list(chars))[CAST(round_even((count(*) - 1) * 0.1::DOUBLE, 0) AS BIGINT) + 1] AS p10, list_sort(list(chars))[CAST(round_even((count(*) - 1) * 0.95::DOUBLE, 0) AS BIGINT) + 1] AS p95 FROM ({_RESULTS}) GROUP BY engine""")
def a22_engine_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.engine_rollup(_results(spark, sf_dir))


@query(f"SELECT engine, document, chars, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY chars % 100 DESC, chars DESC, document) AS rank FROM ({_RESULTS})) WHERE rank <= 5")
def w06_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir).withColumn("rate", F.col("chars") % 100)
    return quality.outliers(r, "engine", "rate", "chars", "document", 5).select("engine", "document", "chars", "rank")


@query("""WITH e AS (SELECT conv_id, role, sum(length(text)) AS v FROM conversations GROUP BY conv_id, role)
SELECT a.role AS a, b.role AS b, count(*) AS documents, round(avg(CASE WHEN greatest(a.v, b.v) = 0 THEN 1.0 ELSE least(a.v, b.v)::DOUBLE / greatest(a.v, b.v)::DOUBLE END), 9) AS mean_ratio FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.role < b.role GROUP BY 1, 2""")
def j25_engine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("v"))
    return quality.engine_pairs(e, "conv_id", "role", "v")


@query("SELECT sha256(text) AS sha256, count(*) AS instances, min(doc_id) AS first FROM documents GROUP BY 1")
def a25_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.payloads(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT year(date) AS year, category, count(*) AS n FROM messages GROUP BY 1, 2")
def a26_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.messages(spark, sf_dir).groupBy(F.year("date").alias("year"), "category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS cases, count(*) FILTER (c_mktsegment <> 'BUILDING') AS covered, count(*) FILTER (c_mktsegment = 'MACHINERY') AS exact, count(DISTINCT c_nationkey) AS groups FROM customer")
def a27_name_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return quality.name_benchmark(table(spark, sf_dir, "customer").select(F.array(F.lit(""), name).alias("observed"), F.lit("MACHINERY").alias("expected"), F.col("c_nationkey").alias("grp")))


@query(r"""SELECT url, CASE WHEN n = '' THEN 'message' ELSE substr(n, 1, 100) END AS name FROM (SELECT url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS n FROM pages)""")
def i12_safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", X.safe_filename(F.col("url")).alias("name"))


@query("SELECT page_id, replace(replace(replace(html, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS escaped, html AS back FROM pages")
def i13_escaped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.escape_path(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", e.alias("escaped"), X.unescape_path(e).alias("back"))


@query("""SELECT doc_id, CASE WHEN v < 1024 THEN v || ' B' WHEN v < 1048576 THEN printf('%.1f KiB', v / 1024.0) WHEN v < 1073741824 THEN printf('%.1f MiB', v / 1048576.0) ELSE printf('%.1f GiB', v / 1073741824.0) END AS shown
FROM (SELECT doc_id, n_chars * n_chars + 7 AS v FROM documents)""")
def i16_byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.byte_size(F.col("n_chars") * F.col("n_chars") + 7).alias("shown"))


@query("SELECT doc_id, rtrim(translate(base64(encode(source || '/' || lang || '?' || doc_id)), '+/', '-_'), '=') AS token FROM documents")
def i32_selection_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.token_of(F.concat("source", F.lit("/"), "lang", F.lit("?"), F.col("doc_id").cast("string"))).alias("token"))


@query("SELECT doc_id, sha256(source || chr(0) || lang) AS work_id, sha256(text) AS raw, sha256(substr(text, 1, 64)) AS prefix FROM documents")
def i33_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.identity(F.col("source"), F.col("lang")).alias("work_id"), F.sha2("text", 256).alias("raw"), F.sha2(F.substring("text", 1, 64), 256).alias("prefix"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def i36_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(r"""SELECT doc_id, sha256(replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r|\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n+\z', ''), chr(10), chr(13) || chr(10)) || chr(13) || chr(10)) AS semantic FROM documents""")
def i30_canonical_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.canonical_body(F.col("text")), 256).alias("semantic"))


@query("SELECT lang, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def s16_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("""SELECT doc_id, printf('%05d', doc_id) || ':' || sha256(doc_id || ':' || source) AS id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 400 AS BIGINT) AS file FROM documents""")
def k05_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.sources.sinks import split_rows

    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.concat(F.format_string("%05d", F.col("doc_id")), F.lit(":"), F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "source"), 256)).alias("id"))
    return split_rows(rows, "doc_id", 400)


@query("SELECT sha256(text) || '  data/' || replace(source, '%', '%25') || '/' || doc_id || '.txt' AS line FROM documents")
def k06_manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.sources.sinks import manifest_lines

    d = table(spark, sf_dir, "documents")
    return manifest_lines(d.select(F.concat(F.lit("data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")))
