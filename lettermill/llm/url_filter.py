"""URL filters by a sort-merge range join, in DataFrame and SQL functions only.

A canonical key is the host with its labels reversed, `#`, and the path (neither part can hold a `#`). A rule is then
the interval of keys that begin with its own; rules nest or are disjoint. A url asks with the key of its host and of
each parent domain. Keys and the starts and ends of intervals are sorted together and swept: the depth is a running
sum, and the innermost rule at depth d is the last one that opened at depth d, which is a stack held in a window.

Distinct keys, starts and ends are dealt together into sorted ranges, so that neither one host nor one rule fills a task,
and nothing is broadcast. A range begins with the rules that are open there: those whose keys are beginnings of its first
key, found by an equal join of these beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import cut, parts

END = b"\xff"  # in no UTF-8 text, so above every key of an interval


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty if it is null or has no `://`."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _reversed(host: str) -> Column:
    return F.reverse(F.split(host, r"\."))


def _swept(keys: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """(key, inner): for each distinct key that lies in an interval the innermost rule (struct). rules: (key, rule)."""
    kind = rules.schema["rule"].dataType
    event = lambda df, key, turn, step, rule: df.select(key.alias("key"), F.lit(turn).alias("turn"), F.lit(step).alias("step"), rule.cast(kind).alias("rule"))
    key, none = F.col("key"), F.lit(None)
    events = event(keys, key, 1, 0, none).unionByName(event(rules, key, 0, 1, F.col("rule"))).unionByName(event(rules, F.concat("key", F.lit(END)), 2, -1, none))
    dealt = cut(events.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()))
    firsts = dealt.groupBy("range").agg(F.min("key").alias("first"))  # a row for each range
    # only the beginnings that are as long as some rule: their bytes grow with the rules, not with the square of a url's length
    lengths = sorted(r[0] for r in rules.select(F.octet_length("key")).distinct().collect())
    begins = firsts.select("range", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n"), "first").filter("n < octet_length(first)")
    begins = begins.select("range", F.expr("substring(first, 1, n)").alias("key"))
    open_ = begins.join(rules, "key").select("key", F.lit(0).alias("turn"), F.lit(1).alias("step"), "rule", "range")
    past = lambda *by: Window.partitionBy(*by).orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.unionByName(open_).withColumn("depth", F.sum("step").over(past("range")))
    swept = swept.withColumn("inner", F.last("rule", ignorenulls=True).over(past("range", "depth")))
    return swept.filter("turn = 1 AND depth > 0").select("key", "inner")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url).

    rules: (host, path, verdict); rows with a null host or path are none. A rule fits its host and all subdomains where the path
    starts with the rule's; of those that fit, the longest (host and path together; then the longer host) gives rule and verdict;
    two rules of one host and path: block. None fits: rule null, verdict `default`. Null url or one without `://`: host and path
    empty, which no rule fits. Repeated rows give repeated results, a null page_id stays null, other columns are not looked at, an
    empty table gives no rows. Urls of any length are read whole. ranges: sorted ranges of keys, else as many as shuffle partitions.
    """
    spark = pages.sparkSession
    host, path = host_and_path("url")
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    parents = F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.array_join(F.slice("l", F.lit(1), i), "."))
    asked = cut(seen.filter("host <> ''").select("host", "path").distinct())
    asked = asked.withColumn("l", _reversed("host")).select("host", "path", F.explode(parents).alias("up"))
    asked = asked.select("host", "path", F.concat("up", F.lit("#"), "path").cast("binary").alias("key"))

    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.concat(F.array_join(_reversed("host"), "."), F.lit("#"), "path").cast("binary").alias("key"), F.struct("host", "path", "verdict").alias("rule"))
    # written, so that both sides of the two joins are plain exchanges, and a key or url that very many rows share can be split;
    # merged in any case, as a written table's size tells little of what a broadcast of it would take
    inner = cut(_swept(asked.select("key").distinct(), rules, ranges or parts(spark)))
    size = F.length("inner.host") + F.length("inner.path")
    best = asked.join(inner.hint("merge"), "key").groupBy("host", "path").agg(F.max(F.struct(size.alias("n"), F.length("inner.host").alias("h"), F.col("inner"))).alias("best"))
    best = cut(best.select("host", "path", F.concat("best.inner.host", "best.inner.path").alias("rule"), F.col("best.inner.verdict").alias("found")))
    judged = seen.filter("host <> ''").join(best.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
    rest = seen.filter("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(rest)


#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def oracle_sql() -> str:
    longest = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value((h, p, v))}'" for h, p, v in longest)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, {case(lambda r: r[0] + r[1])} ELSE NULL END AS rule, {case(lambda r: r[2])} ELSE 'allow' END AS verdict FROM parsed
"""
