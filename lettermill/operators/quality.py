"""Data quality and text metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.text import tokens


def early_dates(messages: DataFrame, before: str = "1984-01-01") -> DataFrame:
    return messages.filter((F.col("date") < F.lit(before).cast("timestamp_ntz")) & F.col("category").isin("Archive", "Sent"))


def missing_senders(messages: DataFrame) -> DataFrame:
    return messages.filter("sender = ''")


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in the order of a hash of key and seed: the same sample wherever it is drawn."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def trimmed_median(micros: Column) -> Column:
    """Median of an array of integers less one smallest and one largest if there are three or more; null if empty. Halves are kept as doubles."""
    ordered = F.array_sort(F.filter(micros, lambda x: x.isNotNull()))
    kept = F.when(F.size(ordered) >= 3, F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 2, F.lit(0)))).otherwise(ordered)
    n = F.size(kept)
    at = lambda i: F.try_element_at(kept, i).cast("double")
    return (at(F.greatest(F.floor((n + 1) / 2).cast("int"), F.lit(1))) + at(F.floor(n / 2).cast("int") + 1)) / 2


def token_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def weighted_jaccard(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """(key, similarity): sum of the smaller over sum of the larger token counts of the texts of a key on either side; 1 if both have none."""
    # only keys of both sides are read
    common = left.select(key).distinct().join(right.select(key).distinct(), key)
    only = lambda df: df.select(key, text).join(common, key, "left_semi")
    a, b = token_counts(only(left), key, text).withColumnRenamed("n", "l"), token_counts(only(right), key, text).withColumnRenamed("n", "r")
    both = a.join(b, [key, "token"], "full_outer").fillna(0, ["l", "r"])
    found = both.groupBy(key).agg(F.sum(F.least("l", "r")).alias("x"), F.sum(F.greatest("l", "r")).alias("y"))
    return common.join(found, key, "left").select(key, F.round(F.coalesce(F.col("x") / F.col("y"), F.lit(1.0)), 9).alias("similarity"))


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): the value at the half-even rounded index share * (n - 1) of a group's sorted values.

    Values are summed up to (group, value, count) first, so that a window holds a group's distinct values and no group's rows.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy(value))
    placed = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(Window.partitionBy(group)))
    at = lambda share: F.bround((F.col("_all") - 1) * F.lit(share), 0)
    return placed.groupBy(group).agg(*[F.min(F.when(F.col("_upto") > at(share), F.col(value))).alias(name) for name, share in shares.items()])


def engine_rollup(results: DataFrame) -> DataFrame:
    """(engine, documents, errors, chars, median_chars, p10, p95) of results (engine, status, chars)."""
    found = results.groupBy("engine").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") != "ok").alias("errors"), F.sum("chars").cast("long").alias("chars"), F.median("chars").alias("median_chars"))
    return found.join(nearest_ranks(results, "engine", "chars", {"p10": 0.1, "p95": 0.95}), "engine", "left")


def outliers(results: DataFrame, group: str, rate: str, size: str, key: str, n: int = 100) -> DataFrame:
    """The n rows of each group with the highest rate, then size, then smallest key, with `rank`."""
    w = Window.partitionBy(group).orderBy(F.desc(rate), F.desc(size), key)
    return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def engine_pairs(results: DataFrame, document: str, engine: str, value: str) -> DataFrame:
    """(a, b, documents, mean_ratio): for each two engines the mean ratio of the smaller to the larger value over their common documents."""
    a = results.select(document, F.col(engine).alias("a"), F.col(value).alias("x"))
    b = results.select(document, F.col(engine).alias("b"), F.col(value).alias("y"))
    ratio = F.when(F.greatest("x", "y") == 0, F.lit(1.0)).otherwise(F.least("x", "y") / F.greatest("x", "y"))
    both = a.join(b, document).filter("a < b")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg(ratio), 9).alias("mean_ratio"))


def payloads(attachments: DataFrame, content: str, key: str) -> DataFrame:
    """(sha256, instances, first): unique payloads, how often and where first."""
    return attachments.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("instances"), F.min(key).alias("first"))


def is_pdf(mime: Column, filename: Column, head: Column) -> Column:
    """By type or name, and with the mark in the first 1024 bytes."""
    named = (F.lower(mime) == "application/pdf") | F.lower(filename).endswith(".pdf")
    return named & (F.locate("%PDF-", F.substring(head, 1, 1024)) > 0)


def name_benchmark(cases: DataFrame) -> DataFrame:
    """(cases, covered, exact, groups) of cases (observed array<string>, expected, grp): covered if any name is non-empty, exact if the first such equals the expected."""
    first = F.try_element_at(F.filter("observed", lambda x: x != ""), F.lit(1))
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if(first.isNotNull()).alias("covered"), F.count_if(F.coalesce(first == F.col("expected"), F.lit(False))).alias("exact"), F.count_distinct("grp").alias("groups"))


# What wrongly decoded text looks like, and the field names that are counted.
MOJIBAKE = ("Ã", "Â", "â€", "ðŸ")
MAIL_FIELDS = "from|to|cc|bcc|subject|date|sent"
_WS = r"\t-\r\x1C- \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: All but white space; the class within the class is asked only of what no comparison with printable ASCII settles.
_INK = f"[!-~[^{_WS}]]"


def text_metrics(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with the counts that tell how well a text was read, and the weighted artifacts for each million characters. Null text: null counts."""
    t = F.col(text)
    n = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    times = lambda s: F.floor((F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s))
    strip = lambda x: F.regexp_replace(x, f"^[{_WS}]+|[{_WS}]+$", "")
    lines = F.split(t, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    # only a word's start is tried, and only in texts that have so many characters without the blanks that `\s` knows
    long_words = F.when(t.rlike(r"(?<!\S)\S{81}"), n(f"(?<!{_INK}){_INK}{{81,}}")).otherwise(0)
    heavy = lambda x: (F.length(strip(x)) >= 8) & (F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")) < 0.2 * F.length(strip(x)))
    counts = {
        "byte_count": F.octet_length(t).cast("long"),
        "character_count": F.length(t).cast("long"),
        "line_count": (F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)).cast("long"),
        "word_count": n(f"{_INK}++"),
        "page_break_count": n(r"\f"),
        "email_address_count": n(r"(?iU)\b[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[a-z]{2,}\b"),
        "mail_header_count": n(f"(?imd)^[{_WS}]*(?:{MAIL_FIELDS}):[{_WS}]*[^{_WS}]"),
        "replacement_count": n("\ufffd"),
        "mojibake_count": sum((times(s) for s in MOJIBAKE[1:]), times(MOJIBAKE[0])).cast("long"),
        "control_count": n(r"[\x00-\x08\x0B\x0E-\x1F]"),
        "repeated_glyph_runs": n(f"([^{_WS}])\\1{{5,}}"),
        "very_long_tokens": long_words,
        "symbol_heavy_lines": F.size(F.filter(lines, heavy)).cast("long"),
    }
    weights = {"replacement_count": 10, "mojibake_count": 5, "control_count": 20, "repeated_glyph_runs": 5, "very_long_tokens": 2, "symbol_heavy_lines": 1}
    rows = texts.withColumns({k: F.when(t.isNotNull(), v) for k, v in counts.items()})
    artifacts = sum((F.col(k) * w for k, w in weights.items()), F.lit(0))
    return rows.withColumn("artifact_rate_per_million", artifacts * 1_000_000.0 / F.greatest(F.col("character_count"), F.lit(1)))
