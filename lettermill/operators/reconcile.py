"""Store-to-store reconciliation: a cache against an archive by raw and by semantic hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.functions.mail import parsed
from lettermill.sources import mail, versions
from lettermill.tables import cut


def match(cache: DataFrame, archive: DataFrame) -> DataFrame:
    """cache rows with `outcome`: exact (its raw hash is archived), semantic (only its semantic hash is), or cache-only.

    cache: (cache_pk, service, raw, semantic); archive: (pk, raw, semantic), pk null where an observation was not catalogued.
    """
    known = archive.filter("pk IS NOT NULL")
    raw = known.select(F.col("raw").alias("k")).distinct().withColumn("is_raw", F.lit(True))
    semantic = known.filter("semantic IS NOT NULL").select(F.col("semantic").alias("k")).distinct().withColumn("is_semantic", F.lit(True))
    found = cache.join(raw, cache["raw"] == raw["k"], "left").drop("k").join(semantic, cache["semantic"] == semantic["k"], "left").drop("k")
    outcome = F.when(F.col("is_raw"), "exact").when(F.col("is_semantic"), "semantic").otherwise("cache-only")
    return found.select(*cache.columns, outcome.alias("outcome"))


def represented(cache: DataFrame, archive: DataFrame) -> DataFrame:
    """(messages): distinct archive messages whose semantic hash the cache has."""
    return archive.filter("pk IS NOT NULL").join(cache.select("semantic"), "semantic", "left_semi").agg(F.count_distinct("pk").alias("messages"))


def ambiguous(archive: DataFrame) -> DataFrame:
    """(semantic, messages, raws): semantic classes with more than one raw hash."""
    found = archive.filter("pk IS NOT NULL").groupBy("semantic").agg(F.count_distinct("pk").alias("messages"), F.count_distinct("raw").alias("raws"))
    return found.filter("raws > 1")


def ambiguous_ranking(cache: DataFrame, archive: DataFrame, limit: int) -> DataFrame:
    """(semantic, cached, messages): ambiguous classes that the cache has, by archive messages, cache rows, hash."""
    held = cache.groupBy("semantic").agg(F.count(F.lit(1)).alias("cached"))
    found = ambiguous(archive).join(held, "semantic").select("semantic", "cached", "messages")
    return found.orderBy(F.desc("messages"), F.desc("cached"), "semantic").limit(limit)


def service_rollup(cache: DataFrame, archive: DataFrame) -> DataFrame:
    """(service, records, exact, semantic, cache_only, distinct_raw, distinct_semantic, ambiguous)."""
    many = ambiguous(archive).select("semantic").withColumn("many", F.lit(True))
    found = match(cache, archive).join(many, "semantic", "left")
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    return found.groupBy("service").agg(
        F.count(F.lit(1)).alias("records"), is_("exact").alias("exact"), is_("semantic").alias("semantic"), is_("cache-only").alias("cache_only"),
        F.count_distinct("raw").alias("distinct_raw"), F.count_distinct("semantic").alias("distinct_semantic"), F.count_if(F.coalesce("many", F.lit(False))).alias("ambiguous"),
    )


def multiset_delta(left: DataFrame, right: DataFrame, pair: str, item: str) -> DataFrame:
    """(pair, item, only_left, only_right, changed): how often an item occurs more on one side; changed: on both sides of the pair something is left over."""
    n = lambda df, name: df.groupBy(pair, item).agg(F.count(F.lit(1)).alias(name))
    both = n(left, "l").join(n(right, "r"), [pair, item], "full_outer").fillna(0, ["l", "r"])
    d = both.select(pair, item, F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("only_left"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("only_right"))
    return d.filter("only_left + only_right > 0")


def delta_ranking(delta: DataFrame, pair: str, item: str) -> DataFrame:
    """(item, occurrences, pairs) of a multiset delta, the most frequent first."""
    found = delta.groupBy(item).agg(F.sum(F.col("only_left") + F.col("only_right")).cast("long").alias("occurrences"), F.count_distinct(pair).alias("pairs"))
    return found.orderBy(F.desc("occurrences"), item)


def best_candidates(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """For each left id the right id of the least score, ties to the smaller id."""
    return pairs.groupBy(left).agg(F.min(F.struct(score, right)).alias("m")).select(left, f"m.{right}", f"m.{score}")


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, e.g. payload files against a manifest."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def by_ordinal(expected: DataFrame, found: DataFrame, file: str, ordinal: str, digest: str) -> DataFrame:
    """(file, ordinal, fault): manifest rows against container records, place by place: missing, unexpected or different."""
    e, f = expected.select(file, ordinal, F.col(digest).alias("e")), found.select(file, ordinal, F.col(digest).alias("f"))
    both = e.join(f, [file, ordinal], "full_outer")
    fault = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("e") != F.col("f"), "different")
    return both.select(file, ordinal, fault.alias("fault")).filter("fault IS NOT NULL")


def semantic_pairs(cache: DataFrame, archive: DataFrame) -> DataFrame:
    """(cache_pk, pk, semantic): cache rows that no raw hash matches, each with the archive messages of its semantic hash, once."""
    known = archive.filter("pk IS NOT NULL")
    open_ = cache.join(known.select("raw"), "raw", "left_anti")
    return open_.select("cache_pk", "semantic").join(known.select("pk", "semantic").distinct(), "semantic").select("cache_pk", "pk", "semantic").distinct()


def service_report(cache: DataFrame, archive: DataFrame, inventory: DataFrame, formatting: DataFrame) -> DataFrame:
    """Per service the counts of inventory (service, state: complete, partial or unreadable), of outcomes, of archive messages met, of ambiguous rows, and of pairs whose headers were compared (formatting: cache_pk, only_formatting)."""
    state = lambda s: F.count_if(F.col("state") == s).alias(f"{s}_emlx")
    files = inventory.groupBy("service").agg(state("complete"), state("partial"), state("unreadable"))
    known = archive.filter("pk IS NOT NULL").select("pk", "semantic").distinct()
    met = cache.select("cache_pk", "service", "semantic").join(known, "semantic")
    one = met.groupBy("cache_pk", "service").agg(F.count_distinct("pk").alias("n"))
    counts = [
        match(cache, archive).groupBy("service").agg(F.count(F.lit(1)).alias("compared"), *[F.count_if(F.col("outcome") == o).alias(o.replace("-", "_")) for o in ("exact", "semantic", "cache-only")]),
        met.groupBy("service").agg(F.count_distinct("pk").alias("archive_matches")),
        one.groupBy("service").agg(F.count_if(F.col("n") > 1).alias("ambiguous")),
        formatting.join(cache.select("cache_pk", "service"), "cache_pk").groupBy("service").agg(F.count(F.lit(1)).alias("header_pairs"), F.count_if("only_formatting").alias("formatting_only")),
    ]
    found = files
    for c in counts:
        found = found.join(c, "service", "left")
    return found.fillna(0)


def relaxed_headers(rows: DataFrame, text: str) -> DataFrame:
    """rows with `headers`, an array of (name, value): the header block's fields with lower-case names, unfolded, blanks run together; lines that are no field are left out."""
    lines = F.regexp_replace(F.col(text), r"\r\n|\r|\n", "\n")
    block = F.regexp_replace(F.substring_index(lines, "\n\n", 1), r"\n[ \t]+", " ")
    fields = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[!-9;-~]+:"))
    relaxed = lambda v: F.regexp_replace(F.regexp_replace(v, r"[ \t]+", " "), r"^ | $", "")
    parts = F.transform(fields, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("name"), relaxed(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return rows.withColumn("headers", parts)


def review_cases(variants: DataFrame) -> DataFrame:
    """One row for each semantic class of variants (semantic, role, raw, date, subject, autosave) with more than one raw hash: how many, whether stores share one, and whether date and subject agree.

    A class is summed up by counts of distinct values; no class has to fit into one list.
    """
    by_raw = variants.groupBy("semantic", "raw").agg(F.count_distinct("role").alias("roles"), F.count(F.lit(1)).alias("n"), F.count_if("autosave").alias("autosaves"))
    raws = by_raw.groupBy("semantic").agg(F.count(F.lit(1)).alias("distinct_raw"), F.count_if(F.col("roles") > 1).alias("shared_raw"), F.sum("n").alias("variants"), F.sum("autosaves").alias("autosaves"))
    texts = variants.groupBy("semantic").agg(
        (F.count_distinct(F.coalesce("date", F.lit(""))) == 1).alias("date_agrees"), (F.count_distinct(F.coalesce("subject", F.lit(""))) == 1).alias("subject_agrees"),
        (F.count_if(F.coalesce("date", F.lit("")) == "") == 0).alias("date_on_all"), (F.count_if(F.coalesce("subject", F.lit("")) == "") == 0).alias("subject_on_all"),
    )
    return raws.filter("distinct_raw > 1").join(texts, "semantic").withColumn("shared_across_stores", F.col("shared_raw") > 0).drop("shared_raw")


def review_totals(cases: DataFrame) -> DataFrame:
    """(cases, variants, distinct_raw, shared, date_differs, subject_differs) of review cases."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return cases.agg(F.count(F.lit(1)).alias("cases"), n("variants").alias("variants"), n("distinct_raw").alias("distinct_raw"), F.count_if("shared_across_stores").alias("shared"), F.count_if(~F.col("date_agrees")).alias("date_differs"), F.count_if(~F.col("subject_agrees")).alias("subject_differs"))


# A role's folder in a case, and what its files' names begin with.
REVIEW_FOLDERS = {"cache": ("apple-cache", "cache"), "archive": ("canonical-archive", "archive")}


def review_files(cases: DataFrame, variants: DataFrame) -> DataFrame:
    """(case_number, role, file, reference, sha256, byte_length, raw): the messages of the cases' classes, numbered in each role by reference.

    cases: (case_number, semantic); variants: (semantic, role, reference, pk, sha256, raw), raw as it is read now. One that no longer has its digests is an error.
    """
    held = variants.join(cases.select("case_number", "semantic"), "semantic")
    now = parsed(held.withColumn("raw", F.coalesce("raw", F.lit(b""))), permissive=True, fields=("semantic_sha256",))
    changed = F.raise_error(F.concat(F.lit("changed since it was indexed: "), F.col("reference"))).cast("binary")
    same = (F.sha2("raw", 256) == F.col("sha256")) & F.coalesce(F.col("m.semantic_sha256") == F.col("semantic"), F.lit(False))
    n = F.row_number().over(Window.partitionBy("case_number", "role").orderBy("reference", "pk"))
    folder = F.concat(F.lit("case-"), F.format_string("%02d", "case_number"), F.lit("-h3-"), F.left("semantic", F.lit(16)))
    place, first = (F.when(F.col("role") == "cache", REVIEW_FOLDERS["cache"][k]).otherwise(REVIEW_FOLDERS["archive"][k]) for k in (0, 1))
    which = F.when(F.col("role") == "cache", "").otherwise(F.concat(F.lit("-message-"), F.col("pk").cast("string")))
    name = F.concat(folder, F.lit("/"), place, F.lit("/"), first, F.lit("-"), F.format_string("%03d", n), which, F.lit("-h2-"), F.left("sha256", F.lit(16)), F.lit(".eml"))
    return now.select("case_number", "role", name.alias("file"), "reference", "sha256", F.length("raw").cast("long").alias("byte_length"), F.when(same, F.col("raw")).otherwise(changed).alias("raw"))


def export_review(cases: DataFrame, variants: DataFrame, root: str) -> None:
    """The review set as a new folder of two tables, cases (with their files and bytes) and files (`review_files`), which appear together or not at all. An existing one is not overwritten."""
    if versions.newest(cases.sparkSession, root):
        raise FileExistsError(f"review set already exists: {root}")
    files = cut(review_files(cases, variants))
    size = files.groupBy("case_number").agg(F.count_if(F.col("role") == "cache").alias("cache_files"), F.count_if(F.col("role") != "cache").alias("archive_files"), F.sum("byte_length").alias("exported_bytes"))
    versions.publish({"cases": cases.join(size, "case_number", "left").fillna(0, size.columns[1:]), "files": files}, root, {"cases": cases.count()})


def cache_scan(spark: SparkSession, root: str, services: DataFrame) -> DataFrame:
    """(path, service, state, sha256, semantic_sha256) of the `.emlx` files below root: partial, complete, or unreadable, which has no digests.

    path: relative to root; services: (account, service), where an account is the folder below the store's version, in any case; others are unknown.
    """
    top = root.rstrip("/") + "/"
    files = mail.files(spark, root).filter(F.lower("path").endswith(".emlx"))
    partial = F.lower("path").endswith(".partial.emlx")
    read = mail.records(files.filter(~partial).select("path", "length", F.lit(0).alias("start")), permissive=True)
    hashed = parsed(read.select(F.col("container").alias("path"), "raw"), permissive=True).select("path", F.sha2("raw", 256).alias("sha256"), "m.semantic_sha256")
    found = files.select("path", partial.alias("partial")).join(hashed, "path", "left")
    state = F.when(F.col("partial"), "partial").when(F.col("semantic_sha256").isNull(), "unreadable").otherwise("complete")
    relative = F.substring("path", F.instr("path", top) + len(top), F.length("path"))
    account = F.lower(F.regexp_extract("relative", r"^V[^/]*/([^/]+)/", 1))
    rows = found.withColumn("state", state).withColumn("relative", relative).withColumn("account", account)
    known = services.select(F.lower("account").alias("account"), "service").dropDuplicates(["account"])
    return rows.join(known, "account", "left").select(F.col("relative").alias("path"), F.coalesce("service", F.lit("unknown")).alias("service"), "state", F.when(F.col("state") == "complete", F.col("sha256")).alias("sha256"), "semantic_sha256")


def cache_inventory(scan: DataFrame) -> DataFrame:
    """(service, complete, partial, unreadable) of `cache_scan`; unreadable files are complete ones that can't be read."""
    is_ = lambda *x: F.count_if(F.col("state").isin(*x))
    return scan.groupBy("service").agg(is_("complete", "unreadable").alias("complete"), is_("partial").alias("partial"), is_("unreadable").alias("unreadable"))
