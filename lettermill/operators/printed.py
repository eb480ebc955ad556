"""Mail printed on pages: text pages become message records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = r"^[A-Za-z][A-Za-z0-9-]{0,39}:"
_BLANK = r"^\s*$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pages(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row for each page of a text, with `page` (from 1) and `page_text`; pages end with a form feed, and what follows the last one counts if there is any."""
    split = F.split(text, "\f")
    some = F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)
    others = [c for c in texts.columns if c != text]
    return texts.select(*others, F.posexplode(some).alias("_at", "_page")).select(*others, (F.col("_at") + 1).alias("page"), F.regexp_replace("_page", r"\s+$", "").alias("page_text"))


def messages(found: DataFrame, text: str = "page_text") -> DataFrame:
    """found with `headers` (array of name, value), `body` and `classification`.

    Headers are the lines from the first that isn't blank to the next blank one, if each begins a field or goes on with one;
    else there are none, and the body is the page. A page is a printed-email if its headers name Date, Subject and From or To.
    """
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^(?:[^\S\n]*\n)+", "")
    rows = found.withColumn("_lines", F.split(plain, "\n"))
    end = F.array_position(F.transform("_lines", lambda x: x.rlike(_BLANK)), True)
    rows = rows.withColumn("_end", F.when(end > 0, end - 1).otherwise(F.size("_lines")).cast("int"))
    rows = rows.withColumn("_head", F.slice("_lines", F.lit(1), F.col("_end")))
    sound = (F.col("_end") > 0) & F.col("_lines")[0].rlike(HEADER) & F.forall("_head", lambda x: x.rlike(HEADER) | x.rlike(r"^\s"))
    joined = F.array_join(F.transform("_head", lambda x: F.when(x.rlike(r"^\s"), F.concat(F.lit(" "), _stripped(x))).otherwise(F.concat(F.lit("\f"), x))), "")
    field = lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("name"), _stripped(F.regexp_replace(x, r"^[^:]+:", "")).alias("value"))
    none = F.array().cast("array<struct<name: string, value: string>>")
    rows = rows.withColumn("headers", F.when(sound, F.transform(F.split(F.substring(joined, 2, 2**31 - 1), "\f"), field)).otherwise(none))
    rest = F.array_join(F.slice("_lines", F.col("_end") + 2, F.size("_lines")), "\n")
    rows = rows.withColumn("body", F.when(F.size("headers") > 0, F.regexp_replace(rest, r"\s+$", "")).otherwise(F.col(text)))
    has = lambda *names: F.exists("headers", lambda h: F.lower(h["name"]).isin(*names))
    kind = F.when(has("date") & has("subject") & has("from", "to"), "printed-email").otherwise("non-message")
    return rows.withColumn("classification", kind).drop("_lines", "_end", "_head")


def field(name: str) -> Column:
    """Value of the first header of the name, any case; null if there is none."""
    return F.try_element_at(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]


# Fields of a printed message that its record takes over.
COPIED = ("from", "to", "cc", "bcc", "reply-to", "date", "subject")


def derived(found: DataFrame) -> DataFrame:
    """found (`messages` rows with source_name, source_sha256, page) with `raw`: a message made of the printed one, marked as such, with the fields it shows, its own number and where it came from."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " "))
    own = F.concat(F.lit("<page-"), "source_sha256", F.lit("-p"), F.col("page").cast("string"), F.lit("@derived.invalid>"))
    marks = [line("Message-ID", own), F.lit("X-Derived: printed-email"), F.lit("X-Transcription-Status: machine-unreviewed"), line("X-Source-Name", F.col("source_name")), line("X-Source-SHA256", F.col("source_sha256")), line("X-Source-Page", F.col("page").cast("string"))]
    copied = F.transform(F.filter("headers", lambda h: F.lower(h["name"]).isin("message-id", *COPIED)), lambda h: F.concat(F.when(F.lower(h["name"]) == "message-id", F.lit("X-Observed-Message-ID")).otherwise(h["name"]), F.lit(": "), h["value"]))
    mime = [F.lit("MIME-Version: 1.0"), F.lit('Content-Type: text/plain; charset="utf-8"'), F.lit("Content-Transfer-Encoding: 8bit")]
    head = F.array_join(F.concat(F.array(*marks), copied, F.array(*mime)), "\n")
    return found.withColumn("raw", F.concat(head, F.lit("\n\n"), F.regexp_replace("body", r"\n*$", ""), F.lit("\n")).cast("binary"))
