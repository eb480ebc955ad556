"""Search: a query string becomes predicates; memberships are semi joins, pages are top-k plans."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import padded
from lettermill.operators.reports import searchable

KEYS = ("any", "to", "cc", "bcc", "from", "subject", "date", "before", "after")


@dataclass(frozen=True)
class Terms:
    """What a query string asks for: (key, value) selectors and free-text phrases."""

    selectors: list[tuple[str, str]] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)


def parse(query: str) -> Terms:
    """Shell quoting; `key:value` for the known keys, all else is text; text is case-folded. Empty values and bad dates are errors."""
    selectors, phrases = [], []
    for token in shlex.split(query):
        key, mark, value = token.partition(":")
        if not mark or key.lower() not in KEYS:
            phrases.append(token.casefold())
            continue
        if not value:
            raise ValueError(f"{key}: needs a value")
        if key.lower() in ("date", "before", "after"):
            date.fromisoformat(value)
        selectors.append((key.lower(), value.casefold()))
    return Terms(selectors, phrases)


def contains(column: Column, text: str) -> Column:
    return F.lower(column).contains(text.lower())


def day(text: str, shift: int = 0) -> Column:
    return F.lit((date.fromisoformat(text) + timedelta(days=shift)).isoformat()).cast("timestamp_ntz")


def select(messages: DataFrame, recipients: DataFrame, terms: Terms, bodies: DataFrame | None = None, attachments: DataFrame | None = None) -> DataFrame:
    """Searchable messages that satisfy all terms.

    date: that day; before: strictly before it; after: on a later day. any: sender or a recipient in any role. Phrases match
    bodies (pk, body); with attachments (pk, content) each phrase may be met by the body or by an attachment. A phrase
    without a letter or digit matches nothing.
    """
    found = searchable(messages)
    for key, value in terms.selectors:
        if key == "from":
            found = found.filter(contains(F.col("sender"), value))
        elif key == "subject":
            found = found.filter(contains(F.col("subject"), value))
        elif key == "date":
            found = found.filter((F.col("date") >= day(value)) & (F.col("date") < day(value, 1)))
        elif key == "before":
            found = found.filter(F.col("date") < day(value))
        elif key == "after":
            found = found.filter(F.col("date") >= day(value, 1))
        else:
            hits = recipients.filter(contains(F.col("address"), value))
            hits = hits.select("pk") if key == "any" else hits.filter(F.col("role") == key).select("pk")
            if key == "any":
                hits = hits.union(messages.filter(contains(F.col("sender"), value)).select("pk"))
            found = found.join(hits, "pk", "left_semi")
    if terms.phrases and bodies is not None:
        found = found.join(matching(bodies, terms.phrases, attachments), "pk", "left_semi")
    return found


def phrase_in(text: Column, phrase: str) -> Column:
    """Do the phrase's tokens stand in the text one after another?"""
    wanted = padded(F.lit(phrase))
    return (wanted != " ") & (wanted != "  ") & F.contains(padded(text), wanted)


def matching(bodies: DataFrame, phrases: list[str], attachments: DataFrame | None = None) -> DataFrame:
    """(pk) of documents with all phrases: in one body, or phrase by phrase in the body or an attachment."""
    if attachments is None:
        return bodies.filter(reduce(Column.__and__, [phrase_in(F.col("body"), p) for p in phrases])).select("pk")
    found = None
    for p in phrases:
        hits = bodies.filter(phrase_in(F.col("body"), p)).select("pk").union(attachments.filter(phrase_in(F.col("content"), p)).select("pk")).distinct()
        found = hits if found is None else found.join(hits, "pk", "left_semi")
    return found


def postings(bodies: DataFrame) -> DataFrame:
    """(token, pk, positions): the inverted index, written bucketed by token where bodies are many."""
    from lettermill.functions.text import tokens

    each = bodies.select("pk", F.posexplode(tokens(F.col("body"))).alias("position", "token"))
    return each.groupBy("token", "pk").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def phrase_postings(index: DataFrame, phrase: list[str]) -> DataFrame:
    """(pk) with the phrase, from the inverted index: positions less their place in the phrase must meet."""
    found = None
    for k, token in enumerate(phrase):
        here = index.filter(F.col("token") == token).select("pk", F.expr(f"transform(positions, p -> p - {k})").alias("at"))
        if found is None:
            found = here
        else:
            both = found.join(here.withColumnRenamed("at", "next"), "pk").select("pk", F.array_intersect("at", "next").alias("at"))
            found = both.filter(F.size("at") > 0)
    return found.select("pk")


def page(found: DataFrame, order: str = "date", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page; ties by pk in the direction of the order. limit 0: all."""
    key = F.col(order) if order == "date" else F.lower(F.col(order))
    by = [key.desc(), F.col("pk").desc()] if descending else [key.asc(), F.col("pk").asc()]
    found = found.orderBy(*by)
    if offset:
        found = found.offset(offset)
    return found.limit(limit) if limit else found


def newest_then(found: DataFrame, order: str, descending: bool, limit: int) -> DataFrame:
    """The newest `limit` messages, shown in another order."""
    return page(page(found, "date", True, limit), order, descending, 0)


def with_recipients(chosen: DataFrame, recipients: DataFrame) -> DataFrame:
    """The page with `recipients`: its distinct addresses, sorted, joined by commas; '' if none. Only the page's rows are joined."""
    listed = recipients.join(chosen.select("pk"), "pk", "left_semi").groupBy("pk").agg(F.array_join(F.sort_array(F.collect_set("address")), ",").alias("recipients"))
    return chosen.join(listed, "pk", "left").withColumn("recipients", F.coalesce("recipients", F.lit("")))


def capped_count(found: DataFrame, limit: int) -> DataFrame:
    """(n, exact): the count up to limit + 1, and the exact count or null beyond the limit."""
    n = found.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(limit)).alias("n"), F.when(F.col("n") <= limit, F.col("n")).alias("exact"))


def subject_suggestions(messages: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(subject, messages, last_seen): subjects that contain the text, the most frequent first, at most 50; shorter texts than 3: none."""
    if len(text) < 3:
        return messages.limit(0).select("subject", F.lit(0).cast("long").alias("messages"), F.col("date").alias("last_seen"))
    found = searchable(messages).filter(contains(F.col("subject"), text)).groupBy("subject").agg(F.count(F.lit(1)).alias("messages"), F.max("date").alias("last_seen"))
    return found.orderBy(F.desc("messages"), F.desc("last_seen"), F.lower("subject")).limit(max(1, min(limit, 50)))


def address_suggestions(messages: DataFrame, recipients: DataFrame, names: DataFrame) -> DataFrame:
    """(address, display_name, messages, last_seen): an address counts once for each message; names (address, display_name), the first non-empty by name."""
    mail = searchable(messages)
    seen = mail.select("pk", "date", F.col("sender").alias("address")).union(mail.select("pk", "date").join(recipients, "pk").select("pk", "date", "address")).filter("address <> ''").distinct()
    counted = seen.groupBy("address").agg(F.count(F.lit(1)).alias("messages"), F.max("date").alias("last_seen"))
    named = names.filter("display_name <> ''").groupBy("address").agg(F.min("display_name").alias("display_name"))
    return counted.join(named, "address", "left").select("address", F.coalesce("display_name", F.lit("")).alias("display_name"), "messages", "last_seen")


def suggest(suggestions: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """The suggestions whose address or name contains the text, most used first, then latest, then by address."""
    if len(text) < 3:
        return suggestions.limit(0)
    hit = suggestions.filter(contains(F.col("address"), text)).union(suggestions.filter(contains(F.col("display_name"), text))).distinct()
    return hit.orderBy(F.desc("messages"), F.desc("last_seen"), F.lower("address")).limit(max(1, min(limit, 50)))
