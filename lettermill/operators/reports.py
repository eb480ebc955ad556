"""Correspondence reports and contacts."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCHABLE = ("Archive", "Sent")


def searchable(messages: DataFrame) -> DataFrame:
    """Only mail that is neither quarantined nor excluded."""
    return messages.filter(F.col("category").isin(*SEARCHABLE))


def in_years(messages: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Searchable mail from the start of the first year to before the year after the last; None: no bound."""
    found = searchable(messages)
    if first is not None:
        found = found.filter(F.col("date") >= F.lit(f"{first:04d}-01-01").cast("timestamp_ntz"))
    if last is not None:
        found = found.filter(F.col("date") < F.lit(f"{last + 1:04d}-01-01").cast("timestamp_ntz"))
    return found


def owners(messages: DataFrame) -> DataFrame:
    """(address): whoever sent mail filed as sent, in any year."""
    return messages.filter("category = 'Sent'").select(F.col("sender").alias("address")).distinct()


def yearly(messages: DataFrame, recipients: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(year, sent, received, people): people are the distinct senders and recipients, an empty sender among them."""
    found = in_years(messages, first, last).select("pk", "sender", "category", F.year("date").alias("year"))
    summary = found.groupBy("year").agg(F.count_if(F.col("category") == "Sent").alias("sent"), F.count_if(F.col("category") != "Sent").alias("received"))
    people = found.select("year", F.col("sender").alias("address")).union(found.select("pk", "year").join(recipients, "pk").select("year", "address"))
    people = people.distinct().groupBy("year").agg(F.count(F.lit(1)).alias("people"))
    return summary.join(people, "year", "left").select("year", "sent", "received", F.coalesce("people", F.lit(0)).alias("people"))


def top_senders(messages: DataFrame, first: int | None, last: int | None, n: int) -> DataFrame:
    """(address, messages, first_day, last_day): the n most frequent senders that are no owners; 0: none."""
    found = in_years(messages, first, last).withColumnRenamed("sender", "address").join(owners(messages), "address", "left_anti")
    return _top(found, n)


def top_recipients(messages: DataFrame, recipients: DataFrame, first: int | None, last: int | None, n: int) -> DataFrame:
    """The same of recipients; an address in two roles of a message counts twice."""
    found = in_years(messages, first, last).select("pk", "date").join(recipients, "pk").join(owners(messages), "address", "left_anti")
    return _top(found, n)


def _top(found: DataFrame, n: int) -> DataFrame:
    day = F.date_format("date", "yyyy-MM-dd")
    ranked = found.groupBy("address").agg(F.count(F.lit(1)).alias("messages"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    ranked = ranked.withColumn("address", F.when(F.col("address") == "", "(missing sender)").otherwise(F.col("address")))
    return ranked.orderBy(F.desc("messages"), "address").limit(n)


def resolve_owners(messages: DataFrame, addresses: list[str], aliases: list[str]) -> DataFrame:
    """(address): exact addresses, which all must occur as a sender, and sent-mail senders that contain an alias, each of which must match."""
    known = messages.select(F.lower("sender").alias("address")).distinct()
    wanted = [a.strip().lower() for a in addresses]
    found = known.filter(F.col("address").isin(*wanted)) if wanted else known.limit(0)
    if missing := set(wanted) - {r["address"] for r in found.collect()}:  # at most the addresses given
        raise ValueError(f"no such address: {', '.join(sorted(missing))}")
    sent = messages.filter("category = 'Sent'").select(F.lower("sender").alias("address")).distinct()
    for alias in aliases:
        own = sent.filter(F.col("address").contains(alias.strip().lower()))
        if own.isEmpty():
            raise ValueError(f"no sent mail from: {alias}")
        found = found.union(own)
    if not wanted and not aliases:
        raise ValueError("no owner is named")
    return found.distinct()


def meaningful(messages: DataFrame, recipients: DataFrame, owner: DataFrame) -> DataFrame:
    """(address): whom an owner wrote to (to, bcc), and who wrote to an owner (to); owners are left out."""
    mail = searchable(messages)
    own = owner
    from_owner = mail.join(own.withColumnRenamed("address", "sender"), "sender", "left_semi").select("pk")
    written = recipients.filter(F.col("role").isin("to", "bcc")).join(from_owner, "pk", "left_semi").select("address")
    to_owner = recipients.filter("role = 'to'").join(own, "address", "left_semi").select("pk").distinct()
    writers = mail.join(to_owner, "pk", "left_semi").select(F.col("sender").alias("address"))
    return written.union(writers).filter("address <> ''").distinct().join(own, "address", "left_anti")


def contacts(messages: DataFrame, recipients: DataFrame, owner: DataFrame) -> DataFrame:
    """(address, first_day, last_day, messages) of meaningful contacts: in how many messages they occur in any header. Most first."""
    mail = searchable(messages).select("pk", "sender", F.date_format("date", "yyyy-MM-dd").alias("day"))
    seen = mail.select("pk", "day", F.col("sender").alias("address")).union(mail.select("pk", "day").join(recipients, "pk").select("pk", "day", "address")).distinct()
    kept = seen.join(meaningful(messages, recipients, owner), "address", "left_semi")
    found = kept.groupBy("address").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("messages"))
    return found.orderBy(F.desc("messages"), F.lower("address"), "address")


# The policy that tells people from lists, services and malformed addresses.
LONGEST_LOCAL = 48
ALLOWED = [r"^=@ex\.com$", r"@vm\.vonage\.com$"]
LIST_DOMAINS = [r"(^|\.)googlegroups\.com$", r"(^|\.)yahoogroups\.com$", r"(^|\.)groups\.io$", r"(^|\.)lists\.(apache|mysql|gnu)\.org$", r"(^|\.)lists\.sourceforge\.net$", r"(^|\.)listserv(\.|$)", r"(^|\.)lists\.", r"(^|\.)mailman\.", r"^groups\.(google|yahoo)\.com$"]
LIST_LOCALS = [r"(^|[-_.+])(listserv|mailman|majordomo)([-_.+]|$)", r"(^|[-_.+])(request|subscribe|unsubscribe|join|leave|bounces?)([-_.+]|$)", r"[-_.+](owner|admin)([-_.+]|$)", r"^(listadmin|listsrv|lyris|sympa|postman)$"]
SERVICE_DOMAINS = [r"(^|\.)alerts?\.", r"(^|\.)newsletters?\.", r"(^|\.)reply\.", r"^ws\.apache\.org$", r"^facebookmail\.com$", r"^campaigns\.privacyassociation\.org$"]
SERVICE_LOCALS = [
    r"(^|[-_.+])(no[-_.]?reply|do[-_.]?not[-_.]?reply|donotreply|noreply)([-_.+]|$)", r"(^|[-_.+])(mailer-daemon|postmaster|bounce|bounces|auto[-_.]?reply)([-_.+]|$)", r"^(alerts?|enews|newsletter|notifications?)$",
    r"^zones_\d+\+", r"^xmlrpc[-_.]", r"^lj_notify$", r"^(auto|ship)[-_.]confirm$", r"^(root|staff|support|admin|office|sales|marketing|systems|webmaster|service|help|info|team|director)$",
    r"^(alerts?|notification|notifications|update|updates|daily|news|newsletter|enews)([-_.+]|$)",
]
BOGUS_LOCALS = [r'(^$|^\*$|^-$|^=$|[\x00-\x1f\x7f "/])']
BOGUS_DOMAINS = [r'(^[.-]|[.-]$|\.\.|[\x00-\x1f\x7f "/])']


@dataclass(frozen=True)
class Policy:
    """The patterns by which addresses are told apart; the defaults are one archive's."""

    longest_local: int = LONGEST_LOCAL
    allowed: tuple[str, ...] = tuple(ALLOWED)
    list_domains: tuple[str, ...] = tuple(LIST_DOMAINS)
    list_locals: tuple[str, ...] = tuple(LIST_LOCALS)
    service_domains: tuple[str, ...] = tuple(SERVICE_DOMAINS)
    service_locals: tuple[str, ...] = tuple(SERVICE_LOCALS)
    bogus_locals: tuple[str, ...] = tuple(BOGUS_LOCALS)
    bogus_domains: tuple[str, ...] = tuple(BOGUS_DOMAINS)

    def changed(self, mode: str, **patterns) -> Policy:
        """With other values: mode replace puts them in place, extend adds patterns to those there are. Unknown names and modes, and patterns that don't compile, are errors."""
        if mode not in ("replace", "extend"):
            raise ValueError(f"unknown mode {mode}")
        for name, value in patterns.items():
            if name != "longest_local":
                for p in value:
                    re.compile(p)
                patterns[name] = (*getattr(self, name), *value) if mode == "extend" else tuple(value)
        return replace(self, **patterns)


def classify(address: Column, policy: Policy | None = None) -> Column:
    """struct(kind, reason) of an address, by the first rule that applies."""
    policy = policy or Policy()
    any_of = lambda x, patterns: x.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    local, domain = F.substring_index(address, "@", 1), F.when(F.instr(address, "@") > 0, F.substring(address, F.instr(address, "@") + 1, F.length(address))).otherwise(F.lit(""))
    as_ = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    return (
        F.when(any_of(address, policy.allowed), as_("human", "allow-pattern"))
        .when((F.instr(address, "@") == 0) | domain.contains("@"), as_("bogus", "malformed-at-sign"))
        .when(address.rlike("[\\p{Cc}\\p{Cs}�]"), as_("bogus", "invalid-unicode"))
        .when(any_of(local, policy.bogus_locals), as_("bogus", "invalid-local-part"))
        .when((domain == "") | any_of(domain, policy.bogus_domains), as_("bogus", "invalid-domain"))
        .when(any_of(domain, policy.list_domains) | any_of(local, policy.list_locals), as_("mailing-list", "mailing-list-pattern"))
        .when(any_of(domain, policy.service_domains) | any_of(local, policy.service_locals), as_("service", "service-pattern"))
        .when(F.length(local) > policy.longest_local, as_("bogus", "long-local-part"))
        .otherwise(as_("human", "no-exclusion-rule"))
    )


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a shell glob with *, ? and [...]."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        end = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append("\\" + ch if not ch.isalnum() and ch != "_" else ch)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def owner_rule(sender: Column, include: list[str], exclude: list[str]) -> Column:
    """Does a rule `mailbox` or `mailbox@domain` (globs) include the sender and none exclude it? An empty sender never matches."""
    address = F.lower(F.trim(sender))
    at = F.length(address) - F.length(F.substring_index(address, "@", -1))
    local = F.when(at > 0, F.substring(address, F.lit(1), at - 1)).otherwise(address)
    domain = F.when(at > 0, F.substring_index(address, "@", -1)).otherwise(F.lit(""))

    def fits(rules: list[str]) -> Column:
        found = F.lit(False)
        for rule in rules:
            mailbox, mark, host = rule.strip().lower().partition("@")
            found = found | (local.rlike(glob_regex(mailbox)) & domain.rlike(glob_regex(host if mark else "*")))
        return found

    return (address != "") & fits(include) & ~fits(exclude)


def review(observed: DataFrame, sources: DataFrame, run: int | None = None) -> DataFrame:
    """(observation_pk, disposition, detail, path) of what was observed (observation_pk, run_pk, source_pk, disposition, detail), in order; of one run or of all. sources: (source_pk, path)."""
    found = observed if run is None else observed.filter(F.col("run_pk") == run)
    return found.join(sources, "source_pk").select("observation_pk", "disposition", "detail", "path").orderBy("observation_pk")
