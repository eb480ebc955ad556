"""Signature blocks and the facts in them, as columns: a body's last lines are an array, and each rule is a search in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How sure each kind of block is, the lines looked at and kept, and the patterns of lines and facts.
CONFIDENCE = {"delimiter": 0.98, "mobile-footer": 0.97, "contact-block": 0.88, "signoff": 0.64}
PHONE_SHARE, NAME_SHARE = 0.95, 0.70
TAIL_LINES, BLOCK_LINES, SIGNOFF_TAIL, SIGNOFF_LINES, NAME_LINES, LEAST_DIGITS = 30, 12, 6, 4, 4, 7
EMAIL = r"(?U)(?<![\w.+-])[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])"
URL = r"(?iU)\b(?:https?://|www\.)[^\s<>()]+"
PHONE = r"(?U)(?<!\w)(?:\+?\d[\d .()/-]{5,}\d)(?!\w)"
DELIMITER = r"(?U)^\s*(?:--+|__+|==+)\s*$"
QUOTED = r"(?iU)^(?:>+\s?|on .{0,160}wrote:|from:\s|sent:\s|-----\s*original message\s*-----)"
MOBILE = r"(?iU)^(?:sent from|get outlook for|envoy[eé] de mon)\b"
SIGNOFF = r"(?iU)^(?:best|best regards|cheers|cordially|kind regards|many thanks|regards|sincerely|thanks|thank you)[,!]?$"
CONTACT_WORD = r"(?iU)\b(?:fax|mobile|office|phone|tel|telephone|www|linkedin|department|university|institute|corporation|company)\b"

#: Lines before the tail that a block in it may begin with.
_CONTEXT = 14
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "     　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " " * 6


#: White space as `(?U)\s` has it, so that ends are trimmed without a search.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def normalized(text: Column) -> Column:
    """For comparison: lower case (ß as ss), wide forms narrow, white space as single blanks. Other compatibility forms stay as they are."""
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.replace(F.lower(F.translate(text, _WIDE, _NARROW)), F.lit("ß"), F.lit("ss")))
    return stripped(F.regexp_replace(low, r"(?U)\s+", " "))


def phone_digits(text: Column) -> Column:
    return F.concat(F.when(stripped(text).startswith("+"), F.lit("+")).otherwise(F.lit("")), F.regexp_replace(text, r"(?U)\D", ""))


# Each pattern is tried only on lines with a sign that it can't do without.


def _emails(line: Column) -> Column:
    return F.when(line.contains("@"), F.regexp_extract_all(line, F.lit(EMAIL), 0)).otherwise(F.array().cast("array<string>"))


def _urls(line: Column) -> Column:
    return F.when(line.contains(".") | line.contains("/"), F.regexp_extract_all(line, F.lit(URL), 0)).otherwise(F.array().cast("array<string>"))


def _phones(line: Column) -> Column:
    found = F.filter(F.regexp_extract_all(line, F.lit(PHONE), 0), lambda p: F.length(F.regexp_replace(p, r"(?U)\D", "")) >= LEAST_DIGITS)
    return F.when(line.rlike(r"(?U)\d"), found).otherwise(F.array().cast("array<string>"))


def has_contact(line: Column) -> Column:
    """An address, a link or a number of enough digits."""
    return (F.size(_emails(line)) > 0) | (F.size(_urls(line)) > 0) | (F.size(_phones(line)) > 0)


#: One to five words of letters, hyphens between words or in them; dots and apostrophes anywhere.
_WORDS = r"(?U)^[\s.'-]*\p{L}(?:[.']*\p{L})*(?:[.']*[\s-][\s.'-]*\p{L}(?:[.']*\p{L})*){0,4}[\s.'-]*$"


def is_name(line: Column) -> Column:
    """One to five words of letters in 60 characters; no closing formula, no contact word. line: without blanks at its end."""
    own = F.btrim(line, F.lit(" ,"))
    return (F.length(own) <= 60) & own.rlike(_WORDS) & ~own.rlike(SIGNOFF) & ~own.rlike(CONTACT_WORD)


def _where(flags: Column) -> Column:
    """Indices (from 0) at which an array of conditions holds."""
    return F.filter(F.transform(flags, lambda ok, i: F.when(ok, i)), lambda i: i.isNotNull())


def with_block(rows, body: str = "body"):
    """rows (a DataFrame) with `block`: (kind, confidence, start_line, end_line, lines) of the surest signature block at the end of the body, else null.

    By falling sureness: what follows a delimiter line; a mobile footer; the paragraph of the last line with a contact, and a closing formula above it; a closing formula with a name
    below. A delimiter that nothing follows ends the search.
    """
    at, bare = lambda i: F.get("_lines", i), lambda i: F.get("_bare", i)
    rows = rows.withColumn("_all", F.split(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"\r\n|\r", "\n"), "\n"))
    # the lines before the first quoted one
    rows = rows.withColumn("_shown", F.coalesce(F.array_min(_where(F.transform("_all", lambda x: stripped(x).rlike(QUOTED)))), F.size("_all")))
    rows = rows.withColumn("_from", F.greatest(F.lit(0), F.col("_shown") - TAIL_LINES - _CONTEXT))
    rows = rows.withColumn("_lines", F.transform(F.slice("_all", F.col("_from") + 1, F.col("_shown") - F.col("_from")), lambda x: F.rtrim(x, F.lit(_BLANK))))
    rows = rows.withColumn("_bare", F.transform("_lines", stripped))
    n = F.size("_lines")
    tail = F.greatest(F.lit(0), n - TAIL_LINES)  # the lines before the tail are there as context only
    last = lambda lines, test: F.array_max(F.filter(_where(F.transform(lines, test)), lambda i: i >= F.col("_tail")))
    # what a surer kind of block has settled is not looked for
    rows = rows.withColumns({"_n": n, "_tail": tail}).withColumn("_delimiter", last("_bare", lambda x: x.rlike(DELIMITER)))
    rows = rows.withColumn("_mobile", F.when(F.col("_delimiter").isNull(), last("_bare", lambda x: x.rlike(MOBILE))))
    rows = rows.withColumn("_contact", F.when(F.col("_delimiter").isNull() & F.col("_mobile").isNull(), last("_lines", has_contact)))
    rows = rows.withColumn("_gaps", F.when(F.col("_contact").isNotNull(), _where(F.transform("_bare", lambda x: x == ""))))
    # the paragraph of the contact, at most BLOCK_LINES long
    above = F.coalesce(F.array_max(F.filter("_gaps", lambda g: g < F.col("_contact"))), F.lit(-1)) + 1
    start = F.greatest(above, F.col("_contact") - (BLOCK_LINES - 1))
    below = F.coalesce(F.array_min(F.filter("_gaps", lambda g: g > F.col("_contact"))), F.col("_n"))
    rows = rows.withColumn("_start", start).withColumn("_end", F.least(below, F.col("_start") + BLOCK_LINES))
    formula = (F.col("_start") + F.col("_from") >= 2) & bare(F.col("_start") - 2).rlike(SIGNOFF) & (bare(F.col("_start") - 1) == "")
    span = lambda lo, hi: F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    full = lambda idx: F.filter(idx, lambda i: bare(i) != "")
    after = F.slice(full(span(F.col("_delimiter") + 1, F.col("_n"))), F.lit(1), F.lit(BLOCK_LINES))
    paragraph = F.concat(F.when(F.coalesce(formula, F.lit(False)), F.array(F.col("_start") - 2)).otherwise(F.array().cast("array<int>")), span(F.col("_start"), F.col("_end")))
    closing = F.filter(span(F.greatest(F.col("_tail"), F.col("_n") - SIGNOFF_TAIL), F.col("_n")), lambda i: bare(i).rlike(SIGNOFF))
    named = F.filter(F.transform(closing, lambda i: full(span(i, F.least(i + SIGNOFF_LINES, F.col("_n"))))), lambda b: (F.size(b) >= 2) & F.coalesce(is_name(at(F.get(b, F.lit(1)))), F.lit(False)))
    kind = F.when(F.col("_delimiter").isNotNull(), "delimiter").when(F.col("_mobile").isNotNull(), "mobile-footer").when(F.col("_contact").isNotNull(), "contact-block").when(F.col("_signoff").isNotNull(), "signoff")
    rows = rows.withColumn("_signoff", F.when(F.coalesce("_delimiter", "_mobile", "_contact").isNull(), F.get(named, F.lit(0)))).withColumn("_kind", kind)
    which = F.when(F.col("_kind") == "delimiter", after).when(F.col("_kind") == "mobile-footer", F.array("_mobile")).when(F.col("_kind") == "contact-block", paragraph).when(F.col("_kind") == "signoff", F.col("_signoff"))
    sure = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("_kind"))
    rows = rows.withColumn("_which", which)
    line = lambda k: (F.element_at("_which", k) + F.col("_from")).cast("int")
    block = F.struct(F.col("_kind").alias("kind"), sure.alias("confidence"), line(1).alias("start_line"), line(-1).alias("end_line"), F.transform("_which", at).alias("lines"))
    found = rows.withColumn("block", F.when(F.size("_which") > 0, block))
    return found.drop(*[c for c in found.columns if c in ("_all", "_shown", "_from", "_lines", "_bare", "_n", "_tail", "_delimiter", "_mobile", "_contact", "_gaps", "_start", "_end", "_signoff", "_kind", "_which")])


def line_facts(own: Column, ordinal: Column, confidence: Column) -> Column:
    """Array of (line, kind, value, normalized, confidence) of one line of a block, stripped; every line that may be a name is marked as one."""
    fact = lambda kind, value, form, sure: F.struct(ordinal.alias("line"), F.lit(kind).alias("kind"), value.alias("value"), form.alias("normalized"), sure.alias("confidence"))
    none = F.array().cast("array<struct<line: int, kind: string, value: string, normalized: string, confidence: double>>")
    text = F.array(fact("text", own, normalized(own), confidence))
    emails = F.transform(_emails(own), lambda v: fact("email", v, F.lower(v), confidence))
    urls = F.transform(_urls(own), lambda v: fact("url", v, F.regexp_replace(F.lower(v), "[.,]+$", ""), confidence))
    phones = F.transform(_phones(own), lambda v: fact("phone", v, phone_digits(v), confidence * PHONE_SHARE))
    name = F.when((ordinal < NAME_LINES) & is_name(own), F.array(fact("name-candidate", own, normalized(own), confidence * NAME_SHARE))).otherwise(none)
    return F.when(own == "", none).otherwise(F.concat(text, emails, urls, phones, name))
