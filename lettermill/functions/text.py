"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def padded(text: Column) -> Column:
    """The tokens with a blank before, between and after them: a phrase is contained as ` a b `."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def preview(text: Column, words: int = 18) -> Column:
    """The first words, with an ellipsis if there are more."""
    found = F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)
    return F.concat(F.array_join(F.slice(found, 1, words), " "), F.when(F.size(found) > words, "…").otherwise(""))


def trigrams(text: Column) -> Column:
    """Every three neighbouring characters, lower case; none for shorter texts."""
    low = F.lower(text)
    return F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: low.substr(i, F.lit(3))))


def safe_filename(name: Column, longest: int = 100) -> Column:
    """Only letters, digits, dot, dash and underscore; others become one underscore; `message` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(kept == "", "message").otherwise(F.substring(kept, 1, longest))


def escape_path(path: Column) -> Column:
    """Percent, carriage return and line feed as %25, %0D and %0A, as manifests write paths."""
    return F.replace(F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def unescape_path(path: Column) -> Column:
    """The reverse; null if a percent sign starts none of the three."""
    plain = F.replace(F.replace(F.replace(path, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    return F.when(~path.rlike("%(?!25|0D|0A)"), plain)


def byte_size(n: Column) -> Column:
    """`512 B`, `1.5 KiB`, ... with one decimal, halves to the even one; in whole numbers, as Spark's `%.1f` takes halves up."""
    n = n.cast("long")

    def unit(k: int, name: str) -> Column:
        size = F.lit(1024**k)
        tenths, left = F.floor(F.pmod(n, size) * 10 / size), F.pmod(F.pmod(n, size) * 10, size)
        up = (left * 2 > size) | ((left * 2 == size) & (tenths % 2 == 1))
        tenths = F.floor(n / size) * 10 + tenths + up.cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, unit(1, "KiB")).when(n < 1024**3, unit(2, "MiB")).otherwise(unit(3, "GiB"))


def path_year(path: Column) -> Column:
    """The last path component that is a year from 1900 to 2099."""
    years = F.filter(F.split(path, "/"), lambda p: p.rlike("^(19|20)[0-9]{2}$"))
    return F.try_element_at(years, F.lit(-1)).cast("int")


def prefixes(path: Column) -> Column:
    """`a`, `a/b`, ... up to the whole path; empty components are dropped."""
    names = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(names) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/")))


def token_of(value: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(value.cast("binary")), "+/", "-_"), F.lit("="))


def identity(*parts: Column) -> Column:
    """SHA-256 of the parts with a zero byte between them."""
    joined = [x for p in parts for x in (F.lit(b"\x00"), p.cast("binary"))][1:]
    return F.sha2(F.concat(*joined), 256)


def canonical_body(text: Column) -> Column:
    """Line ends as CRLF, blanks in a line collapsed, trailing line ends as one."""
    ends = F.regexp_replace(text, r"\r\n|\r|\n", "\n")
    return F.concat(F.replace(F.regexp_replace(F.regexp_replace(ends, r"[ \t]+", " "), r"\n+\z", ""), F.lit("\n"), F.lit("\r\n")), F.lit("\r\n"))
