"""What a user writes by hand: rules, names, search terms, and a bag's description."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime

from lettermill.operators.search import Terms

# Fields of a bag's description that must have this value, and those that must have one.
BAG_CONSTANTS = {"Bag-Type": "Mailbag", "Mailbag-Source": "mbox", "Mailbag-Specification-Version": "1.0", "Original-Included": "False"}
BAG_FIELDS = ("Bagging-Timestamp", "Bagging-Date", "External-Identifier", "Mailbag-Agent", "Mailbag-Agent-Version")
#: A rule: a mailbox, or mailbox@domain, of globs.
RULE = re.compile(r"[^\s\x00-\x20\x7f,;<>@]+(@[^\s\x00-\x20\x7f,;<>@]+)?")


def owner_rules(lines: Iterable[str]) -> list[str]:
    """Rules in lower case, distinct and sorted. Empty lines and comments are none; anything that is no mailbox or mailbox@domain is an error."""
    rules = {r for r in (line.strip().lower() for line in lines) if r and not r.startswith("#")}
    for r in sorted(rules):
        if not RULE.fullmatch(r):
            raise ValueError(f"not a mailbox or mailbox@domain: {r!r}")
    return sorted(rules)


def owner_aliases(text: str) -> list[str]:
    """Addresses between line ends, commas and semicolons, in lower case, distinct and sorted; a # begins a comment."""
    bare = re.sub(r"(?m)#.*$", "", text)
    return sorted(set(re.findall(r"[^\s,;](?:[^,;\n]*[^\s,;])?", bare.lower())))


def highlights(terms: Terms) -> list[str]:
    """What a viewer marks: phrases, then selector values but for dates, each once whatever its case."""
    found: dict[str, str] = {}
    for text in [*terms.phrases, *(v for k, v in terms.selectors if k not in ("date", "before", "after"))]:
        found.setdefault(text.casefold(), text)
    found.pop("", None)
    return list(found.values())


def bag_faults(text: str, payload_bytes: int, payload_files: int) -> list[str]:
    """What is wrong with a bag's description, for a payload of so many bytes and files; empty: nothing."""
    pairs = [re.fullmatch(r"([^:]+): (.*)", line) for line in text.splitlines()]
    if not all(pairs) or len({p[1] for p in pairs}) < len(pairs):
        return ["invalid or repeated field"]
    have = {p[1]: p[2] for p in pairs}
    faults = [f"{k} is not {v}" for k, v in BAG_CONSTANTS.items() if have.get(k) != v]
    faults += [f"{k} is missing" for k in BAG_FIELDS if not have.get(k)]
    try:
        at = datetime.fromisoformat(have.get("Bagging-Timestamp", ""))
        if at.tzinfo is None or have.get("Bagging-Date") != f"{at:%Y-%m-%d}":
            faults.append("Bagging-Date is not the date of Bagging-Timestamp")
    except ValueError:
        faults.append("Bagging-Timestamp is no time")
    if have.get("Payload-Oxum") != f"{payload_bytes}.{payload_files}":
        faults.append(f"Payload-Oxum is not {payload_bytes}.{payload_files}")
    return faults
