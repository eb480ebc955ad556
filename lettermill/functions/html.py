"""HTML made safe to show."""

from __future__ import annotations

import re
from collections import Counter
from html import escape
from html.parser import HTMLParser

# Elements that go with their content, that only lose their tags, attributes that go, and links that stay.
DROPPED = {"script", "style", "iframe", "object", "embed", "form", "svg", "math", "template", "noscript"}
BARE = {"meta", "base", "link", "input", "button"}
FRAMES = {"frame", "frameset"}
# Of the dropped ones: that which has no end tag and no content, and those whose content is plain markup, so that without an end tag only the tag goes.
VOID, MARKUP = {"embed"}, {"form", "object", "noscript"}
ATTRIBUTES = {"srcset", "formaction", "poster", "srcdoc", "background"}
SCHEMES = ("http:", "https:", "mailto:")
POLICY = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; img-src data:; style-src 'unsafe-inline'\">"


class _Safe(HTMLParser):
    def __init__(self, inline: dict[str, str], remote: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inline, self.remote = inline, remote
        self.inside: list[str] = []  # dropped elements that are open
        self.ends: Counter[str] = Counter()  # end tags still to come
        self.blocked = False

    def feed(self, data: str) -> None:
        self.ends.update(re.findall(r"</([a-z]+)", data.lower()))
        super().feed(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED - VOID and (tag not in MARKUP or self.ends[tag]):
            self.inside.append(tag)
        if self.inside or tag in DROPPED | BARE | FRAMES:
            return
        kept = []
        for name, value in attrs:
            value = value or ""
            if name.startswith("on") or name in ATTRIBUTES or (name == "style" and "url(" in value.lower()):
                continue
            if name == "href" and not value.strip().lower().startswith((*SCHEMES, "#")):
                continue
            if name == "src":
                if value.lower().startswith("cid:") and value[4:] in self.inline:
                    value = self.inline[value[4:]]
                elif not value.lower().startswith("data:image/") and not (self.remote and value.lower().startswith(("http:", "https:"))):
                    self.blocked = True
                    continue
            kept.append(f' {name}="{escape(value)}"')
        self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.ends[tag] -= 1
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass
        elif not self.inside and tag not in DROPPED | BARE | FRAMES:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(escape(data, quote=False))


def sanitized(html: str, inline: dict[str, str] | None = None, remote: bool = False) -> tuple[str, bool]:
    """(html, blocked): without active content; images of content ids become data, remote ones are blocked unless allowed."""
    p = _Safe(inline or {}, remote)
    p.feed(html)
    p.close()
    return POLICY + "".join(p.out), p.blocked
