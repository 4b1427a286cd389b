"""A lenient HTML reader for text extraction: a tree of block-level nodes with runs of text as leaves."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: A tag without angle brackets in its quoted values and without stray quotes, the common case; and what comes next in
#: any other tag: its end, or a quoted value.
PLAIN = re.compile(r"""<(/?)([A-Za-z][^\s/>"'=]*)((?:[^<>"'=]|=\s*"[^"<>]*"|=\s*'[^'<>]*'|=(?!\s*["']))*+)>""")
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
NEXT = re.compile(r""">|=\s*["']""")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|data-label|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Elements without content, with raw text that is no text of the page, and those inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Elements whose content is no text of the page.
SKIP = frozenset("noscript template iframe svg math object select audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag closes when it stands directly inside.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
#: Elements whose end tags do not reach over these.
WALLS = frozenset("td th table article section main aside nav body".split())


@dataclass
class Page:
    """Nodes in page order: tag (#text for runs), parent, attributes that may tell its kind, label (training pages),
    and for runs the text and how much of it stands in links."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    cue: list[str] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, cue: str = "", label: str = "", text: str = "", linked: int = 0) -> int:
        for column, value in zip((self.tag, self.parent, self.cue, self.label, self.text, self.linked), (tag, parent, cue, label, text, linked), strict=True):
            column.append(value)
        return len(self.tag) - 1


class TagEnds:
    """Where tags end whose quotes are not plain: a quoted value goes to its closing quote. What follows each quoted
    value is found once and remembered, so that all tags of a page together are read in linear time."""

    def __init__(self, html: str):
        self.html, self.known = html, {}
        self.last = {q: html.rfind(q) for q in "\"'"}

    def __call__(self, at: int) -> int:
        """The place of the tag's end after `at`, or -1 if a value's closing quote or the end is missing."""
        seen, found = [], -1
        while m := NEXT.search(self.html, at):
            place = m.start()
            if place in self.known:
                found = self.known[place]
                break
            if self.html[place] == ">":
                found = place
                break
            seen.append(place)
            quote = self.html[m.end() - 1]
            if m.end() - 1 >= self.last[quote]:
                break
            at = self.html.index(quote, m.end()) + 1
        self.known.update(dict.fromkeys(seen, found))
        return found


def tokens(html: str) -> list[tuple[str, bool, str, str]]:
    """The page as (text, is_end, name, attributes): a run of text has no name. Comments, declarations and the raw text
    of scripts and styles are left out. A tag whose quotes never close ends at its first bracket; one that the page's
    end cuts off is no text."""
    out: list[tuple[str, bool, str, str]] = []
    ends, at, size, closing = None, 0, len(html), {}

    def text(a: int, b: int) -> None:
        if a < b:
            out.append((html[a:b], False, "", ""))

    while (begin := html.find("<", at)) >= 0:
        if m := PLAIN.match(html, begin):
            end, name, rest, after = m.group(1), m.group(2), m.group(3), m.end()
        elif m := NAME.match(html, begin):
            ends = ends or TagEnds(html)
            close = ends(m.end())
            if close < 0:
                close = html.find(">", m.end())
            end, name, rest, after = m.group(1), m.group(2), html[m.end() : close] if close >= 0 else "", close + 1 if close >= 0 else size
            if close < 0:
                name = ""
        elif html.startswith(("<!", "<?", "</"), begin) and begin + 2 < size:
            comment = html.startswith("<!--", begin)
            close = html.find("-->" if comment else ">", begin + (4 if comment else 2))
            text(at, begin)
            at = size if close < 0 else close + (3 if comment else 1)
            continue
        elif begin + 1 >= size or html.startswith(("<!", "<?", "</"), begin):
            text(at, begin)
            at = size
            break
        else:  # a bracket that is text
            text(at, begin + 1)
            at = begin + 1
            continue
        text(at, begin)
        at = after
        if not name:
            continue
        name = name.lower()
        if name in RAW and not end and not rest.endswith("/"):
            if closing.get(name, at) >= 0:
                m = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                closing[name] = m.start() if m else -1
                if m:
                    at = m.end()
            if closing[name] < 0:  # without an end tag scripts and styles go to the page's end, other tags stand alone
                if name in ("script", "style"):
                    at = size
            continue
        out.append(("", bool(end), name, rest))
    text(at, size)
    return out


def skipped(parts: list[tuple[str, bool, str, str]]) -> set[int]:
    """The tokens that open an element without text of the page: those with an end tag of their own."""
    opened: dict[str, list[int]] = {}
    found = set()
    for i, (_, end, name, rest) in enumerate(parts):
        if name in SKIP:
            if end:
                if opened.get(name):
                    found.add(opened[name].pop())
            elif not rest.endswith("/"):
                opened.setdefault(name, []).append(i)
    return found


def read(html: str) -> Page:
    """The page's tree. Markup, comments, raw text (scripts, styles) and elements like select or svg leave no text;
    character references are decoded and white space in a run is one space. Unclosed and crossed tags are closed as
    browsers do in the common cases; an element to be skipped that never ends skips nothing, but for the options of a
    select."""
    page = Page()
    page.add("#root", -1)
    stack: list[tuple[str, int]] = [("#root", 0)]
    parts: list[str] = []
    links, linked, hidden = 0, 0, 0
    found = tokens(html)
    skips = skipped(found) if any(t[2] in SKIP for t in found) else ()

    def flush() -> None:
        nonlocal linked
        if parts:
            s = "".join(parts)
            s = " ".join((unescape(s) if "&" in s else s).split())
            if s:
                page.add("#text", stack[-1][1], text=s, linked=min(linked, len(s)))
            parts.clear()
        linked = 0

    def pop(i: int) -> None:
        nonlocal hidden
        if hidden:
            hidden -= sum(node < 0 for _, node in stack[i:])
        del stack[i:]

    for i, (piece, end, name, rest) in enumerate(found):
        if not name:
            if not hidden:
                parts.append(piece)
                if links:
                    linked += len(piece)
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if end else 1)) if end else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        if end:
            for j in range(len(stack) - 1, 0, -1):
                if stack[j][0] == name:
                    pop(j)
                    links = 0
                    break
                if stack[j][0] in WALLS and name not in WALLS:
                    break
            continue
        links = 0
        if i in skips or name in ("option", "optgroup"):
            if name == "option" and stack[-1] == ("option", -1):
                pop(len(stack) - 1)
            stack.append((name, -1))  # hidden: text below it is left out, and so are its nodes
            hidden += 1
            continue
        if name in SKIP:
            continue
        if hidden and all(n in ("option", "optgroup") for n, node in stack if node < 0):
            while stack[-1][1] < 0:  # the options of a select that has no end
                pop(len(stack) - 1)
        if hidden:
            stack.append((name, -1))
            hidden += 1
            continue
        if stack[-1][0] == "p":
            stack.pop()
        if name in CLOSES:
            while stack[-1][0] in CLOSES[name]:
                stack.pop()
        cue, label = "", ""
        if rest:
            for k, *v in ATTRIBUTE.findall(rest):
                k, value = k.lower(), "".join(v).lower()
                if k == "data-label":
                    label = value
                elif k == "style":
                    if "display:none" in value.replace(" ", ""):
                        cue += " hidden-element"
                elif k == "hidden" or k == "aria-hidden":
                    cue += " hidden-element" if k == "hidden" else ""
                else:
                    cue += " " + value
        stack.append((name, page.add(name, stack[-1][1], cue, label)))
    flush()
    return page
