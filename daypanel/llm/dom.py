"""A small tolerant DOM: elements with parents, and the pieces of text between tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Fixed values of the HTML standard: elements without content, with raw text, and those that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("head html body option title".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
SCOPE = frozenset("ul ol dl table select body html article section div main aside nav footer header form button td th".split())

#: A quote opens a value only after an equals sign, as in browsers. One that is never closed is a character like any other, so its
#: tag ends at the next angle bracket and the text behind it stays.
_VALUES = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|[^>=]++)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_VALUES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)


@dataclass
class Page:
    """Elements in order of their start tags. ``parent`` is an index, -1 for the root."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    #: (element, text) in page order; a block border is (element, None), other white space " ".
    texts: list[tuple[int, str | None]] = field(default_factory=list)


def parse(source: str) -> Page:
    """Never fails: stray end tags are skipped, open elements end with the page."""
    page = Page()

    def start(tag: str, parent: int, marks: str = "") -> int:
        page.tag.append(tag)
        page.parent.append(parent)
        page.marks.append(marks)
        return len(page.tag) - 1

    stack = [start("#root", -1)]
    # How many elements of each name are open: an end tag without one is skipped at once, however deep the page.
    opened: Counter[str] = Counter()
    at = 0
    while at < len(source):
        found = _TOKEN.search(source, at)
        stop = found.start() if found else len(source)
        if stop > at:
            page.texts.append((stack[-1], html.unescape(source[at:stop])))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if not opened[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == tag:
                    if any(page.tag[i] in BLOCK for i in stack[depth:]):
                        page.texts.append((stack[depth], None))
                    opened.subtract(page.tag[i] for i in stack[depth:])
                    del stack[depth:]
                    break
            continue
        if tag in CLOSES_P and opened["p"]:
            _close(page, stack, frozenset(["p"]), opened)
        if tag in CLOSED_BY and any(opened[t] for t in CLOSED_BY[tag]):
            _close(page, stack, CLOSED_BY[tag], opened)
        marks = " ".join(m[2].strip("\"'") for m in _ATTRIBUTE.finditer(found[3])) if found[3] else ""
        own = start(tag, stack[-1], marks)
        if tag in BLOCK:
            page.texts.append((own, None))
        elif tag in ("br", "td", "th"):
            page.texts.append((own, " "))
        if tag in VOID or found[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            page.texts.append((own, source[at : end.start() if end else len(source)]))
            at = end.end() if end else len(source)
            continue
        stack.append(own)
        opened[tag] += 1
    return page


def _close(page: Page, stack: list[int], tags: frozenset[str], opened: Counter[str]) -> None:
    """End the nearest open element of ``tags``, unless one that holds such elements lies in between."""
    for depth in range(len(stack) - 1, 0, -1):
        tag = page.tag[stack[depth]]
        if tag in tags:
            if any(page.tag[i] in BLOCK for i in stack[depth:]):
                page.texts.append((stack[depth], None))
            opened.subtract(page.tag[i] for i in stack[depth:])
            del stack[depth:]
            return
        if tag in SCOPE:
            return


def blocks(page: Page, chosen) -> str:
    """The text of the chosen elements: white space collapsed inside a block, blocks joined by an empty line."""
    out: list[str] = []
    now: list[str] = []
    for element, text in page.texts:
        if text is None:
            if now:
                out.append(" ".join("".join(now).split()))
                now = []
        elif chosen[element]:
            now.append(text)
        elif text == " ":
            now.append(text)
    out.append(" ".join("".join(now).split()))
    return "\n\n".join(b for b in out if b)
