"""Main text of web pages by line-block distribution.

Markup is stripped first: scripts and styles go, block elements start a line, inline elements join. What may not be
part of an article (menus, headers, footers, sidebars, forms, adverts, notices, reader comments; by name, role,
class or id) is noted as a range of lines, and so are article and main elements. Ranges are evidence, weighed over
the whole page: one that was never closed ends where an article starts; one that holds most of the page's text
stays unless an article stands outside it. The lines of the others are blank then, and so are those outside the
article if the page marks one.

Text lengths are summed over sliding windows of ``DEPTH`` lines. Where the sum surges, main text starts; where it
dives to zero, it ends; all lines between are kept. Inside an article any text is a surge; elsewhere a window needs
``SURGE`` characters, or as many as the best window of a shorter page has.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH, SURGE = 3, 80

#: Element names.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select datalist".split())
OUTSIDE = frozenset("nav footer aside form button dialog menu head".split())
MAIN = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPEN_ENDED = frozenset("p li td th tr dt dd option".split())
#: Words of class, id or role that mark what isn't the article, words that may follow those, and words before them that turn the sense.
COMMENTS = frozenset("comment comments disqus respond replies".split())
MARKS = COMMENTS | frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs contentinfo cookie cookies footer masthead menu modal nav navbar navigation newsletter notice popup promo related search share sharing sidebar signup social sponsor sponsored subscribe widget".split()
)
FOLLOW = frozenset("area bar block box button buttons container content form header icons inner item items left link links list panel posts right section stories thread top bottom wrap wrapper".split())
TURN = frozenset("with has no without show hide is".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VALUES = re.compile(r""""[^"]*"|'[^']*'""")
HIDDEN = re.compile(r"""(?<![\w-])hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)


def head_word(token: str) -> str:
    """The word that says what a class or id names: of ``left-sidebar``, ``sidebar-2`` and ``sidebar-box`` it is
    ``sidebar``, of ``share-price`` it is ``price``, of ``with-sidebar`` none."""
    words = [w for w in re.split(r"[\s_-]+|(?<=[a-z])(?=[A-Z])", token) if w]
    words = [w.lower() for w in words]
    while len(words) > 1 and (words[-1] in FOLLOW or words[-1].isdigit()):
        words.pop()
    if not words or words[0] in TURN:
        return ""
    return words[-1].rstrip("0123456789")


def mark_of(attributes: str) -> str:
    """What attributes say an element is: ``hidden``, ``comment``, ``mark`` or nothing."""
    if not attributes.strip():
        return ""
    if HIDDEN.search(attributes) and (HIDDEN.search(VALUES.sub('""', attributes)) or "aria-hidden" in attributes.lower() or "display" in attributes.lower()):
        return "hidden"
    heads = {head_word(t) for m in NAMED.finditer(attributes) for t in next(filter(None, m.groups()[1:]), "").split()}
    return "comment" if heads & COMMENTS else "mark" if heads & MARKS else ""


@dataclass(slots=True)
class Range:
    """The lines of an element: its kind is ``main``, or why it may not be part of the article."""

    kind: str
    name: str
    first: int
    last: int = -1
    closed: bool = False


def stripped(html: str) -> tuple[list[str], list[Range], list[int]]:
    """The lines of a page, '' for blank ones; the ranges of main elements and of what may stand outside; the
    lines at which a first heading starts."""
    lines: list[str] = []
    ranges: list[Range] = []
    headings: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, Range | None]] = []
    opened: Counter[str] = Counter()
    at = mains = 0

    def flush() -> None:
        if text := " ".join(unescape("".join(held)).split()):
            lines.append(text)
        held.clear()

    def pop(closed: bool) -> None:
        nonlocal mains
        name, own = stack.pop()
        opened[name] -= 1
        if own:
            own.last, own.closed = len(lines), closed
            mains -= own.kind == "main"
            lines.extend([""] * DEPTH)

    while m := TOKEN.search(html, at):
        start, at = m.span()
        held.append(html[m.pos : start])
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if not opened[name]:
                if name not in INLINE:
                    flush()
                continue
            flush()
            while stack[-1][0] != name:
                pop(False)
            pop(True)
            if name in ("div", "section", "table", "ul", "ol"):
                lines.append("")
            continue
        mark = mark_of(m[3])
        if name in INLINE and not (mark and name not in VOID):
            continue
        flush()
        if name in RAW:
            until = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = until.end() if until else len(html)
            if name == "title":
                lines.append("")
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        while stack and stack[-1][0] in OPEN_ENDED and (stack[-1][0] == name or stack[-1][0] == "p") and name not in INLINE:
            pop(False)
        if name == "h1":
            headings.append(len(lines))
        kind = ""
        if name not in ("html", "body"):
            kind = mark or ("name" if name in OUTSIDE or (name == "header" and not mains) else "main" if name in MAIN else "")
        own = None
        if kind:
            lines.extend([""] * DEPTH)
            own = Range(kind, name, len(lines))
            ranges.append(own)
            mains += kind == "main"
        stack.append((name, own))
        opened[name] += 1
    held.append(html[at:])
    flush()
    while stack:
        pop(False)
    return lines, ranges, headings


def covered(ranges: list[Range], n: int) -> list[int]:
    """By line, how many of the ranges it stands in."""
    steps = [0] * (n + 1)
    for r in ranges:
        steps[r.first] += 1
        steps[max(r.first, r.last)] -= 1
    return list(accumulate(steps))


def article_lines(html: str) -> tuple[list[str], list[bool]]:
    """The lines that may be main text, others blank, and whether they stand in a marked article."""
    lines, ranges, headings = stripped(html)
    mains, outside = [r for r in ranges if r.kind == "main"], [r for r in ranges if r.kind != "main"]
    starts = [r.first for r in mains]
    for r in outside:
        after = bisect_left(starts, r.first)
        if not r.closed and after < len(starts):
            r.last = min(r.last, starts[after])
    cover = covered(outside, len(lines))
    if not any(not cover[r.first] for r in mains):
        size = [0, *accumulate(map(len, lines))]

        def stays(r: Range) -> bool:
            most = 2 * (size[max(r.first, r.last)] - size[r.first]) > size[-1]
            heading = not headings or any(r.first <= h < r.last for h in headings)
            return most and heading and (r.kind == "mark" or r.name in ("form", "header") or (r.kind == "name" and not r.closed))

        outside = [r for r in outside if not stays(r)]
        cover = covered(outside, len(lines))
    own = covered([r for r in mains if not cover[r.first]], len(lines))
    marked = any(own[i] and not cover[i] for i, text in enumerate(lines) if text)
    return [text if not cover[i] and (own[i] or not marked) else "" for i, text in enumerate(lines)], [marked and own[i] > 0 for i in range(len(lines))]


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, joined by one space; none: empty."""
    lines, inside = article_lines(html or "")
    sizes = [len(text) for text in lines]
    sums = [sum(sizes[i : i + DEPTH]) for i in range(len(sizes))]
    surge = min(SURGE, max(sums, default=0))
    kept, i = [], 0
    while i < len(lines):
        if not sums[i]:
            i += 1
            continue
        dive = i
        while dive < len(lines) and sums[dive]:
            dive += 1
        if max(sums[i:dive]) >= surge or any(inside[i:dive]):
            kept += [text for text in lines[i:dive] if text]
        i = dive
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; null or empty pages, and pages without main text: ''.

    Null and repeated ids or rows keep their rows; other columns are not read; an empty table gives no rows.
    """

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")
