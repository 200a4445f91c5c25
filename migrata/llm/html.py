"""Main text of HTML pages by line-block distribution.

A page becomes *lines*: markup is stripped, every block-level tag starts a new line, inline tags
vanish, character references are decoded and white space inside a line becomes one blank.  Parts
that are never article text (scripts, styles, forms, menus, page headers and footers, sidebars,
notices, adverts, reader comments, by tag, role, class name or id) leave a gap of empty lines, and so
do the ends of ``<article>`` and ``<main>``.  An element that holds an article is never left out for its names; one of which
only a part of a name says so (``site-sidebar``) is left out if it holds at most ``PART_SHARE`` of the page's text.

The distribution is the sum of weights over a window of ``WINDOW`` lines sliding down the page.  The weight of a
line is its length, ``MIN_PEAK`` more inside ``<article>`` or ``<main>``, and nothing for a line of links outside
them.  Where the sum rises from zero a block begins, where it falls back to zero it ends; the block is kept if the
sum reaches ``MIN_PEAK`` in it, or, on a page where no block does, half of the page's highest sum.  The *surge* is its first weighted line and the *dive* its last one, and every
line between them is kept, short ones too.  Kept lines are joined in page order by one blank.

Defined results: a null or empty page, and a page without article text, give the empty string; whole
pages are read whatever their length; unclosed or stray tags, unclosed comments and an unclosed last
tag are tolerated; equal pages give equal texts; an empty table gives an empty table; only the columns
named in ``keep`` are returned.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migrata.llm.common import col, map_texts

WINDOW = 3
MIN_PEAK = 80
MAX_LINK_SHARE = 0.5
PART_SHARE = 0.3

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
# elements whose content is raw text up to their end tag
RAW = frozenset("script style noscript textarea title template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# elements that never hold article text
DROP = frozenset("nav footer aside form button select dialog menu svg math canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices gdpr popup "
    "modal overlay newsletter subscribe signup login share sharing social related recommended comment comments "
    "commentlist disqus reply replies respond pagination pager toolbar widget skip".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S)
_BROKEN_TAG = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_PARTS = re.compile(r"[\s_-]+")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![\w-])", re.I | re.S)


def _unwanted(name: str, attrs: str) -> int:
    """2 if a role or a whole class name or id tells that an element is no article text, 1 if a part of a name does, else 0."""
    found = 0
    if attrs and name not in ("html", "body", "article", "main"):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role" and value.strip() in ROLES:
                return 2
            if key in ("class", "id"):
                if not NAMES.isdisjoint(value.split()):
                    return 2
                if not NAMES.isdisjoint(_PARTS.split(value)):
                    found = 1
    return found


def _article_class_unwanted(attrs: str) -> bool:
    return any((m[1].lower() in ("class", "id")) and "comment" in (m[2] or m[3] or m[4] or "").lower()
               for m in _ATTR.finditer(attrs))


class _Outline:
    """Where the elements start that hold an ``<article>`` or ``<main>`` (not one of comments), how much text every element holds,
    and how much the page does."""

    def __init__(self, page: str):
        self.holders: set[int] = set()
        self.size: dict[int, int] = {}
        self.total = 0
        opened: list[tuple[str, int, int]] = []

        def text(a: int, b: int) -> None:
            self.total += sum(map(len, page[a:b].split()))

        pos, n = 0, len(page)
        while 0 <= (lt := page.find("<", pos)) < n:
            text(pos, lt)
            m = _TOKEN.match(page, lt)
            if m is None:
                m = _BROKEN_TAG.match(page, lt)
                pos = m.end() if m else lt + 1
                continue
            pos = m.end()
            name, attrs = (m["name"] or "").lower(), m["attrs"] or ""
            if not name or name in VOID or attrs.rstrip().endswith("/"):
                continue
            if m["end"]:
                # an end tag without a start closes nothing; what it leaves open inside closes with it
                if any(x[0] == name for x in opened[-64:]):
                    while True:
                        what, at, before = opened.pop()
                        self.size[at] = self.total - before
                        if what == name:
                            break
                continue
            if name in RAW:
                close = re.compile(r"</" + re.escape(name) + r"(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = close.end() if close else n
                continue
            if name in ("article", "main") and not _article_class_unwanted(attrs):
                for _, at, _ in reversed(opened):
                    if at in self.holders:
                        break
                    self.holders.add(at)
            if name not in INLINE and name != "p":
                opened.append((name, lt, self.total))
        if pos < n:
            text(pos, n)
        for _, at, before in opened:
            self.size[at] = self.total - before

    def leaves_out(self, at: int, certain: bool, inside: bool) -> bool:
        """Whether the element of an unwanted name that starts at ``at`` goes."""
        if not inside and at in self.holders:
            return False
        return certain or self.size.get(at, 0) <= PART_SHARE * self.total


def lines_of(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, characters of it inside links, inside a declared article) per line, and whether any article is declared."""
    lines: list[tuple[str, int, bool]] = []
    buf: list[str] = []
    linked = 0          # characters of the current line inside links
    article = 0         # depth of article / main elements
    declared = False
    links = 0
    skip, depth = "", 0  # element whose content is left out, and its depth
    outline: _Outline | None = None

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            buf.append(raw)
            if links:
                linked += len(raw)

    def line() -> None:
        nonlocal linked
        s = " ".join(_html.unescape("".join(buf)).split())
        if s:
            lines.append((s, min(linked, len(s)), article > 0))
        buf.clear()
        linked = 0

    def gap() -> None:
        line()
        lines.extend([("", 0, False)] * WINDOW)

    pos, n = 0, len(page)
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            if not skip:
                text(page[pos:])
            break
        if not skip:
            text(page[pos:lt])
        m = _TOKEN.match(page, lt)
        if m is None:
            m = _BROKEN_TAG.match(page, lt)  # a tag with an unpaired quote
            if m is None:                    # a bare "<" is text
                if not skip:
                    text("<")
                pos = lt + 1
                continue
            pos = m.end()
            continue
        pos = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        end = bool(m["end"])
        attrs = m["attrs"] or ""
        if not end and name in RAW and not attrs.rstrip().endswith("/"):
            close = re.compile(r"</" + re.escape(name) + r"(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = close.end() if close else n
            continue
        if skip:
            if name == skip:
                depth += -1 if end else 0 if attrs.rstrip().endswith("/") else 1
                if depth == 0:
                    skip = ""
            continue
        if name in ("article", "main"):
            if end:
                line()
                article = max(0, article - 1)
                if not article:
                    gap()
            elif article and _article_class_unwanted(attrs):
                gap()
                skip, depth = name, 1
            else:
                line()
                if not article:
                    gap()
                article += 1
                declared = True
            continue
        if not end and name not in VOID and not attrs.rstrip().endswith("/"):
            out = name in DROP or (name == "header" and not article)
            if not out and (how := _unwanted(name, attrs)):
                if outline is None and (how == 1 or not article):
                    outline = _Outline(page)
                out = how == 2 and article > 0 or outline.leaves_out(lt, how == 2, article > 0)
            if out:
                gap()
                skip, depth = name, 1
                continue
        if name == "a":
            links = max(0, links - 1) if end else links + 1
        if name not in INLINE:
            line()
    line()
    return lines, declared


def block_sums(lengths: Sequence[int], window: int = WINDOW) -> list[int]:
    """Sum of the text lengths over ``window`` lines starting at each line."""
    out, total = [0] * len(lengths), 0
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i]
        if i + window < len(lengths):
            total -= lengths[i + window]
        out[i] = total
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    lines, _ = lines_of(page)
    weight = [len(s) + MIN_PEAK if s and inside else 0 if linked > MAX_LINK_SHARE * len(s) else len(s) for s, linked, inside in lines]
    sums = block_sums(weight)
    peak = max(sums, default=0)
    least = MIN_PEAK if peak >= MIN_PEAK else peak / 2
    kept: list[str] = []
    i, n = 0, len(lines)
    while i < n:
        if not sums[i]:
            i += 1
            continue
        dive = i
        while dive < n and sums[dive]:
            dive += 1
        if max(sums[i:dive]) >= least:
            surge = next(k for k in range(i, dive) if weight[k])
            kept += [s for s, _, _ in lines[surge:dive] if s]
        i = dive
    return " ".join(kept)


def main_text(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` (code points) of every page."""
    def make():
        return lambda htmls: ([extract(h) for h in htmls],)

    out = map_texts(pages, [col(k) for k in keep], [col(html_col)], [T.StructField("text", T.StringType())], make)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
