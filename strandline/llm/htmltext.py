"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, in page order; what
cannot be article text (scripts, menus, forms and the like, by tag or by the words of
its class, id or role) is left out at once.  The text lengths of the lines, without
what is inside links, are summed over sliding windows.  Where the sums surge above a
threshold text begins, where they dive to (nearly) nothing it ends, and everything
between is kept, short lines included; a stretch reaches over short lines without links
right before and after it, such as a headline.  Stretches of far less text a line than
the fullest one are left out.  A page whose sums never reach the threshold is measured by
its own largest sum.  If the page marks articles, lines outside them weigh nothing and each line
inside weighs enough to surge, so that no part of an article is lost; if it only marks a
main part, lines outside that weigh nothing.

Parsing takes one pass: what a start or end tag closes is kept with each open element,
so that neither depth nor broken markup makes a page cost more than its length.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_batches

#: Lines of a window, the text lengths at which it surges and dives, and the least share of the fullest stretch's text a line.
WINDOW, SURGE, DIVE, DENSITY = 3, 80, 10, 0.25

# Tags whose content is never text of the page; it has no markup of its own.
_OPAQUE = frozenset("script style noscript template svg math iframe object canvas textarea select title xmp noembed noframes".split())
_BOILER = frozenset("nav header footer aside form menu dialog button head".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget|related|recommend\w*|share|social|comments?|comment-?list|respond|replies|disqus|"
    r"footer|foot|header|masthead|copyright|login|signup|search|pagination|pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
# Words that tell an advert, a notice or a comment even on a paragraph or an article.
_STRICT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|newsletter|copyright|comments?|related)(?:$|[\s_-])", re.I)
_WITHOUT = re.compile(r"(?:^|(?<=[\s]))(?:no|has|have|with|without|hide)[_-]\S*", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
# A quote opens a value only right after an equals sign.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li dt dd tr td th option".split())
_LISTS = frozenset("ul ol dl table".split())
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in _OPAQUE}
_WHITE = re.compile(r"\s+")
# A paragraph or list item ends where the next block begins.
_ENDS_P = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre section article main header footer nav aside form hr address figure fieldset details".split())


def _is_boiler(name: str, attributes: str, in_article: bool) -> bool:
    if name in _BOILER and not (name == "header" and in_article):  # an article's header holds its headline
        return True
    if not attributes.strip("/ \t\r\n") or name in ("html", "body", "main"):
        return False
    hint = None if name in _HEADINGS or name == "header" else _STRICT if name in ("p", "article") else _HINT
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key in ("class", "id") and hint and hint.search(_WITHOUT.sub("", value)):
            return True
        if key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


class _Open(NamedTuple):
    """An open element: what of it counts, and what its descendants close or are kept by."""

    name: str
    boiler: bool
    paragraph: int  # place of the paragraph that a block would end here, or -1
    block: int  # place of the innermost element that is neither inline nor a paragraph, or -1
    items: dict[str, int]  # places of the items that a further item of the same list would end


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters inside links, 2 inside an article, 1 inside a main element, else 0) of each block with text."""
    out: list[tuple[str, int, int]] = []
    text: list[tuple[str, bool]] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of the open elements by name
    root = _Open("", False, -1, -1, {})
    skipping = articles = mains = links = 0

    def flush() -> None:
        if text:
            joined = _WHITE.sub(" ", "".join(t for t, _ in text)).strip()
            if joined:
                linked = sum(len(t.strip()) for t, in_link in text if in_link)
                out.append((joined, min(linked, len(joined)), 2 if articles else int(mains > 0)))
            text.clear()

    def leave(place: int) -> None:
        nonlocal skipping, articles, mains, links
        while len(stack) > place:
            top = stack.pop()
            places[top.name].pop()
            skipping -= top.boiler
            articles -= top.name == "article"
            mains -= top.name == "main"
            links -= top.name == "a"

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at and not skipping:
            text.append((html.unescape(page[at:stop]), links > 0))
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in _OPAQUE and not found[1]:
            closed = _CLOSE[name].search(page, at)
            at = closed.end() if closed else len(page)
            continue
        block = name not in _INLINE
        if name == "br":
            text.append((" ", False))
        elif block:
            flush()
        top = stack[-1] if stack else root
        if found[1]:
            # a stray end tag of an inline element doesn't close the blocks around it
            if places.get(name) and (block or top.block < places[name][-1]):
                leave(places[name][-1])
        elif name not in _VOID and not found[3].endswith("/"):
            if name in _ENDS_P and top.paragraph >= 0:
                leave(top.paragraph)
            elif name in _ITEMS and name in top.items:
                leave(top.items[name])
            top, place = stack[-1] if stack else root, len(stack)
            boiler = _is_boiler(name, found[3], articles > 0)
            items = {} if name in _LISTS else top.items | {name: place} if name in _ITEMS else top.items
            stack.append(
                _Open(name, boiler, place if name == "p" else -1 if block else top.paragraph, place if block and name != "p" else top.block, items)
            )
            places.setdefault(name, []).append(place)
            skipping += boiler
            articles += name == "article"
            mains += name == "main"
            links += name == "a"
    flush()
    return out


def spans(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE, density: float = DENSITY) -> list[tuple[int, int]]:
    """(first line, line after the last) of each stretch of text, in order."""
    n = len(lengths)
    if not n or not lengths.max():
        return []
    ends = np.concatenate([[0], np.cumsum(lengths)])
    sums = ends[np.minimum(np.arange(n) + window, n)] - ends[:-1]
    surge, dive = min(surge, int(sums.max()) - 1), min(dive, int(lengths.max()) - 1)
    found, at = [], 0
    while at < n:
        if sums[at] <= surge or lengths[at] <= dive:
            at += 1
            continue
        stop = at
        while stop < n and sums[stop] > dive:
            stop += 1
        first = at
        while first > (found[-1][1] if found else 0) and lengths[first - 1] > 0:
            first -= 1
        while stop < n and lengths[stop] > 0:
            stop += 1
        found.append((first, stop))
        at = stop
    per_line = [(ends[b] - ends[a]) / max(1, np.count_nonzero(lengths[a:b])) for a, b in found]
    return [s for s, full in zip(found, per_line, strict=True) if full >= density * max(per_line)]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> str:
    """The article of a page, its blocks joined by two line feeds; empty if there is none."""
    found = lines(page or "")
    marked = max((inside for _, _, inside in found), default=0)
    weights = [(len(text) - linked + (surge + 1) * (marked == 2)) * (inside == marked) for text, linked, inside in found]
    kept = [text for a, b in spans(np.array(weights, np.int64), window, surge, dive) for text, _, inside in found[a:b] if inside == marked]
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)``, one row for each row of ``pages``.

    Null and empty pages and pages without text give an empty text; ids and urls may
    be null or repeat; an empty table gives an empty result; other columns are not read.
    """
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        return {"id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = map_batches(rows, run, f"id {id_kind}, url {url_kind}, text string, n_chars long", "html")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
