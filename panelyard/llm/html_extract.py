"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped so that every block element gives one line. Each line is worth its characters outside links, times
a weight: page furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) weighs nothing,
a name that only hints at furniture halves a line, an article element doubles what is in it and lowers what is
outside. The worths are then summed over windows of a few lines. Where the sum surges from nothing to a high value a
run of content starts, where it dives back to nothing the run ends, and the text of the runs is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm._common import slices

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)|<[!?/]")
#: The rest of a tag of usual length; of longer ones _TagEnds finds the end.
_REST = re.compile(r"""((?:[^'">]{1,256}+|"[^"]{0,256}+"|'[^']{0,256}+'){0,32}+)>""")
_MARK = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_BLANKS = re.compile(r"\s+")
#: Elements whose content is raw text of no page; those that swallow the rest of the page if they are not closed.
_RAW = {t: re.compile(f"</{t}", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes")}
_RAW_TO_THE_END = {"script", "style", "title", "textarea"}
#: Elements that are page furniture or hold no text.
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "header", "noscript", "template", "object", "svg", "math", "select", "audio", "video", "canvas", "datalist"}
#: Words in a class, id or role that name page furniture, and words that only say where it stands.
_NAMES = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright "
    "dialog disqus foot footer form gdpr head header login masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
_PLACES = set("area bar block bottom box container global inner item items left link links list main outer page right section site top wrap wrapper".split())
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr",
}
_SPACED = {"br", "td", "th", "img", "input"}  # white space where they stand
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that an opening tag ends without a closing tag: those of its own kind.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}


class Line(NamedTuple):
    """text, its characters in links, whether in an article or main element, whether a name hints at furniture."""

    text: str
    linked: int
    article: bool
    hinted: bool


#: Stands in a list of lines where an article or main element begins or ends.
EDGE = None


def _signal(tag: str, attributes: str, in_article: bool) -> int:
    """2: page furniture, 1: a name that hints at it, 0: nothing of the kind."""
    if tag in _FURNITURE and not (tag == "header" and in_article):
        return 2
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return 2
        if name in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
            for token in value.split():
                words = {w for w in re.split(r"[^a-z]+", token) if w}
                named = words & _NAMES - ({"head", "header"} if in_article else set())
                if named:
                    found = max(found, 1 if words - named - _PLACES else 2)
    return found


class _TagEnds:
    """Where the tags of a page end: at the first ``>`` that stands in no quoted value, however long the values are.

    Each mark that a search meets outside values is remembered with its result, and so is the last stretch without a
    mark, so all searches together take time in proportion to the page's length.
    """

    def __init__(self, html: str):
        self.html = html
        self.known: dict[int, int] = {}
        self.gap = (0, -1)

    def _next(self, at: int) -> int:
        if not self.gap[0] <= at <= self.gap[1]:
            m = _MARK.search(self.html, at)
            self.gap = (at, m.start() if m else len(self.html))
        return self.gap[1]

    def find(self, at: int) -> int:
        """The place of the ``>`` of a tag that is read up to ``at``; -1 if a value or the tag has no end."""
        path, found = [], -1
        while (mark := self._next(at)) < len(self.html):
            if mark in self.known:
                found = self.known[mark]
                break
            path.append(mark)
            if self.html[mark] == ">":
                found = mark
                break
            close = self.html.find(self.html[mark], mark + 1)
            if close < 0:
                break
            at = close + 1
        self.known.update(dict.fromkeys(path, found))
        return found


def lines_of(html: str) -> list[Line | None]:
    """The page's blocks in order. Furniture outside articles leaves lines without text, furniture in one leaves none.

    Block elements are held on a stack, so what is hidden ends with its parent even if its own end is missing. A
    paragraph ends where the next block starts. The time taken is in proportion to the page's length.
    """
    lines: list[Line | None] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, signal, is an article, is a block
    places: dict[str, list[int]] = {}  # of each tag on the stack
    blocks: list[int] = []  # places of blocks on the stack
    ends = _TagEnds(html)
    unclosed: set[str] = set()
    hidden = hinted = inside = linked = 0
    in_link = unseen = False

    def flush() -> None:
        nonlocal linked, unseen
        if hidden:
            if unseen and not inside:
                lines.append(Line("", 0, False, False))
            unseen = False
        elif parts:
            text = _BLANKS.sub(" ", unescape("".join(parts))).strip()
            if text:
                lines.append(Line(text, min(linked, len(text)), inside > 0, hinted > 0))
            parts.clear()
            linked = 0

    def text(start: int, end: int) -> None:
        nonlocal linked, unseen
        if start == end:
            return
        if hidden:
            unseen = unseen or not html[start:end].isspace()
        else:
            parts.append(html[start:end])
            linked += in_link * (end - start)

    def count(entry: tuple[str, int, bool, bool], by: int) -> None:
        nonlocal hidden, hinted, inside
        tag, signal, article, block = entry
        if by > 0:
            places.setdefault(tag, []).append(len(stack) - 1)
        else:
            places[tag].pop()
        if block and by > 0:
            blocks.append(len(stack) - 1)
        elif block:
            blocks.pop()
        hidden, hinted = hidden + by * (signal == 2), hinted + by * (signal == 1)
        if article:
            if inside + by == 0 or not inside:
                lines.append(EDGE)
            inside += by

    def pop_to(place: int) -> None:
        while len(stack) > place:
            count(stack.pop(), -1)

    at, n = 0, len(html)
    while at < n:
        m = _OPEN.search(html, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        tag = (m[2] or "").lower()
        if not tag:  # a comment, a declaration, a stray end
            comment = html.startswith("<!--", m.start())
            end = html.find("-->", m.start() + 2) if comment else html.find(">", m.end())
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        end = html.find(">", m.end())
        if end < 0:  # no tag is closed from here on
            text(m.start(), n)
            break
        rest = _REST.match(html, m.end())
        if not rest and (far := ends.find(m.end())) >= 0:
            end = far  # else a quote is not closed: the tag ends at the first >
        attributes, at = (rest[1], rest.end()) if rest else (html[m.end() : end], end + 1)
        block = tag not in _INLINE
        if m[1]:
            if tag == "a":
                in_link = False
            if block:
                flush()
            if places.get(tag):
                place = places[tag][-1]
                if block or not blocks or place > blocks[-1]:  # an inline end does not close blocks
                    pop_to(place)
            continue
        if tag in _RAW:
            found = None if tag in unclosed else _RAW[tag].search(html, at)
            if found:
                at = html.find(">", found.end()) + 1 or n
            elif tag in _RAW_TO_THE_END:
                at = n
            else:
                unclosed.add(tag)
            continue
        if tag == "a":
            in_link = True
        if block:
            flush()
            if stack and (stack[-1][0] == "p" or stack[-1][0] in _SIBLINGS.get(tag, ())):
                pop_to(len(stack) - 1)
        if tag in _VOID:
            if tag in _SPACED and not hidden:
                parts.append(" ")
            continue
        signal = _signal(tag, attributes, inside > 0)
        if tag in _SPACED and not hidden:
            parts.append(" ")
        if (block or signal == 2 or hidden) and not (attributes.endswith("/") and tag in ("svg", "math")):
            stack.append((tag, signal, tag in ("article", "main") and not hidden, block))
            count(stack[-1], 1)
    flush()
    return lines


def main_text(html: str | None, window: int = 3, surge: int = 80) -> str:
    """The text between the surge and dive points of a page; empty if there is none.

    A line is worth its characters outside links; half of that if a name hints at furniture; twice that in an article
    or main element and a quarter of it outside, on a page that has one with text. A window of lines worth nothing is
    a dive: a list of links without other text, furniture between two texts, the edge of an article. A run between
    dives is kept if a window in it is worth ``surge``, or as much as the page's best window where none is.
    """
    if not html:
        return ""
    lines = lines_of(html)
    marked = any(x.article for x in lines if x)
    plain = any(len(x.text) > x.linked for x in lines if x)  # else the page is links only, and they count
    texts: list[str] = []
    worth: list[float] = []
    inner: list[bool] = []
    for x in lines:
        if x is EDGE:
            texts.extend([""] * window)
            worth.extend([0.0] * window)
            inner.extend([False] * window)
        else:
            weight = (2.0 if x.article else 0.25 if marked else 1.0) * (0.5 if x.hinted else 1.0)
            texts.append(x.text)
            inner.append(x.article)
            worth.append(weight * (len(x.text) - x.linked * plain))
    sums = [sum(worth[i : i + window]) for i in range(len(worth))]
    least = min(surge, max(sums, default=0.0))
    if not least:
        return ""
    kept: list[str] = []
    start = 0
    while start < len(sums):
        if not sums[start]:
            start += 1
            continue
        stop = start
        while stop < len(sums) and sums[stop]:
            stop += 1
        if max(sums[start:stop]) >= least:
            while not worth[start] and not inner[start]:  # links that lead up to a text outside an article
                start += 1
            kept.extend(t for t in texts[start:stop] if t)
        start = stop
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: int = 80) -> DataFrame:
    """id_col, url_col, text and n_chars (code points) of every page.

    Null and empty html give the empty text; so do pages of furniture only. Character references are decoded, white
    space in a block is one space, blocks are joined by a line feed. Very long pages are read whole, in time that
    grows with their length. One row per input row, whatever its id or url; repeated rows give repeated rows, other
    columns are not read. An empty table gives an empty result.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 1024):
                texts = [main_text(h, window, surge) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
