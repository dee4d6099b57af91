"""Main text of web pages.

The standard library's streaming parser turns a page into lines, one for each
block of text, with the number of tags seen since the last line. The ratio of
text to tags per line is smoothed with a Gaussian; lines above a threshold are
clusters of content. Tags and roles of menus, forms, asides and the like leave out
their blocks before that, and so do comment sections and adverts; a name that
such blocks often have lowers a line's ratio, so that it is content only where it
carries the page. The articles and mains that hold clustered text are the region, if
they hold half of it; else it is the smallest element that holds all of it. Its
blocks are the main text, but for those that only their names or their links
tell from it; a heading before the region and what follows it, and the elements
beside the region and after its start, belong to it.

A line knows the element it stands in, and an element the one around it, so a
page takes time and memory in proportion to its length, however deep it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import table

#: Elements of HTML by role (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math object iframe select textarea button canvas audio video".split())
LEFT_OUT = frozenset("nav header footer aside form menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open <p>, and those that end an open one of their own kind.
ENDS_P = BLOCK
SAME_KIND = frozenset("p li dt dd tr td th option".split())
#: Words of class and id names that mark a block as no main text.
NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header login "
    "masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names that leave out a block wherever it stands, as a word of a name, and as a whole one.
COMMENTS = frozenset("comment comments disqus".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored promo promoted".split())
#: What is left of a line's ratio if its block has one of NAMES.
DOUBT = 0.25
#: Share of its characters in links from which a line that isn't clustered is a menu's.
LINKED = 0.6
#: Elements that can be the region, and those that the region is widened to.
CONTAINER = frozenset("article body center details div dl html main ol section table tbody td tr ul".split())
WHOLE = frozenset(["article", "main"])


#: What is said against a block: nothing, a name of its class or id, its tag, role, or a name that decides.
KEPT, BY_NAME, OUT = 0, 1, 2


class _Line(NamedTuple):
    """`tags` before it since the last line; what is said `against` it; the container it stands `at`."""

    text: str
    tags: int
    against: int
    at: int
    title: bool
    linked: bool


class _Lines(HTMLParser):
    """Lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: open elements: tag, number of the nearest container, what is said against it, hidden
        self.open: list[tuple[str, int, int, bool]] = []
        self.lines: list[_Line] = []
        self.text: list[str] = []
        #: by a container's number the one around it; 0 is the page
        self.around: list[int] = [0]
        self.whole: set[int] = set()
        #: open elements by tag, and open blocks, so that a search that would fail isn't made
        self.count: Counter[str] = Counter()
        self.tags = self.links = 0

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if line:
            tag, container, against, _ = self.open[-1] if self.open else ("", 0, KEPT, False)
            self.lines.append(_Line(line, self.tags, against, container, self.count["h1"] > 0, self.links > LINKED * len(line)))
            self.tags = self.links = 0

    def _against(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        inside = self.count["article"] or self.count["main"]
        if tag in LEFT_OUT:
            return KEPT if tag == "header" and self.count["article"] else OUT
        against = KEPT
        for name, value in attrs:
            if name == "role" and (value or "").lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return OUT
            if name in ("class", "id") and tag not in ("html", "body", "main") and value:
                names = value.lower().split()
                words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
                if COMMENTS.intersection(names) or COMMENTS & words and tag not in ("p", "span", "a") or ADVERTS.intersection(names):
                    return OUT
                if tag != "article" and not inside and NAMES & words:
                    against = BY_NAME
        return against

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            self._end_p(tag)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, container, against, hidden = self.open[-1] if self.open else ("", 0, KEPT, False)
        if tag in CONTAINER:
            self.around.append(container)
            container = len(self.around) - 1
            if tag in WHOLE:
                self.whole.add(container)
        self.open.append((tag, container, max(against, self._against(tag, attrs)), hidden or tag in HIDDEN))
        self.count[tag] += 1

    def _close(self, at: int) -> None:
        """The open element `at` ends, and those in it."""
        self.count.subtract(x[0] for x in self.open[at:])
        del self.open[at:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _end_p(self, tag: str) -> None:
        """A block ends an open <p>; an item or cell ends the open one of its kind."""
        if not self.count["p"] and not (tag in SAME_KIND and self.count[tag]):
            return
        for i in range(len(self.open) - 1, -1, -1):
            t = self.open[i][0]
            if t == "p" or t == tag and tag in SAME_KIND:
                self._close(i)
                return
            if t in BLOCK:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return
            if self.open[i][0] in BLOCK and tag not in BLOCK:
                return  # the end of an inline element that another block began

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][3]):
            self.text.append(data)
            if self.count["a"]:
                self.links += len(data.strip())


def _lines(html: str) -> _Lines:
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"<(?:[a-zA-Z/!?]|$)", html[cut:]):
        html = html[:cut]  # a tag that the page's end cuts off
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the weights beyond the ends are left out."""
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    own = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    return own / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Blocks of the main text, one on each line; empty if there are none."""
    page = _lines(html or "")
    lines = [line for line in page.lines if line.against != OUT]
    return "\n".join(line.text for line, kept in zip(lines, chosen(lines, page.around, page.whole, sigma), strict=True) if kept)


def clustered(lines: list[_Line], sigma: float) -> np.ndarray:
    """Which lines are content by their ratio of text to tags and that of the lines around them."""
    ratios = np.array([len(x.text) / max(1, x.tags) * (DOUBT if x.against else 1) for x in lines])
    near = smoothed(ratios, sigma)
    near = np.where([x.against > KEPT for x in lines], np.minimum(near, ratios), near)  # a doubtful line isn't lifted by its neighbours
    return near >= 0.5 * near.mean()


def chosen(lines: list[_Line], around: list[int], whole: set[int], sigma: float) -> np.ndarray:
    """Which lines are main text. A container's number is larger than those of the ones around it."""
    if not lines:
        return np.zeros(0, bool)
    content = clustered(lines, sigma)
    at = np.array([x.at for x in lines])
    sizes = np.array([len(x.text) for x in lines], float) * content
    held, count = np.zeros(len(around)), np.zeros(len(around), np.int64)
    np.add.at(held, at, sizes)
    np.add.at(count, at, 1)
    for element in range(len(around) - 1, 0, -1):  # what is in a container is in the one around it
        held[around[element]] += held[element]
        count[around[element]] += count[element]
    articles = np.zeros(len(around), bool)  # articles and mains with clustered text, and what is in them
    for element in range(1, len(around)):
        articles[element] = articles[around[element]] or element in whole and held[element] > 0
    if sizes[articles[at]].sum() >= 0.5 * sizes.sum():
        inside = articles[at]
        if not any(x.title and i for x, i in zip(lines, inside, strict=True)):
            inside |= _titled(lines, int(inside.argmax()))
        return inside
    region = int(np.flatnonzero(held >= held[0])[-1])
    if region and count[region] == 1:  # one block that holds everything stands for the element around it
        region = around[region] or region
    within = np.zeros(len(around), bool)
    within[region] = True
    for element in range(region + 1, len(around)):
        # beside the region: in an element that comes after it and has the same one around it
        within[element] = within[around[element]] or region > 0 and around[element] == around[region]
    inside = within[at]
    kept = inside & (content | np.array([x.against == KEPT and not x.linked for x in lines]))
    return kept | _titled(lines, int(content.argmax()))


def _titled(lines: list[_Line], first: int) -> np.ndarray:
    """The last title before a line, and the blocks between them."""
    out = np.zeros(len(lines), bool)
    title = max((k for k in range(first) if lines[k].title and lines[k].against == KEPT), default=first)
    out[title:first] = [x.against == KEPT and not x.linked for x in lines[title:first]]
    return out


def extracted(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages`. A null page
    counts as empty; a page without main text gives an empty text. Repeated
    rows, null ids and urls each keep their row; other columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), sigma) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
