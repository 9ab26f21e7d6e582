"""Main text of HTML pages by text-to-tag ratios.

The page streams through the standard library's parser. Its events end a line at
every block element; a line knows its characters, its tags and the container it
stands in, and lines inside menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out as they come. The ratio
of characters to tags per line is smoothed by a Gaussian, and lines above one
standard deviation of all ratios make the clusters that mark the content.

Ratios alone would drop short lines of an article and keep long ones around it,
so the clusters choose the region and the region gives the text: the outermost
`article` or `main` elements that hold a cluster (the longest, if none does);
without such elements, the smallest container that holds every cluster's lines,
with each h1 and the other headings and paragraphs that stand beside it or beside
a container around it, unless most of their text is links. All lines of the region
are kept, in page order.

A class, an id or a form is a weak sign: such an element may hold the whole page. A
class or id counts by its whole name only: every word of it must name another part
of a page or its place (`cookie-notice`, `sidebarLeft`; not `menu-layout`,
`post-header` or `social-history`). Its lines are left out at the end only, and
stay if it is around the page's `main` or, where there is none or nothing else in it,
its articles (those in the fewest such elements), or, on pages without, around an h1
and more text than is outside; if no line is left, the largest such text stays.

Every element knows what its content inherits, and positions of open elements are
kept by tag, so a page takes time and memory in proportion to its length, however
deep its elements are nested or left open.

Defined cases: a null or empty page, or one without any line, has an empty text
and no characters; unclosed and stray tags are closed with their parents; a page
without markup is one line; repeated rows are extracted each; an empty table gives
an empty result; extra columns are left out. Nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16  # characters that are fed at a time
SIGMA, RADIUS = 1.0, 2  # of the smoothing, in lines
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head script style noscript template nav footer aside button select option textarea input label fieldset iframe object "
    "svg canvas audio video dialog menu title".split()
)
ARTICLES = frozenset(("article", "main"))
# Open elements that a new one of the same kind closes, up to the list or table around them.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
ALIKE = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form alertdialog".split())
# Words of a class or id that name something other than the article, and words that only place or shape it.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs header "
    "masthead footer comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter "
    "subscribe subscription signup login popup modal overlay toolbar pagination pager skip".split()
)
PLACES = frozenset(
    "site global main primary secondary left right top bottom bar box block area section list item items unit slot container inner "
    "form link links button buttons icon icons text title label message post posts article articles story stories user".split()
)
HEADERS = frozenset("header site global main top bar".split())  # a header of anything else may hold the article's title
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]+")


def names_other(names: str, article: bool) -> bool:
    """Whether one of a class's or id's names is that of another part of the page; an article's headers are its own."""
    for name in names.split():
        words = set(WORD.findall(HUMP.sub("-", name).lower()))
        if "header" in words:
            if not article and words <= HEADERS:
                return True
        elif not MARKS.isdisjoint(words) and words <= MARKS | PLACES:
            return True
    return False


class Element(NamedTuple):
    """An open element and what its content inherits; 0 stands for none."""

    tag: str = ""
    number: int = 0
    dropped: bool = False
    mark: int = 0  # innermost marked element
    box: int = 0  # innermost container
    article: int = 0  # outermost article or main
    main: int = 0  # innermost main
    linked: bool = False


class Line(NamedTuple):
    """A line that may be content, with the tags since the line before."""

    text: str
    tags: int
    box: int
    article: int
    beside: int  # the container around a heading (the page for an h1) or paragraph; -1 for other lines and for links


class PageLines(HTMLParser):
    """Collects the lines of a page, their containers and the marked elements around their pieces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int, bool]], int, Element, int]] = []  # pieces, tags, innermost element, beside
        self.parts: list[tuple[str, int, bool]] = []  # text, mark, whether it is a link's
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}  # positions in `open` by tag
        self.blocks: list[int] = []  # positions of block elements
        self.boxes, self.last = [0], [0]  # by number: the container around an element, the last number inside it
        self.marks = {0: (0, 0)}  # the mark around a mark, how many there are
        self.mains: list[tuple[int, int, int]] = []  # number, main around it, mark
        self.inner: list[tuple[int, int]] = []  # of articles: main around it, mark
        self.titles: list[int] = []  # marks around an h1
        self.tags = 0

    def _top(self) -> Element:
        return self.open[-1] if self.open else Element()

    def _end_line(self) -> None:
        if any(text and not text.isspace() for text, *_ in self.parts):
            top, block = self._top(), self.open[self.blocks[-1]].tag if self.blocks else ""
            beside = 0 if block == "h1" else self.boxes[top.box] if block in HEADINGS else top.box if block == "p" else -1
            self.lines.append((self.parts, self.tags, top, beside))
            self.parts, self.tags = [], 0
        self.parts.clear()

    def _unwanted(self, tag: str, attrs: list[tuple[str, str | None]], article: bool) -> bool:
        if tag in DROPPED or tag == "header" and not article:
            return True
        if tag in ("html", "body", *ARTICLES) and not article:
            return False
        return any(name == "hidden" or name == "role" and (value or "").strip().lower() in ROLES for name, value in attrs)

    def _has_mark(self, tag: str, attrs: list[tuple[str, str | None]], article: bool) -> bool:
        if tag == "form":
            return True
        if tag in ("html", "body", *ARTICLES) and not article:
            return False
        return any(name in ("class", "id") and names_other(value or "", article) for name, value in attrs)

    def _with_outer(self, marks: Iterable[int]) -> set[int]:
        """Marks and all that are around them."""
        found = {0}
        for mark in marks:
            while mark not in found:
                found.add(mark)
                mark = self.marks[mark][0]
        return found

    def _fewest(self, marks: list[int]) -> list[int]:
        """Those that the fewest marked elements are around."""
        least = min((self.marks[m][1] for m in marks), default=0)
        return [m for m in marks if self.marks[m][1] == least]

    def _stays(self) -> set[int]:
        """The marked elements whose own lines are content all the same, and none."""
        sizes: dict[int, int] = {}
        for pieces, *_ in self.lines:
            for text, mark, _ in pieces:
                sizes[mark] = sizes.get(mark, 0) + len(text.strip())
        around = self._fewest([mark for *_, mark in self.mains])
        chosen: set[int] = set()  # mains in the fewest marked elements and the mains inside them
        for number, outer, mark in self.mains:
            if mark in around or outer in chosen:
                chosen.add(number)
        left = self._with_outer(around)
        if not self.mains or not any(n for mark, n in sizes.items() if mark in left):
            around += self._fewest([mark for main, mark in self.inner if main in chosen or not self.mains])
        if not around:
            around = [mark for mark in self.titles if sizes.get(mark, 0) > sizes.get(0, 0)]
        stays = self._with_outer(around)
        if sizes and not any(n for mark, n in sizes.items() if mark in stays):
            stays |= self._with_outer([max(sizes, key=sizes.get)])
        return stays

    def content(self) -> list[Line]:
        """The lines that may be content; tags of others count for the next line."""
        stays, lines, before = self._stays(), [], 0
        for pieces, tags, top, beside in self.lines:
            kept = [(text, linked) for text, mark, linked in pieces if mark in stays]
            text = " ".join("".join(text for text, _ in kept).split())
            before += tags
            if text:
                links = sum(len(text.strip()) for text, linked in kept if linked)
                lines.append(Line(text, max(before, 1), top.box, top.article, -1 if 2 * links > len(text) else beside))
                before = 0
        return lines

    def _close(self, at: int) -> None:
        for element in self.open[at:]:
            self.last[element.number] = len(self.last) - 1
            self.places[element.tag].pop()
            if element.tag in BLOCKS:
                self.blocks.pop()
        del self.open[at:]

    def _place(self, tags: Iterable[str]) -> int:
        """Position of the innermost open element with one of these tags, -1 without."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def _open(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        top, number = self._top(), len(self.last)
        self.boxes.append(top.box)
        self.last.append(number)
        inside, mark, article, main = bool(top.article), top.mark, top.article, top.main
        dropped = top.dropped or self._unwanted(tag, attrs, inside)
        if not dropped:
            if self._has_mark(tag, attrs, inside):
                self.marks[number] = (mark, self.marks[mark][1] + 1)
                mark = number
            if tag in ARTICLES:
                article = article or number
            if tag == "main":
                self.mains.append((number, main, mark))
                main = number
            elif tag == "article":
                self.inner.append((main, mark))
            elif tag == "h1":
                self.titles.append(mark)
        self.places.setdefault(tag, []).append(len(self.open))
        box = top.box
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
            box = box if tag == "p" else number
        self.open.append(Element(tag, number, dropped, mark, box, article, main, top.linked or tag == "a"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            if tag not in ("option", "title"):
                self._close_paragraph()
            if around := SIBLINGS.get(tag):
                same = self._place(ALIKE.get(tag, (tag,)))
                if same > self._place(around):
                    self._close(same)
        elif tag == "br":
            self.parts.append((" ", self._top().mark, False))
        if tag not in VOID:
            self._open(tag, attrs)

    def _close_paragraph(self) -> None:
        """A block ends an open paragraph, with what is open inside it."""
        if self.blocks and self.open[self.blocks[-1]].tag == "p":
            self._close(self.blocks[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:  # in HTML a slash does not close a block
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        at = self._place((tag,))
        inline = tag not in BLOCKS  # closes nothing beyond its block
        if at >= 0 and not (inline and self.blocks and self.blocks[-1] > at):
            self._close(at)

    def handle_data(self, data: str) -> None:
        top = self._top()
        if not top.dropped:
            self.parts.append((data, top.mark, top.linked))

    def finish(self) -> None:
        self.close()
        self._end_line()
        self._close(0)
        self.last[0] = len(self.last) - 1


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Ratios under a Gaussian; the ends repeat themselves."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), "valid")


def content_lines(lines: list[Line], boxes: list[int], last: list[int]) -> list[str]:
    """The lines of the region that the clusters of high ratios choose.

    By number, `boxes` holds the container around an element and `last` the last number inside it.
    """
    if not lines:
        return []
    smooth = smoothed(np.array([len(line.text) / line.tags for line in lines]))
    clusters = [lines[i] for i in np.flatnonzero(smooth >= smooth.std())]
    if any(line.article for line in lines):
        chosen = {line.article for line in clusters} - {0}
        if not chosen:
            sizes: dict[int, int] = {}
            for line in lines:
                if line.article:
                    sizes[line.article] = sizes.get(line.article, 0) + len(line.text)
            chosen = {max(sizes, key=sizes.get)}
        return [line.text for line in lines if line.article in chosen]
    region = clusters[0].box
    low, high = min(line.box for line in clusters), max(line.box for line in clusters)
    while not region <= low <= high <= last[region]:
        region = boxes[region]
    outer, box = {0} if region else set(), boxes[region]
    while box:
        outer.add(box)
        box = boxes[box]
    return [line.text for line in lines if region <= line.box <= last[region] or line.beside in outer]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, joined by newlines."""
    if not html:
        return ""
    page = PageLines()
    for at in range(0, len(html), CHUNK):
        page.feed(html[at : at + CHUNK])
    page.finish()
    return "\n".join(content_lines(page.content(), page.boxes, page.last))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                texts = [main_text(html.as_py()) for html in piece.column("html")]
                columns = [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(batches, "page_id long, url string, text string, n_chars long")
