"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

A page is fed, whole, to the standard library's streaming parser. Its events make lines: the text between two block boundaries, with the
number of tags met and the elements it stands in. The text-to-tag ratios of all lines, boilerplate too, are smoothed over the page with a
Gaussian kernel; the threshold that best splits their logarithms in two clusters separates content from menus, links and markup. Where
the clusters lie close together, all lines are content.

The clusters select the region. It is the smallest element with ``MOST`` of the content; it grows to the ``article`` or ``main`` around it,
or else to elements that add only headings and further content. Where the region holds several marked elements, those that are mostly
content are kept; where it holds unmarked ones only, of every container that is not mostly content nothing is kept. Inside what is kept
all lines stay, so that short headings and paragraphs do, but for those of elements that never hold main text (menus, headers, footers,
sidebars, scripts, styles by element or role). A form, and an element whose class or id names a notice, an advert, a sidebar or comments,
is doubted: it goes unless the clusters find it to be content and it holds most of the region, or an article.

Inside a line, character references are decoded and white space becomes one space; lines are joined in page order by a newline.

Defined cases: null or empty html, or a page without text, gives an empty text; unclosed elements end with their parents or the page;
equal pages, and rows that share an id, give a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import slices

#: Elements of HTML by role.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object audio video canvas head title".split())
BOILERPLATE = frozenset("nav footer aside button select textarea menu dialog input search".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INNER = HEADINGS | frozenset("p li b i em strong span a".split())
UNWANTED = frozenset("ad ads advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus replies respond pagination pager toolbar masthead skip login widget".split())
#: Words that may stand beside an unwanted one in a class or id; with any other word (has-sidebar, social-science) it tells nothing.
NEUTRAL = frozenset("area bar block bottom box container content footer global group header inner item items left link links list main outer page panel post posts primary right row secondary section site slot top unit wrap wrapper".split())
#: Share of the content that the region holds; and times by which the ratios of the upper cluster exceed those of the lower one, at least.
MOST, APART = 0.9, 3.0
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "parent", "silent", "unwanted", "doubtful", "marked", "number")

    def __init__(self, tag: str, parent: _Node | None, silent: bool, unwanted: bool, doubtful: bool, marked: _Node | None, number: int):
        self.tag, self.parent, self.silent, self.unwanted, self.doubtful, self.number = tag, parent, silent, unwanted, doubtful, number
        self.marked = marked if marked is not None or tag not in ("article", "main") else self  # outermost article around it


class _Line:
    __slots__ = ("text", "tags", "node", "size", "heading")

    def __init__(self, text: str, tags: int, node: _Node):
        self.text, self.tags, self.node, self.size, self.heading = text, tags, node, len(text), False
        while node.parent is not None and node.tag in INNER:
            self.heading |= node.tag in HEADINGS
            node = node.parent
        self.node = node


class _Lines(HTMLParser):
    """Lines in page order."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.made = 0
        self.node = _Node("", None, False, False, False, None, 0)
        self.parts: list[str] = []
        self.tags = 0

    def _end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append(_Line(text, self.tags, self.node))
            self.tags = 0
        self.parts = []

    def _is_unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in BOILERPLATE or (tag == "header" and self.node.marked is None):
            return True
        for name, value in attrs:
            if name == "role" and value and value.strip().lower() in ROLES:
                return True
            if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
                return True
        return False

    def _is_doubtful(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether it is a form, or a class or id has an unwanted word, and beside it neutral words only."""
        if tag == "form" or any(key == "role" and value == "form" for key, value in attrs):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        names = (name for key, value in attrs if key in ("class", "id") and value for name in value.split())
        return any((parts := {w.lower() for w in _WORD.findall(name)}) & UNWANTED and parts <= UNWANTED | NEUTRAL for name in names)

    def _pop_to(self, tag: str, stop: frozenset[str] = frozenset()) -> None:
        node = self.node
        while node.parent is not None and node.tag != tag:
            if node.tag in stop:
                return
            node = node.parent
        if node.parent is not None:
            self.node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        if tag in CLOSES_P:
            self._pop_to("p", frozenset(("article", "main", "section", "div", "td", "li", "body", "blockquote")))
        if tag == "li":
            self._pop_to("li", frozenset(("ul", "ol", "menu", "article", "main", "nav")))
        if tag in VOID:
            return
        self.made += 1
        parent = self.node
        self.node = _Node(tag, parent, parent.silent or tag in SILENT, parent.unwanted or self._is_unwanted(tag, attrs), self._is_doubtful(tag, attrs), parent.marked, self.made)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        self._pop_to(tag, frozenset(("article", "main", "body")) - {tag} if tag not in ("html", "body", "article", "main") else frozenset())

    def handle_data(self, data: str) -> None:
        if not self.node.silent:
            self.parts.append(data)

    def finish(self) -> list[_Line]:
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Convolution with a Gaussian kernel; at the ends the kernel's part on the page counts alone."""
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    near = lambda x: np.convolve(np.pad(x, radius), kernel, mode="valid")
    return near(ratios) / near(np.ones_like(ratios))


def threshold(values: np.ndarray) -> float:
    """The cut into two clusters with the least squares within them."""
    ordered = np.sort(values)
    if len(ordered) < 2 or ordered[0] == ordered[-1]:
        return float(ordered[0]) if len(ordered) else 0.0
    n = np.arange(1, len(ordered))
    low, square = np.cumsum(ordered)[:-1], np.cumsum(ordered**2)[:-1]
    total, squares = ordered.sum(), (ordered**2).sum()
    within = square - low**2 / n + (squares - square) - (total - low) ** 2 / (len(ordered) - n)
    k = int(np.argmin(within))
    return float((ordered[k] + ordered[k + 1]) / 2)


def contents(lines: list[_Line]) -> np.ndarray:
    """For each line, whether its smoothed text-to-tag ratio lies in the upper cluster."""
    values = np.log1p(smoothed(np.array([x.size / max(1, x.tags) for x in lines])))
    upper = values >= threshold(values)
    if upper.all() or values[upper].mean() - values[~upper].mean() < np.log(APART):
        return np.ones(len(lines), bool)
    return upper


def _around(node: _Node | None) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


def _masses(lines: list[_Line], content: np.ndarray) -> tuple[dict[int, _Node], Counter[int], Counter[int], Counter[int]]:
    """By number of an element: the element, its text, its content, and its text that is neither content nor a heading."""
    own: dict[int, list] = {}
    for x, c in zip(lines, content.tolist(), strict=True):
        held = own.setdefault(x.node.number, [x.node, 0, 0, 0])
        held[1] += x.size
        held[2] += x.size * c
        held[3] += x.size * (not c and not x.heading)
    nodes: dict[int, _Node] = {}
    sums: tuple[Counter[int], Counter[int], Counter[int]] = (Counter(), Counter(), Counter())
    for node, *_ in own.values():
        for outer in _around(node):
            if outer.number in nodes:
                break
            nodes[outer.number] = outer
    for number, (_, *sizes) in own.items():
        for total, size in zip(sums, sizes, strict=True):
            total[number] += size
    # Elements have greater numbers than those around them, so one pass from the last to the first adds all up.
    for number in sorted(nodes, reverse=True):
        parent = nodes[number].parent
        if parent is not None:
            for total in sums:
                total[parent.number] += total[number]
    return nodes, *sums


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    content = contents(lines)
    # Boilerplate by element has its part in the clusters, and none in the region.
    kept = [k for k, x in enumerate(lines) if not x.node.unwanted]
    lines, content = [lines[k] for k in kept], content[kept]
    if not lines:
        return ""
    if not content.any():
        content = np.ones(len(lines), bool)
    nodes, text, good, rest = _masses(lines, content)
    region = nodes[max(k for k in nodes if good[k] >= MOST * good[0])]
    if region.marked is not None:
        region = region.marked
    else:
        for outer in _around(region.parent):
            if rest[outer.number] == rest[region.number]:
                region = outer
    inside: dict[int, bool] = {}
    for number in sorted(nodes):  # outer elements come first
        node = nodes[number]
        inside[number] = node is region or (node.parent is not None and inside[node.parent.number])
    marked = {x.node.marked.number for x in lines if x.node.marked is not None and inside[x.node.number]} if region.marked is None else set()
    # A doubted element around a marked one stays, but for that of a mark beside others which nothing doubts.
    doubts = {number: any(k.doubtful for k in _around(nodes[number])) for number in marked}
    article = set()
    for number in marked:
        if not doubts[number] or all(doubts.values()):
            article.update(k.number for k in _around(nodes[number]))
    if region.marked is not None:
        article.update(k.number for k in _around(region))
    dropped: dict[int, bool] = {}
    for number in sorted(nodes):
        node = nodes[number]
        real = 2 * good[number] >= text[number]
        gone = node.doubtful and number not in article and not (real and 2 * text[number] > text[region.number])
        dropped[number] = gone or (node.parent is not None and dropped[node.parent.number])
    found = [x for x in lines if inside[x.node.number] and not dropped[x.node.number]]
    if region.marked is None:
        unit = (lambda x: x.node.marked.number if x.node.marked is not None else -1) if marked else (lambda x: x.node.number)
        content_of, text_of = Counter(), Counter()
        for x, c in zip(lines, content.tolist(), strict=True):
            content_of[unit(x)] += x.size * c
            text_of[unit(x)] += x.size
        content_of[-1] = -1
        best = max((unit(x) for x in found), key=lambda k: content_of[k], default=-1)
        found = [x for x in found if unit(x) == best or 2 * content_of[unit(x)] >= text_of[unit(x)]]
    return "\n".join(x.text for x in found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 4 << 20):
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
