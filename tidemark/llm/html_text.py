"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams a page's events into lines, one a block.
A line's ratio is its characters outside links per tag.  What tags, classes or
roles say of a line (menu, advert, form, notice, comments; article, main) only
weighs its ratio.  The ratios are smoothed with a Gaussian among neighbours that
are marked alike, and split in two clusters at the threshold that parts the
logarithms of one plus the ratio best: the upper one is content.  The element
that holds nearly all ratio of content lines, with headings and blocks beside
it, is the content region.  In it, lines that nothing marks stay, short ones
too; marked ones only if they are content by their ratio.

One pass without a shuffle; a page is parsed by itself, in time and memory
proportional to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_of, slices, small_batches

#: Smoothing, in lines, and the share of content lines' ratio that the region's element holds at least.
SIGMA = 1.0
HELD = 0.9
#: What the ratio of a marked line, and of one in an article, is multiplied by.
MARKED = 1 / 32
ARTICLE = 4.0
#: Below this ratio a line is but links and tags, and isn't smoothed with text.
LINKS = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search"
    " section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("head title script style noscript template iframe object svg canvas math audio video map".split())
ASIDE = frozenset("nav aside footer form button select textarea dialog menu datalist search input".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav"
    " navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies reply cookie"
    " cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing"
    " social related recommended recommendations widget toolbar pagination pager login signup search skip"
    " complementary contentinfo".split()
)
#: Elements that hold text rather than sections: a region isn't one of them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption b i em strong span a font u small".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an open element of the same kind is closed by, without an end tag of its own.
CLOSES = {
    **dict.fromkeys(BLOCK - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot"}, ("p",)),
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("option",),
    "tr": ("td", "th", "tr", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
}
#: Elements that an implied or stray end doesn't reach beyond; for p any block but p.
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "option": ("select",)}

_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Lines(HTMLParser):
    """Collects the page's lines, and of every element its tag, parent and what marks it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent = [""], [-1]
        self.own = [False]  # marked by its own tag or attributes
        self.never, self.article, self.link = [False], [False], [False]  # here or further out
        self.open = [0]
        self.block = [0]  # for each open element, the place in ``open`` of the innermost block but p
        self.places: dict[str, list[int]] = {}  # by tag, the places in ``open``
        self.lines: list[tuple[str, float, int]] = []  # text, ratio, element
        self.pieces: list[str] = []
        self.plain, self.tags = 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append((text, min(self.plain, len(text)) / max(1, self.tags), self.open[-1]))
            self.plain, self.tags = 0, 0
        self.pieces = []

    def close_open(self, tag: str) -> None:
        """End the innermost open element of this tag, with all inside it, unless a fence is between."""
        own = self.places.get(tag)
        if not own:
            return
        if tag == "p":
            fence = self.block[-1]
        else:
            fence = max((self.places[f][-1] for f in FENCE.get(tag, ()) if self.places.get(f)), default=0)
        at = own[-1]
        if at > fence:
            for element in reversed(self.open[at:]):
                self.places[self.tag[element]].pop()
            del self.open[at:], self.block[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            for other in CLOSES.get(tag, ()):
                self.close_open(other)
        elif tag == "br":
            self.pieces.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        up = self.open[-1]
        marked = tag in ASIDE or tag == "header" and not self.article[up]
        if attrs and not marked and tag not in ("html", "body", "main"):
            for name, value in attrs:
                if name == "hidden" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                    marked = True
                elif name in ("class", "id", "role") and value and not HINTS.isdisjoint(w.lower() for w in _TOKENS.findall(value)):
                    marked = True
        self.tag.append(tag)
        self.parent.append(up)
        self.own.append(marked)
        self.never.append(tag in NEVER or self.never[up])
        self.article.append(tag in ("article", "main") or self.article[up])
        self.link.append(tag == "a" or self.link[up] and tag not in BLOCK)
        self.places.setdefault(tag, []).append(len(self.open))
        self.block.append(len(self.open) if tag in BLOCK and tag != "p" else self.block[-1])
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag not in VOID:
            self.close_open(tag)

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        if not self.never[at]:
            self.pieces.append(data)
            if not self.link[at]:
                self.plain += len(data)


    def marked(self) -> list[bool]:
        """Which elements are marked, by themselves or further out.

        If every article is inside a marked element, that element lacks its end
        tag: its mark ends at the articles.
        """
        found = list(self.own)
        for i in range(1, len(found)):
            found[i] = found[i] or found[self.parent[i]]
        tops = [i for i, t in enumerate(self.tag) if t in ("article", "main") and not self.article[self.parent[i]]]
        if tops and all(found[i] for i in tops):
            for i in range(tops[0], len(found)):
                if self.article[i]:
                    found[i] = self.own[i] or self.article[self.parent[i]] and found[self.parent[i]]
        return found


def smoothed(values: np.ndarray, alike: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means of values over the neighbours up to 2 sigma away in the same run of equal ``alike``."""
    n = len(values)
    run = np.concatenate([[0], np.cumsum(alike[1:] != alike[:-1])])
    total, weight = values.copy(), np.ones(n)
    for k in range(1, min(int(np.ceil(2 * sigma)), n - 1) + 1):
        w = np.exp(-0.5 * (k / sigma) ** 2) * (run[k:] == run[:-k])
        total[k:] += w * values[:-k]
        total[:-k] += w * values[k:]
        weight[k:] += w
        weight[:-k] += w
    return total / weight


def threshold(ratios: np.ndarray) -> float:
    """The least ratio of the upper of two clusters: the split of the sorted logarithms with most variance between."""
    x = np.sort(np.log1p(ratios))
    if len(x) < 2 or x[0] == x[-1]:
        return 0.0
    k = np.arange(1, len(x))
    low = np.cumsum(x)[:-1] / k
    high = (x.sum() - np.cumsum(x)[:-1]) / (len(x) - k)
    cut = int(np.argmax(np.where(x[1:] > x[:-1], k * (len(x) - k) * (high - low) ** 2, -1.0)))
    return float(np.expm1(x[cut + 1])) * (1 - 1e-9)


def content_lines(page: Lines, marks: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The page's line ratios, weighed and smoothed, and which of them are content."""
    at = np.array([line[2] for line in page.lines])
    marked, article = np.array(marks)[at], np.array(page.article)[at]
    own = np.array([line[1] for line in page.lines])
    alike = marked * 4 + article * 2 + (own < LINKS)
    ratio = smoothed(own * np.where(marked, MARKED, 1.0) * np.where(article, ARTICLE, 1.0), alike, SIGMA)
    return ratio, ratio >= threshold(ratio)


def region_of(page: Lines, marks: list[bool], ratio: np.ndarray, content: np.ndarray) -> int:
    """The element that is the content region; 0 or body if the page has none of its own."""
    tag, parent = page.tag, page.parent
    held = np.zeros(len(tag))
    texts_beside = [False] * len(tag)  # elements with an unmarked heading or paragraph of their own
    for (_, _, at), r, good in zip(page.lines, ratio, content, strict=True):
        if good:
            held[at] += r
        if tag[at] in HEADING or tag[at] == "p":
            texts_beside[parent[at]] |= not marks[at]
    for i in range(len(tag) - 1, 0, -1):  # elements are numbered as they open: children after parents
        held[parent[i]] += held[i]
    root = int(np.flatnonzero(held >= HELD * held[0])[-1]) if held[0] > 0 else 0
    up = root
    while up > 0 and tag[up] not in ("article", "main"):
        up = parent[up]
    if up > 0:
        return up
    while root > 0 and (tag[root] in TEXT or texts_beside[parent[root]]) and tag[root] not in ("body", "html"):
        root = parent[root]
    return root


def main_text(html: str) -> str:
    """The page's main text, a line a block; empty if it has none."""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    marks = page.marked()
    ratio, content = content_lines(page, marks)
    root = region_of(page, marks, ratio, content)
    inside = [False] * len(page.tag)
    for i in range(root, len(page.tag)):
        inside[i] = i == root or inside[page.parent[i]]
    kept = [k for k, (_, _, at) in enumerate(page.lines) if inside[at] and (content[k] or not marks[at])]
    if page.tag[root] in ("", "body", "html"):
        # No element of its own: what stands before the heading and the first content line isn't the article's.
        first = next((k for k in kept if content[k] or page.tag[page.lines[k][2]] == "h1"), 0)
        kept = [k for k in kept if k >= first]
    return "\n".join(page.lines[k][0] for k in kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text and n_chars (code points).

    A null or empty page, and one without text, has the empty text.  Repeated
    rows stay; null ids and urls stay null; an empty table gives no rows.  A
    very long page is one row of one task and takes a few times its own length
    of memory.  Other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [main_text(h) if h else "" for h in column_of(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [column_of(part, "page_id"), column_of(part, "url"), pa.array(found, pa.string()), pa.array([len(f) for f in found], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(texts, schema)
