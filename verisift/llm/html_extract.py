"""Main text of web pages: streamed parser events, text-to-tag ratio of lines, Gaussian smoothing, threshold clustering.

The standard library's parser feeds events one by one. A block-level tag ends a line; a line knows its text, how many
tags it holds, how much of it is link text and in which elements it lies. The ratio of a line is its characters outside
links over its tags (at least one); lines of elements that are never article text (menus, footers, sidebars, scripts,
styles, form controls; boxes whose class or id says advert, notice, comment and the like) have the ratio 0. The ratios
of the whole page, in order, are smoothed with a Gaussian; lines at or above a threshold (a share of the standard
deviation) are content, and neighbouring content lines are a cluster.

The heaviest cluster elects the content region: if ``article`` (else ``main``) elements hold half of it, the one
that holds most, so of several articles the one with the running text; on pages without, the lowest element around the cluster, widened to an outer
element if that adds the headline, or clusters of a quarter of the mass (half, if it has the headline). The region's lines are kept whole, short
paragraphs too, without those of ratio 0 by element or name; in a region found without ``article`` boxes and links ahead of
the first or behind the last cluster go as well. Names set a box aside only if it does not hold the page: a box around the headline
or an article, or a form around half of the text, is a wrapper. Words that an article's own boxes carry too (header,
discussion, legal) set a box aside only outside the region.

Defined results: null, empty or wholly set-aside pages give the empty text; broken markup is read as the parser reads it
(an unclosed script or style swallows the rest); repeated rows give equal texts; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by role. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav footer aside script style noscript template head title iframe object svg canvas button select option textarea dialog menu".split())
RAW = frozenset("script style".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Words of a class or id that mark a box beside the article, wherever it stands. Fixed values.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored cookie cookies gdpr popup newsletter subscribe signup login "
    "promo promos promotion promotions banner consent notice notices modal overlay navbar breadcrumb breadcrumbs masthead footer sidebar comment comments respond disqus pagination pager".split()
)
#: Words that mark such a box only outside the content region: an article's own parts carry them too. Fixed values.
PERHAPS = frozenset(
    "nav navigation menu menus header aside widget widgets related recommend recommended recommendation recommendations trending share sharing social replies discussion search toolbar skip tag tags copyright legal disclaimer".split()
)
#: Words before which a name says what a box has, or whose part it is. Fixed values.
HAS, OWN = frozenset("has no with without not".split()), frozenset("entry post article".split())
#: Elements that are no content region: parts of one.
PARTS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split())
SPACE = re.compile(r"\s+")
#: An element's end implies the end of these when they are still open inside another of their kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


PLAIN, DOUBT, SOFT, HARD = range(4)


@dataclass
class Line:
    text: str
    tags: int
    links: int  # characters of link text
    path: tuple[int, ...]  # open elements, outermost first
    aside: bool = False
    doubt: bool = False  # in a box that is set aside outside the content region

    @property
    def chars(self) -> int:
        return max(0, len(self.text) - self.links)


@dataclass
class Element:
    name: str
    number: int
    mark: int
    holds: bool = False  # the headline or an article


@lru_cache(1 << 14)
def named(names: str) -> int:
    """What a class and id say of a box."""
    out = PLAIN
    for token in names.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)]
        if HAS.intersection(words):
            continue
        if BESIDE.intersection(words):
            return SOFT
        if PERHAPS.intersection(words) and not ("header" in words and OWN.intersection(words)):
            out = DOUBT
    return out


class Lines(HTMLParser):
    """Parser events -> lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.all: list[Element] = []
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.links = 0

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.links, tuple(e.number for e in self.open)))
            self.tags = 0
        self.text, self.links = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.end_line()
            return
        if tag not in INLINE:
            self.end_line()
            if tag in ENDS_P:
                self._close_upto("p", {"p"})
            if tag in CLOSES:
                self._close_upto(tag, CLOSES[tag])
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        mark = PLAIN
        if tag in NEVER or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
            mark = HARD
        elif tag == "form":
            mark = SOFT
        elif tag not in ("html", "body", "main"):
            inside = any(e.name in ("article", "main") and e.mark == PLAIN for e in self.open)
            mark = named(f"{a.get('class', '')} {a.get('id', '')}")
            if tag == "header":  # inside an article it holds the headline
                mark = PLAIN if inside else HARD
            elif mark == DOUBT and (inside or tag == "article"):
                mark = PLAIN
        if tag in ("h1", "main") or tag == "article" and mark == PLAIN:
            for e in self.open:
                e.holds = True
        self.all.append(Element(tag, len(self.all), mark))
        self.open.append(self.all[-1])

    def _close_upto(self, tag: str, kinds: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name in kinds:
                del self.open[i:]
                return
            if self.open[i].name in ("ul", "ol", "dl", "table", "tr", "div", "article", "section", "main", "body") and self.open[i].name not in kinds:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return
            if self.open[i].name in ("article", "main", "body") and tag in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].name in RAW:
            return
        self.text.append(data)
        if any(e.name == "a" for e in self.open):
            self.links += len(data)

    def finish(self) -> None:
        """Close the page and mark its lines."""
        self.close()
        self.end_line()
        total, forms = 0, dict.fromkeys((e.number for e in self.all if e.name == "form"), 0)
        for ln in self.lines:
            if not any(self.all[e].mark == HARD or self.all[e].mark == SOFT and self.all[e].name != "form" and not self.all[e].holds for e in ln.path):
                total += ln.chars
                for e in forms.keys() & set(ln.path):
                    forms[e] += ln.chars
        for e in self.all:  # a box around the page is no box beside it
            if e.mark == SOFT and (e.holds or 2 * forms.get(e.number, 0) > total):
                e.mark = PLAIN
        for ln in self.lines:
            marks = [self.all[e].mark for e in ln.path]
            ln.aside, ln.doubt = max(marks, default=0) >= SOFT, DOUBT in marks


def gaussian(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = max(1, math.ceil(2 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(x, k / k.sum(), mode="full")[r : r + len(x)]


def clusters(lines: list[Line], share: float = 0.5) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """-> which lines are content, and the runs [a, b) of neighbouring ones."""
    if not lines:
        return np.zeros(0, bool), []
    open_ = np.array([not (ln.aside or ln.doubt) for ln in lines])
    smooth = gaussian(np.array([ln.chars / max(1, ln.tags) for ln in lines]) * open_)
    high = open_ & (smooth >= min(share * float(smooth.std()), float(smooth[open_].max(initial=0))))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], high.astype(np.int8), [0]))))
    return high, [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


def region_of(lines: list[Line], high: np.ndarray, run: tuple[int, int], elements: list[Element]) -> int | None:
    """The element that the heaviest cluster elects."""
    mine = lines[run[0] : run[1]]
    half = sum(len(ln.text) for ln in mine) / 2
    for kind in ("article", "main"):  # the outermost, so that articles inside an article belong to it
        outer: Counter[int] = Counter()
        for ln in mine:
            at = next((e for e in ln.path if elements[e].name == kind and elements[e].mark == PLAIN), None)
            if at is not None:
                outer[at] += len(ln.text)
        if outer and outer.total() >= half:
            return max(outer, key=lambda e: (outer[e], -e))
    path, shared = mine[0].path, 0
    while all(len(ln.path) > shared and ln.path[shared] == path[shared] for ln in mine):
        shared += 1
    region = path[:shared]
    while region and elements[region[-1]].name in PARTS:
        region = region[:-1]
    inside = lambda e, ln: e in ln.path
    headed = lambda e: any(inside(e, ln) and not (ln.aside or ln.doubt) and any(elements[x].name == "h1" for x in ln.path) for ln in lines)
    held = lambda e: sum(len(ln.text) for ln, h in zip(lines, high) if h and inside(e, ln))
    best = region[-1] if region else None
    for e in reversed(region[:-1]):
        if elements[e].name not in PARTS and (held(e) >= (1.5 if headed(best) else 1.25) * held(best) or headed(e) and not headed(best)):
            best = e
    return best


def content_lines(lines: list[Line], elements: list[Element], share: float = 0.5) -> list[Line]:
    """The lines of the content region."""
    kept = [ln for ln in lines if not ln.aside]
    if kept and all(ln.doubt for ln in kept):
        for ln in kept:
            ln.doubt = False
    high, runs = clusters(lines, share)
    if not runs:
        return []
    best = max(runs, key=lambda r: sum(len(ln.text) for ln in lines[r[0] : r[1]]))
    region = region_of(lines, high, best, elements)
    if region is None:
        return [ln for ln in kept if not ln.doubt]
    top = elements[region].name
    out = [(ln, h) for ln, h in zip(lines, high) if not ln.aside and region in ln.path]
    if top in ("article", "main"):
        return [ln for ln, _ in out]
    # boxes and links ahead of the first and behind the last cluster or headline
    ends = [i for i, (ln, h) in enumerate(out) if h or any(elements[e].name == "h1" for e in ln.path)]
    boxed = lambda ln: any(elements[e].name not in PARTS for e in ln.path[ln.path.index(region) + 1 :])
    return [ln for i, (ln, _) in enumerate(out) if ends[0] <= i <= ends[-1] or not (boxed(ln) or 2 * ln.links >= len(ln.text))]


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.finish()
    return "\n".join(ln.text for ln in content_lines(parser.lines, parser.all))


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of every page, read from the whole html."""

    @F.pandas_udf("string")
    def texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield pd.Series([main_text(x) for x in s], dtype=object)

    return pages.withColumn(name, texts(F.col(html_col)))
