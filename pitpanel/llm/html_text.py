"""HTML extraction: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one for each block of text.
Every line has a ratio of its own text (links count as markup) to the tags since the line before;
ratios are smoothed with a Gaussian over neighbouring lines, and lines at or above the standard
deviation of the smoothed ratios form the content cluster. Containers are weighed by the cluster's
text that stands in them directly; the content region is the lowest element that holds all containers
with a fifth or more of the heaviest one's weight (text without a block of its own, such as
a line in a footer, weighs less), and the h1 headings. Where main or article
elements hold half of the cluster, they are the region. In the region, lines stay that are not side
matter; outside main and article, blocks go that have no line of the cluster and no heading, and
lists of links.

Names only tell side matter: elements that mark themselves as navigation, page header or footer,
aside, form, advert, notice, comments (by tag, role, class or id) are left out, unless they are containers (three lines or more) of more
than half of the page's text, so that a wrapper's name costs nothing. Scripts, styles, templates
and elements whose tag says what they are (nav, footer, aside ...) are never text. Headings and paragraphs are never marked; a header inside an article is
its own.

Defined results: a null or empty page gives an empty text; a page without markup is one line;
character references are decoded; white space inside a line becomes one space, lines are joined
by one space in page order; repeated rows and null ids stay, a row each; other columns are kept,
those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from pitpanel.llm.common import append_columns

#: Element names by their role in HTML, and words that mark side matter (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
HARD = frozenset("head script style noscript template select textarea svg math iframe object canvas audio video map nav footer aside button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies "
                  "disclaimer footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices "
                  "notification pager pagination popup popover promo promoted promotion related rail share sharing sidebar sidebars "
                  "signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert comment comments "
                  "commentlist commenter discussion disqus replies reply responses form search".split())
#: Marks that count inside an article; words of a block of related links; words that make a header a part of the text.
INNER = frozenset("comment ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs cookie cookies gdpr newsletter "
                  "pagination pager popup popover promo promoted share sharing sidebar social sponsored subscribe signup comments "
                  "commentlist disqus replies reply responses response discussion notice notices consent banner menu navigation nav login modal".split())
RELATED = frozenset("related post posts article articles content links link stories story more read reading news block box list section".split())
OWN_HEADER = frozenset("entry post article content story page title section".split())
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd pre blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body main article".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Smoothing width in lines; share of the heaviest container's weight that counts; weight of text that stands in no block of its own.
SIGMA, SHARE, BARE = 1.5, 0.2, 0.4


class Element(NamedTuple):
    parent: int
    tag: str
    side: bool  # marks itself as side matter
    hard: bool  # never text of the page
    inside: bool  # of a main or article element, or one itself


class Line(NamedTuple):
    text: str
    tags: int  # since the line before
    linked: int  # characters inside links
    element: int
    heading: int  # its level, or 0


class Lines(HTMLParser):
    """Collects the elements (block elements only, each after its parent) and a line for each block of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element(0, "", False, False, False)]
        self.stack: list[tuple[str, int]] = []  # name, number of the block element it is or stands in
        self.open: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            at = self.stack[-1][1] if self.stack else 0
            tag = self.elements[at].tag
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), at, int(tag[1]) if tag in HEADINGS else 0))
            self.tags = 0
        self.text, self.linked = [], 0

    def side_matter(self, tag: str, attrs, inside: bool) -> bool:
        if tag == "form":
            return True
        if tag == "header":
            return not inside
        if tag in WHOLE and tag != "article":
            return False
        for name, value in attrs:
            if name == "hidden" or (name == "role" and value in ROLES):
                return True
            if name in ("class", "id") and value:
                words = {w.lower() for w in NAME_PARTS.findall(value)}
                if tag in TEXT and (tag[0] == "h" or inside):
                    continue
                if words & OWN_HEADER:
                    words -= {"header"}
                if inside and tag != "article":
                    words = words & INNER if not ("related" in words and words <= RELATED) else words
                if tag == "article":
                    words &= {"comment", "comments", "reply", "replies", "ad", "advert", "promo", "related"}
                if words & MARKS or words & {"response", "responses"} and inside:
                    return True
        return False

    def close_to(self, k: int):
        for name, _ in self.stack[k:]:
            self.open[name] -= 1
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag in ("p", "li", "option", "dt", "dd"):  # closes an open one of its kind within the same container
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name == tag:
                    self.close_to(k)
                    break
                if name not in INLINE:
                    break
        parent = self.stack[-1][1] if self.stack else 0
        if tag not in INLINE:
            inside = self.elements[parent].inside
            self.elements.append(Element(parent, tag, self.side_matter(tag, attrs, inside), tag in HARD, inside or tag in ("article", "main")))
            parent = len(self.elements) - 1
        self.stack.append((tag, parent))
        self.open[tag] += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.close_to(k)
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data):
        self.text.append(data)
        if self.open["a"]:
            self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = min(int(3 * sigma), len(values))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "full")[reach:reach + len(values)]
    return np.convolve(values, kernel, "full")[reach:reach + len(values)] / weight


def below(elements: list[Element], values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each element and all elements below it."""
    out = values.tolist()
    for k in range(len(elements) - 1, 0, -1):
        out[elements[k].parent] += out[k]
    return np.array(out)


def inherited(elements: list[Element], own: list[bool]) -> list[bool]:
    """Whether an element or any above it has ``own``."""
    out = list(own)
    for k in range(1, len(elements)):
        out[k] = out[k] or out[elements[k].parent]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # a marked section that the parser does not know: take it as text
        parser = Lines()
        parser.feed(html.replace("<!", "&lt;!"))
        parser.close()
    parser.flush()
    elements = parser.elements
    hard = inherited(elements, [e.hard for e in elements])
    lines = [line for line in parser.lines if not hard[line.element]]

    def total(weights) -> np.ndarray:
        own = np.zeros(len(elements))
        np.add.at(own, [line.element for line in lines], weights)
        return below(elements, own)

    size, blocks = total([len(line.text) for line in lines]), total([1] * len(lines))
    side = inherited(elements, [e.side and (2 * size[k] <= size[0] or blocks[k] < 3) for k, e in enumerate(elements)])
    lines = [line for line in lines if not side[line.element]]
    if not lines:
        return ""
    ratio = smooth(np.array([(len(line.text) - line.linked) / max(1, line.tags) for line in lines]), SIGMA)
    content = (ratio >= ratio.std()) & np.array([2 * line.linked <= len(line.text) for line in lines])
    if not content.any():
        content = np.ones(len(lines), bool)
    weights = np.array([len(line.text) for line in lines]) * content
    inside = np.array([elements[line.element].inside for line in lines])
    if 2 * weights[inside].sum() >= weights.sum():
        return " ".join(line.text for line, one in zip(lines, inside, strict=True) if one)

    # A block of text weighs for the container it stands in.
    holders = [e if elements[e].tag not in TEXT else elements[e].parent for e in (line.element for line in lines)]
    weight = np.zeros(len(elements))
    np.add.at(weight, holders, weights * np.array([1.0 if elements[line.element].tag in TEXT else BARE for line in lines]))
    wanted = weight >= SHARE * weight.max()
    wanted[[h for h, line in zip(holders, lines, strict=True) if line.heading == 1]] = True
    counts = below(elements, wanted.astype(float))
    region = max(k for k in range(len(elements)) if counts[k] == counts[0] and (k == 0 or counts[elements[k].parent] == counts[0]))
    cluster, headings, text, linked = (total(w) for w in (content, [line.heading > 0 for line in lines], [len(line.text) for line in lines],
                                                         [line.linked for line in lines]))
    gone, within = [False] * len(elements), [False] * len(elements)
    within[region] = True
    for k in range(region + 1, len(elements)):
        parent = elements[k].parent
        within[k] = within[parent]
        empty = elements[k].tag not in TEXT and not cluster[k] and (not headings[k] or 2 * linked[k] > text[k])
        gone[k] = gone[parent] or empty
    return " ".join(line.text for line in lines if within[line.element] and not gone[line.element])


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` and ``n_chars``."""
    def start():
        def step(columns):
            texts = [main_text(html) for html in columns[0]]
            return [texts, [len(text) for text in texts]]

        return step

    return append_columns(pages, [html_col], "text string, n_chars bigint", start).drop(html_col)
