"""Main text of raw web pages.

The standard library's parser streams its events into lines, one for each block of the page, with the tags
met in it. The text-to-tag ratio of each line is smoothed by a Gaussian kernel and split into two clusters
by a threshold; lines of the upper cluster are content, and they decide which region of the page is the article:

- If article elements hold nearly all content, the region is all of them, short lines and all, but for teasers: articles without
  a content line that are mostly links or whose heading is one. Headings right before an article, a main heading where the
  articles have none, and content lines beside them in the same main element belong to it too.
- Otherwise, if main elements hold nearly all content, their lines are the region.
- Otherwise the content lines are, with every line between the first and the last of them that isn't all links or is a
  paragraph between paragraphs, and with the headings and text blocks beside the elements that hold them which adjoin these (a
  main heading may lie anywhere).

Elements that say by their tag or role, or by a whole class or id, that they are navigation, adverts, forms, notices
or comments never count as text. A class such as `cookie-notice` or `sidebar-left` says so, as all of its parts do or
say where it is; `no-sidebar`, `ad-free` or `notice-period` don't. A single block of text inside an article whose name is also an
ordinary word, such as `search` or `share`, is text if it is a content line.

Nulls: null html gives an empty text and 0 characters; a null id or url is kept. Pages without any text,
and pages whose every block is furniture, give an empty text. Character references are decoded, white space
in a block becomes one space, blocks are joined by a newline. Markup that is cut off is dropped. Ties of
two elements go to the one that closes first. Repeated pages are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset(
    "head title nav footer aside form button select textarea fieldset script style noscript template iframe svg canvas object audio video dialog menu datalist".split()
)
BLOCKS = frozenset(
    "html body main article section div header hgroup address blockquote center details summary dl dt dd figure figcaption h1 h2 h3 h4 h5 h6 li ol p pre table caption thead tbody tfoot tr td th ul search".split()
)
# What classes, ids and roles of page furniture are called.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert newsletter subscribe signup login popup modal overlay comment comments commentlist disqus respond replies reply related recommended share sharing social widget widgets pagination pager toolbar skip contentinfo complementary search copyright colophon".split()
)
# Those of them that running text may be named by, too.
ORDINARY = frozenset("search share sharing social related recommended reply replies respond menu skip signup subscribe login toolbar popup".split())
NOT_IN_ARTICLE = frozenset("header banner".split())
# Parts of such names that only say where or what kind of element it is.
PLACES = frozenset(
    "left right top bottom upper lower main site page global primary secondary first last container wrapper wrap box block area section list inner outer bar links items item group region panel column col content text js fixed sticky mobile desktop small large slot unit zone widget".split()
)
# Elements that can be the whole article; others hold a single block of it.
HOLDERS = frozenset(["", *"html body main article section div center table tbody td ul ol dl details".split()])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | frozenset("p li dt dd blockquote pre figcaption caption td th address".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(10_000)
def says_furniture(name: str, in_article: bool) -> bool:
    """Whether a class, id or role names furniture: one of its parts is a mark, and all others are too or only say where it is."""
    parts = {x.lower() for x in PARTS.findall(name)}
    marks = MARKS if in_article else MARKS | NOT_IN_ARTICLE
    return bool(parts & marks) and parts <= marks | PLACES


class Lines(HTMLParser):
    """Collects (text, tags, container) for each block outside the page's furniture."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, bool]] = []  # tag, whether it is furniture, number of the element, whether it is doubtful
        self.parents: list[int] = [0]  # of each element, from the page itself at 0
        self.names: list[str] = [""]
        self.lines: list[tuple[str, int, int]] = []
        self.buffer: list[str] = []
        self.tags = 0
        self.anchors = 0
        self.plain = False  # whether the buffer has text outside links
        self.links: set[int] = set()  # lines that are all links
        self.doubtful: set[int] = set()  # lines in blocks that may be furniture by their name
        self.hidden = 0
        self.inside = 0

    def flush(self) -> None:
        if text := " ".join("".join(self.buffer).split()):
            if not self.plain:
                self.links.add(len(self.lines))
            if any(x[3] for x in self.stack):
                self.doubtful.add(len(self.lines))
            self.lines.append((text, self.tags, self.stack[-1][2] if self.stack else 0))
            self.tags = 0
        self.buffer.clear()
        self.anchors, self.plain = 0, False

    def furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool | None:
        """Whether an element is furniture; None: perhaps."""
        doubt = False
        if tag in FURNITURE or tag == "header" and not self.inside:
            return True
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in (value or "").replace(" ", ""):
                return True
            if key in ("class", "id", "role") and value and tag not in ("html", "body", "article", "main"):
                named = [name for name in value.split() if says_furniture(name, bool(self.inside))]
                if named and self.inside and tag in TEXTS and key != "role" and all(name.lower() in ORDINARY for name in named):
                    doubt = True
                elif named:
                    return True
        return None if doubt else False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        self.anchors += tag == "a"
        if tag == "br":
            self.buffer.append(" ")
            return
        if tag in VOID:
            return
        block = tag in BLOCKS or tag in FURNITURE
        said = self.furniture(tag, attrs)
        hides = bool(said)
        if not block and not hides:
            return
        if block:
            self.flush()
            if self.stack and self.stack[-1][0] == "p":
                self.pop()
            while self.stack and self.stack[-1][0] in CLOSES.get(tag, ()):
                self.pop()
        self.parents.append(self.stack[-1][2] if self.stack else 0)
        self.names.append(tag)
        self.stack.append((tag, hides, len(self.parents) - 1, said is None))
        self.hidden += hides
        self.inside += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self) -> None:
        tag, hides, _, _ = self.stack.pop()
        self.hidden -= hides
        self.inside -= tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if not any(tag == x[0] for x in self.stack):
            return
        self.flush()
        while self.stack[-1][0] != tag:
            self.pop()
        self.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.buffer.append(data)
            self.plain |= not self.anchors and any(map(str.isalnum, data))


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is normed to what lies inside."""
    radius = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    cut = slice(radius, radius + len(ratios))
    return np.convolve(ratios, kernel)[cut] / np.convolve(np.ones(len(ratios)), kernel)[cut]


def threshold(values: np.ndarray) -> float:
    """Between two clusters of values, by alternating assignment and means from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        upper = values >= middle
        if upper.all():
            return low
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.8) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(CUT_OFF.sub("", html))
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines])
    smoothed = smooth(np.log1p(ratios), sigma)
    content = smoothed >= threshold(smoothed)
    sizes = np.array([len(text) for text, _, _ in lines])
    for name in ("article", "main"):
        root = roots(parser, name)
        own = np.array([root[at] for _, _, at in lines])
        if sizes[content & (own > 0)].sum() >= share * sizes[content].sum() and own.any():
            kept = articles(parser, content, own, sizes) if name == "article" else own > 0
            break
    else:
        kept = region(parser, content)
    doubtful = np.array([i in parser.doubtful for i in range(len(lines))])
    kept &= ~doubtful | content
    return "\n".join(text for (text, _, _), keep in zip(lines, kept) if keep)


def roots(parser: Lines, name: str) -> np.ndarray:
    """The outermost element of a name around each element, 0 if there is none."""
    root = np.zeros(len(parser.parents), int)
    for at in range(1, len(root)):  # an element has a larger number than the one around it
        root[at] = root[parser.parents[at]] or (at if parser.names[at] == name else 0)
    return root


def articles(parser: Lines, content: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lines of all articles (own: each line's, 0 outside) but teasers, and what belongs to them in front and beside."""
    tags = [parser.names[at] for _, _, at in parser.lines]
    links = np.array([i in parser.links for i in range(len(own))])
    heads = np.array([tag in HEADINGS for tag in tags])
    kept = np.zeros(len(own), bool)
    for root in np.unique(own[own > 0]):
        mine = own == root
        teaser = 2 * sizes[mine & links].sum() > sizes[mine].sum() or (mine & links & heads).any()
        if (mine & content).any() or not teaser:
            kept |= mine
            before = np.flatnonzero(mine)[0] - 1
            while before >= 0 and not own[before] and heads[before] and not links[before]:
                kept[before] = True
                before -= 1
    main = roots(parser, "main")
    around = np.array([main[at] for _, _, at in parser.lines])
    beside = (own == 0) & ~links & (around > 0) & np.isin(around, around[kept])
    title = np.array([tag == "h1" for tag in tags])
    if not (kept & title).any():
        kept |= title & ~links & (own == 0) & (np.arange(len(own)) < np.flatnonzero(kept)[0])
    return kept | beside & (content | title)


def region(parser: Lines, content: np.ndarray) -> np.ndarray:
    """Which lines are the article: content, what lies between, and the blocks of text that adjoin it beside its elements."""
    kept = content.copy()
    first, last = np.nonzero(content)[0][[0, -1]]
    kept[first : last + 1] |= [i not in parser.links for i in range(first, last + 1)]
    # a paragraph that is one link, between blocks of running text beside it
    for i in range(first + 1, last):
        near = [j for j in (i - 1, i + 1) if kept[j] and j not in parser.links and parser.parents[parser.lines[j][2]] == parser.parents[parser.lines[i][2]]]
        kept[i] |= len(near) == 2 and parser.names[parser.lines[i][2]] in ("p", "blockquote")
    beside = {0}
    for i in np.nonzero(content)[0]:
        at = parser.lines[i][2]
        while at not in beside:
            at = parser.parents[at]
            beside.add(at)
    flows = [
        i not in parser.links and (parser.names[at] == "h1" or parser.names[at] in TEXTS and bool({parser.parents[at], parser.parents[parser.parents[at]]} & beside))
        for i, (_, _, at) in enumerate(parser.lines)
    ]
    for step in (1, -1):
        order = range(len(content))[::step]
        for before, i in zip(order, order[1:]):
            kept[i] |= kept[before] and flows[i]
    return kept


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            texts = [main_text(html.as_py()) for html in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url string, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_extract, schema)
