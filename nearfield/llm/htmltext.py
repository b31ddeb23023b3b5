"""Main text of web pages: standard-library parser events, text-to-tag ratio by line, Gaussian smoothing, clustering.

The parser's events cut a page into lines, one for each block of text, and note the containers around them. A line's
ratio is its visible characters over its tags; lines inside menus, notices, adverts, forms, comments and the like have
ratio 0. Lines whose smoothed ratio is above a threshold (a share of their standard deviation, or enough) form the content cluster.

The cluster selects the regions: all outermost article and main elements that hold lines of it, else all that the lines
have in common. Every visible line of a region is kept, short ones too. Outside an article, containers without a line of
the cluster go where they are mostly links, or, in a page without any article element, before or after the cluster.

Markup that contradicts itself is settled when the whole page is known: an element that is never closed doesn't hide the
article inside it, and a class name doesn't hide a container that holds most of the page's text.

Cases: null, empty or tag-only html gives ''; broken and unclosed markup is read as far as it goes; repeated rows and
ties give equal texts; other columns are ignored; an empty table gives an empty result. Time and memory are linear in
the page, however deep its elements are nested.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element names by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl figure footer form header html main menu nav ol section table ul".split())
HIDDEN = frozenset("aside button canvas datalist dialog fieldset footer form iframe input menu nav noscript object option script select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br hr img wbr".split())
PROSE = frozenset("blockquote dl figure ol table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the next one of their kind closes.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}
#: Words of class, id and role names that mark what isn't the article.
MARKS = frozenset("ad ads advert advertisement advertisements adverts alert banner breadcrumb breadcrumbs byline consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promotion share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: What follows the word related in the name of a list of other pages, if anything does.
RELATED = frozenset("article articles box container content items links list news pages posts products reading section stories topics widget wrapper".split())
#: Words that make a name say something about the comments elsewhere.
ABOUT = frozenset("allowed closed disabled enabled has no open with".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
OWN = frozenset("article content entry main post story".split())
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SIGMA = 1.0
RADIUS = 2
#: A line is in the content cluster if its smoothed ratio is above so many standard deviations of all smoothed ratios.
THRESHOLD = 0.25
#: Or above this many characters a tag, so that a very long block doesn't outweigh the others.
ENOUGH = 20.0
#: A container with a larger share of its characters in links is a list of links.
LINKS = 0.5
#: A marked container with this share of the page's text is a wrapper, not a part beside the article.
MOST = 0.6

NONE, BY_CLASS, BY_TAG, BY_COMMENT = range(4)
MAIN, ARTICLE = 1, 2
TAG_START = re.compile(r"<[A-Za-z/!?]")


def marked(tag: str, attrs: dict[str, str | None], in_article: bool) -> int:
    """Whether an element hides what it holds, and why."""
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
    words = [re.split(r"[-_\d]+", name) for name in names]
    if tag not in ("html", "body", "main") and any(not COMMENTS.isdisjoint(own) and ABOUT.isdisjoint(own) for own in words):
        return BY_COMMENT
    if tag in HIDDEN:
        return BY_TAG
    if tag == "header":
        return NONE if in_article else BY_TAG
    if tag in ("html", "body", "article", "main"):
        return NONE
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or INVISIBLE.search(attrs.get("style") or ""):
        return BY_TAG
    if (attrs.get("role") or "").lower() in ROLES:
        return BY_TAG
    related = any("related" in own and RELATED.issuperset(own[own.index("related") + 1 :]) for own in words)
    return BY_CLASS if related or any(own[0] not in OWN and not MARKS.isdisjoint(own) for own in words) else NONE


class Page(HTMLParser):
    """Collects a page's lines and its containers.

    lines: (text, tags, characters in links, container, heading). Containers are numbered from 1 in page order, 0 is the
    page: parent, tag, mark, semantic (MAIN, ARTICLE or neither) and whether its end tag came.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parent, self.tag, self.mark, self.semantic, self.closed = [0], [""], [NONE], [0], [True]
        self.stack: list[tuple[int, tuple | None]] = [(0, None)]
        self.open: Counter[str] = Counter()
        self.articles = 0
        self.parts: list[str] = []
        self.tags = self.linked = self.anchors = 0
        self.heading = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append((text, self.tags, min(self.linked, len(text)), self.stack[-1][0], self.heading))
        self.parts, self.tags, self.linked = [], 0, 0

    def push(self, tag: str, mark: int, semantic: int, saved: tuple | None) -> None:
        self.parent.append(self.stack[-1][0])
        self.tag.append(tag)
        self.mark.append(mark)
        self.semantic.append(semantic)
        self.closed.append(False)
        self.stack.append((len(self.tag) - 1, saved))
        self.open[tag] += 1
        self.articles += tag in ("article", "main")

    def pop(self, ended: bool) -> None:
        """Closes the innermost container; one inside a line gives the line back."""
        number, saved = self.stack[-1]
        if self.parts or self.tags:
            self.flush()
        self.stack.pop()
        self.closed[number] = ended
        self.open[self.tag[number]] -= 1
        self.articles -= self.tag[number] in ("article", "main")
        if saved is not None:
            self.parts, self.tags, self.linked = saved

    def handle_starttag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        attrs = dict(pairs)
        if tag in BLOCKS:
            while (top := self.tag[self.stack[-1][0]]) == "p" or top in SIBLINGS.get(tag, ()):
                self.pop(True)
            self.flush()
            if tag in HEADINGS:
                self.heading = True
        self.tags += 1
        if tag in SPACES:
            self.parts.append(" ")
        if tag == "a":
            self.anchors += 1
        if tag in VOID:
            return
        mark = marked(tag, attrs, self.articles > 0)
        if mark or tag in CONTAINERS or self.open[tag]:
            saved = None
            if tag not in BLOCKS:  # an element in a line has a line of its own, so that the text around it stays one line
                saved = self.parts, self.tags, self.linked
                self.parts, self.tags, self.linked = [], 0, 0
            role = (attrs.get("role") or "").lower()
            article = tag == "article" or role == "article" or attrs.get("itemprop") == "articleBody"
            self.push(tag, mark, ARTICLE if article else MAIN if "main" in (tag, role) else 0, saved)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self.tag[self.stack[-1][0]] != tag:
                self.pop(False)
            self.tags += 1
            self.pop(True)
        elif tag in BLOCKS:
            self.flush()
            self.tags += 1
        else:
            self.tags += 1
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if tag in HEADINGS:
            self.heading = False

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.anchors:
            self.linked += len(data)

    def read(self, html: str) -> Page:
        # after the last > no tag is complete: what begins one there is no text
        end = html.rfind(">") + 1
        rest = html[end:]
        cut = TAG_START.search(rest)
        self.feed(html[:end])
        self.close()
        self.handle_data(unescape(rest[: cut.start()] if cut else rest))
        while len(self.stack) > 1:
            self.pop(False)
        self.flush()
        return self

    def hidden(self, spared: frozenset[int] = frozenset(), unclosed: bool = True) -> list[bool]:
        """For each container, whether it or one around it hides: unclosed ones only up to an article, if at all."""
        surely, maybe = [False], [False]
        for n in range(1, len(self.tag)):
            up, tag, mark = self.parent[n], self.tag[n], self.mark[n]
            own = mark != NONE and n not in spared
            sure = self.closed[n] or mark == BY_COMMENT
            surely.append(surely[up] or (own and sure))
            doubtful = own and not sure and (unclosed or tag not in CONTAINERS) and (mark != BY_CLASS or tag in BLOCKS)
            maybe.append((maybe[up] and tag not in ("article", "main", "body")) or doubtful)
        return [a or b for a, b in zip(surely, maybe)]

    def sums(self, values: list[float]) -> list[float]:
        """By container, the sum of its lines' values, those of containers inside it included."""
        found = [0.0] * len(self.tag)
        for (_, _, _, n, _), value in zip(self.lines, values):
            found[n] += value
        for n in range(len(self.tag) - 1, 0, -1):
            found[self.parent[n]] += found[n]
        return found


def smooth(values: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    """Gaussian smoothing; beyond the ends counts as 0."""
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    whole = sum(kernel)
    padded = [0.0] * radius + values + [0.0] * radius
    return [sum(k * padded[i + d] for d, k in enumerate(kernel)) / whole for i in range(len(values))]


def seeds(ratios: list[float], threshold: float = THRESHOLD) -> list[bool]:
    """The cluster of lines with content: smoothed ratio above the threshold, and own text."""
    if not ratios:
        return []
    smoothed = smooth(ratios)
    mean = sum(smoothed) / len(smoothed)
    spread = math.sqrt(sum((v - mean) ** 2 for v in smoothed) / len(smoothed))
    least = min(threshold * spread, ENOUGH)
    return [v >= least and r > 0 for v, r in zip(smoothed, ratios)]


def cluster(page: Page, hidden: list[bool]) -> list[bool]:
    """The lines in the content cluster, links alone aren't in it."""
    ratios = [0.0 if hidden[n] or linked > LINKS * len(text) else len(text) / max(tags, 1) for text, tags, linked, n, _ in page.lines]
    return seeds(ratios)


def wrappers(page: Page) -> frozenset[int]:
    """Containers hidden by a class name alone that hold most of the text which isn't hidden otherwise."""
    if BY_CLASS not in page.mark:
        return frozenset()
    by_class = frozenset(n for n, mark in enumerate(page.mark) if mark == BY_CLASS)
    hidden = page.hidden(by_class)
    held = page.sums([0.0 if hidden[n] else len(text) - linked for text, _, linked, n, _ in page.lines])
    return frozenset(n for n in by_class if held[n] > 0 and held[n] >= MOST * held[0])


def selected(page: Page, hidden: list[bool]) -> list[str] | None:
    """The kept lines' texts, or None without a content cluster."""
    chosen = cluster(page, hidden)
    if not any(chosen):
        return None
    held = page.sums([float(c) for c in chosen])
    size = page.sums([0.0 if hidden[n] else float(len(text)) for text, _, _, n, _ in page.lines])
    linked = page.sums([0.0 if hidden[n] else float(own) for _, _, own, n, _ in page.lines])
    count = len(page.tag)
    # the region that a container lies in, and whether an article is around it
    region, article, gone = [0] * count, [False] * count, [False] * count
    for n in range(1, count):
        up = page.parent[n]
        region[n] = region[up] or (n if page.semantic[n] and not hidden[n] and held[n] else 0)
        article[n] = article[up] or (page.semantic[n] == ARTICLE and held[n] > 0)
    apart = not any(region)
    if apart:
        # no article element: what the cluster has in common
        common = 0
        for n in range(1, count):  # containers are in page order
            common = n if page.parent[n] == common and held[n] == held[0] else common
        # a part of it without lines of the cluster, before or after them, stays if it is a list, a table or a quotation
        region[common], beside = 1, [False] * count
        for n in range(common + 1, count):
            up = page.parent[n]
            region[n] = region[up]
            beside[n] = beside[up] or (up == common and not held[n] and page.tag[n] not in PROSE)
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    kept = []
    for n in range(1, count):
        gone[n] = gone[page.parent[n]] or (not article[n] and not held[n] and linked[n] > LINKS * size[n])
    for i, (text, _, own, n, heading) in enumerate(page.lines):
        if not text or hidden[n]:
            continue
        if apart and heading and i < first:  # a headline above the region
            kept.append(text)
        elif region[n] and not gone[n] and not (apart and not first <= i <= last and (beside[n] or own > LINKS * len(text))):
            kept.append(text)
    return kept


def main_text(html: str | None) -> str:
    """The blocks of a page's main text, joined by line ends."""
    if not html:
        return ""
    page = Page().read(html)
    hidden = page.hidden()
    spared = wrappers(page)
    if spared:
        # outside an article, a class name's verdict stands if there is an article elsewhere
        held = page.sums([float(c) for c in cluster(page, hidden)])
        elsewhere = any(page.semantic[n] == ARTICLE and not hidden[n] and held[n] > 1 for n in range(len(held)))
        within = [0] * len(held)
        for n in range(1, len(held)):
            within[n] = within[page.parent[n]] or page.semantic[n] == ARTICLE
        spared = frozenset(n for n in spared if within[n] or not elsewhere)
        hidden = page.hidden(spared)
    kept = selected(page, hidden)
    if kept is None and not all(page.closed[1:]):
        kept = selected(page, page.hidden(spared, unclosed=False))
    return "\n".join(kept or ())


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (its code points), a row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(x) for x in part.column(len(keep)).to_pylist()]
                arrays = [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(f"_{i}" for i in range(len(keep))), "_text", "_n_chars"])

    # columns take names of their own here: kept ones may be called text or anything else
    own = pages.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{html}`").alias("_html"))
    types = ", ".join(f"_{i} {own.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    return own.mapInArrow(run, f"{types}, _text string, _n_chars long").toDF(*keep, "text", "n_chars")
