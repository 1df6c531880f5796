"""Main-text extraction from HTML by tag-path ratios.

Text nodes of a page are grouped by their root-to-leaf tag path. For every
path the text length per node (text-to-path ratio) and the punctuation per
node (punctuation-to-path ratio) are aggregated, smoothed over neighbouring
paths in page order, and fused by their product, damped by the share of
linked text. Paths whose fused ratio reaches the threshold (a share of the
text-weighted mean) are content paths. The smallest element that holds the
bulk of the content (all article or main elements with content if half of it
lies in them) is the content region, and its whole text belongs to the
result: headings and short paragraphs inside it although their own ratio is
low. Content text outside the region is not dropped: its blocks belong to
the result too, and so do headings before the region (if it has no h1) or
before such a block, beside it or beside an element around it below body.

Elements that never hold the article (menus, footers, headers outside it,
asides, forms, scripts, styles) and those whose class, id or role names an
advert, notice, sidebar, menu or reader comments are left out before paths
are counted.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one newline; empty blocks are
dropped. Defined cases: null or empty html gives the empty text; broken and
unclosed markup is read as far as it goes; a page without content paths gives
the empty text; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_struct

#: Share of the text-weighted mean ratio that makes a path content.
THRESHOLD = 0.25
#: Share of the content text that an element must hold to be the region.
REGION_SHARE = 0.9

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title nav aside footer button select option textarea iframe object "
                    "svg canvas audio video dialog menu map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img input".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
#: Elements whose end tag may be left out: what a new one of the kind closes, and where the search ends.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
REGION_TAGS = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form alertdialog".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|login|side[_-]?bar|aside|widgets?|nav|navbar|navigation|menus?|"
    r"breadcrumbs?|header|masthead|topbar|footer|foot|copyright|comments?|commentlist|discussion|disqus|replies|respond|related|"
    r"recommended|recommendations|share|sharing|social|toolbar|pagination|pager|skip|alert|paywall)(?:$|[\s_-]|\d)",
    re.IGNORECASE,
)
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|<(/?)(?=[A-Za-z])[^>]*(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = frozenset("script style textarea title noscript iframe".split())
#: Class names that do not say what an element is: what stands beside it ("has-sidebar"), a post's subjects ("tag-login"), the page
#: builder's boxes ("elementor-widget"), and the title block of a post ("entry-header").
_LAYOUT = re.compile(
    r"(?:^|\s)(?:(?:has|with|without|no|category|tag|topic|elementor)[_-]\S*|(?:post|entry|article|story|content|page)[_-]{1,2}header)(?=\s|$)",
    re.IGNORECASE,
)
#: Share of the page's text at which an element with the title or the main element counts as content whatever its name.
PAGE_SHARE = 0.5
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，！？；：]")


def _boilerplate(tag: str, rest: str) -> bool:
    """Whether an element is left out whatever it holds: by its tag, its role, or because it is hidden."""
    if tag in SKIPPED:
        return True
    if not rest or tag in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
        if k == "role" and v.lower() in _ROLES or k == "hidden":
            return True
        if k == "style" and "display:none" in v.replace(" ", "").lower():
            return True
        if k == "aria-hidden" and v.lower() == "true":
            return True
    return False


def _named_boilerplate(tag: str, rest: str) -> bool:
    """Whether an element's names (or a form's tag) speak against it; what it holds can speak for it."""
    if tag == "form":
        return True
    if not rest or tag in ("html", "body", "main"):
        return False
    return any(
        m[1].lower() in ("class", "id") and _NAMES.search(_LAYOUT.sub(" ", m[2] or m[3] or m[4] or "")) for m in _ATTRIBUTE.finditer(rest)
    )


class _Node:
    __slots__ = ("tag", "parent", "path", "skip", "named", "depth", "in_region", "weight", "inside")

    def __init__(self, tag: str, parent: _Node | None, skip: bool, path: int, named: bool = False):
        self.tag, self.parent, self.skip, self.path, self.named = tag, parent, skip, path, named
        self.depth = parent.depth + 1 if parent else 0
        self.in_region = tag in REGION_TAGS or parent is not None and parent.in_region
        self.weight, self.inside = 0, False


class _Page:
    """Collects text pieces as (element, block number, text, inside a link)."""

    def __init__(self):
        self.top = _Node("", None, False, 0)
        self.nodes = [self.top]  # in page order: parents before children
        self.paths: dict[tuple[int, str], int] = {}  # a tag path is named by its parent path and its last tag
        self.open: Counter = Counter()  # open elements by tag
        self.pieces: list[tuple[_Node, int, str, bool]] = []
        self.block = 0
        self.links = 0

    def feed(self, html: str) -> None:
        at = 0
        while True:
            m = _MARKUP.search(html, at)
            if m is None:
                break
            if m.start() > at:
                self.handle_data(html[at:m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue  # comment, declaration or processing instruction
            tag = tag.lower()
            if m[1]:
                self.handle_endtag(tag)
                continue
            self.handle_starttag(tag, m[3])
            if tag in RAW:  # no markup inside: skip to the end tag
                end = re.compile(f"</{tag}(?=[\\s/>]|$)", re.IGNORECASE).search(html, at)
                if tag in ("textarea", "title"):
                    self.handle_data(html[at:end.start() if end else len(html)])
                at = end.start() if end else len(html)
        if at < len(html):
            self.handle_data(html[at:])

    def _close_to(self, node: _Node) -> None:
        while self.top is not node:
            self.open[self.top.tag] -= 1
            if self.top.tag == "a":
                self.links -= 1
            elif self.top.tag not in INLINE:
                self.block += 1
            self.top = self.top.parent

    def _open(self, tags: set, stops: set) -> _Node | None:
        n = self.top
        if not any(self.open[t] for t in tags):
            return None
        while n.parent is not None and n.tag not in stops:
            if n.tag in tags:
                return n
            n = n.parent
        return None

    def handle_starttag(self, tag: str, rest: str) -> None:
        if tag in CLOSES_P and (p := self._open({"p"}, {"table", "td", "th", "button", "caption", "object"})):
            self._close_to(p.parent)
        if tag in IMPLIED and (n := self._open(*IMPLIED[tag])):
            while (more := n.parent) is not None and more.tag in IMPLIED[tag][0]:
                n = more
            self._close_to(n.parent)
        if tag not in INLINE:
            self.block += 1
        if tag == "br":
            self.pieces.append((self.top, self.block, " ", False))
        if tag in VOID:
            return
        skip = self.top.skip or _boilerplate(tag, rest) or tag == "header" and not self.top.in_region
        if tag == "a":
            self.links += 1
        named = not skip and _named_boilerplate(tag, rest)
        self.top = _Node(tag, self.top, skip, self.paths.setdefault((self.top.path, tag), len(self.paths) + 1), named)
        self.nodes.append(self.top)
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        n = self.top
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self._close_to(n.parent)
            if tag not in INLINE:
                self.block += 1

    def handle_data(self, data: str) -> None:
        if not self.top.skip:
            self.pieces.append((self.top, self.block, unescape(data) if "&" in data else data, self.links > 0))


def _drop_named(page: _Page) -> None:
    """Leave out elements whose names speak against them, unless they hold the page: its title or main element and most of its text."""
    if not any(node.named for node in page.nodes):
        return
    held: set[_Node] = set()  # elements that hold a title or the main element with text
    article: set[_Node] = set()  # elements that hold an article with text
    filled = {node for node, _, text, _ in page.pieces if text.strip()}
    for node in reversed(page.nodes):  # children before parents
        up = node.parent
        if up is None or node not in filled:
            continue
        filled.add(up)
        if node in held or node.tag in ("h1", "main"):
            held.add(up)
        if node in article or node.tag == "article" and not node.named:
            article.add(up)

    def drop(gone) -> None:
        for node in page.nodes:  # parents before children
            node.skip = node.skip or node.parent is not None and node.parent.skip or node.named and gone(node)
        page.pieces = [p for p in page.pieces if not p[0].skip]

    drop(lambda node: node not in held and not (node.tag == "form" and node in article))
    weight: Counter = Counter()  # of what is left
    for node, _, text, _ in page.pieces:
        weight[node] += len(text.strip())
    for node in reversed(page.nodes):
        if node.parent is not None:
            weight[node.parent] += weight[node]
    drop(lambda node: weight[node] < PAGE_SHARE * weight[page.nodes[0]])


def _content_paths(pieces: list) -> set[int]:
    """Paths whose smoothed and fused ratio reaches the threshold."""
    stats: dict[int, list[float]] = {}
    for node, _, text, linked in pieces:
        n = len(text.strip())
        if n:
            s = stats.setdefault(node.path, [0, 0, 0, 0])
            s[0] += n
            s[1] += len(_PUNCT.findall(text))
            s[2] += 1
            s[3] += n if linked else 0
    if not stats:
        return set()
    paths = list(stats)
    length = [stats[p][0] / stats[p][2] for p in paths]
    punct = [(stats[p][1] + 0.5) / stats[p][2] for p in paths]

    def smooth(v: list[float]) -> list[float]:
        return [max(x, 0.25 * v[max(0, i - 1)] + 0.5 * x + 0.25 * v[min(len(v) - 1, i + 1)]) for i, x in enumerate(v)]

    fused = [
        a * b * (1 - stats[p][3] / stats[p][0]) for p, a, b in zip(paths, smooth(length), smooth(punct), strict=True)
    ]
    total = sum(stats[p][0] for p in paths)
    mean = sum(f * stats[p][0] for p, f in zip(paths, fused, strict=True)) / total
    return {p for p, f in zip(paths, fused, strict=True) if f > 0 and f >= THRESHOLD * mean}


def _regions(page: _Page, content: set[int]) -> list[_Node]:
    """The region tags, else the smallest element, that hold the bulk of the content text."""
    total = 0
    for node, _, text, _ in page.pieces:
        n = len(text.strip())
        if n and node.path in content:
            total += n
            node.weight += n
    if not total:
        return []
    for node in reversed(page.nodes):  # children before parents
        if node.parent is not None:
            node.parent.weight += node.weight
    for tag in REGION_TAGS:
        outer, within = [], {}
        for node in page.nodes:  # parents before children
            inside = node.parent is not None and within[node.parent]
            within[node] = inside or node.tag == tag
            if node.tag == tag and not inside and node.weight:
                outer.append(node)
        if sum(n.weight for n in outer) >= 0.5 * total:
            return outer
    enough = (n for n in page.nodes if n.weight >= REGION_SHARE * total and n.tag not in INLINE and n.tag not in ("p", "h1", "h2", "li", "td"))
    best = max(enough, key=lambda n: (n.depth, n.weight), default=None)
    return [] if best is None else [best]


def _take_headings(page: _Page, regions: list[_Node], loose: list[_Node]) -> None:
    """Mark headings (or elements of headings only) that stand before a region without h1 or before loose content, beside it or around it."""
    place = {n: i for i, n in enumerate(page.nodes)}
    titled: set[_Node] = set()
    has_text: set[_Node] = set()
    other: set[_Node] = set()  # elements with text outside headings
    heading: dict[_Node, bool] = {}
    for node in page.nodes:
        heading[node] = node.tag in HEADINGS or node.parent is not None and heading[node.parent]
    for node, _, text, _ in page.pieces:
        if text.strip():
            has_text.add(node)
            if not heading[node]:
                other.add(node)
    for node in reversed(page.nodes):
        if node.parent is not None:
            for marks in (has_text, other):
                if node in marks:
                    marks.add(node.parent)
            if node in titled or node.tag == "h1" and node in has_text:
                titled.add(node.parent)
    last: dict[_Node, int] = {}  # elements around an anchor, with the place of their last anchor
    for anchor in sorted([*(r for r in regions if r not in titled), *loose], key=place.get, reverse=True):
        n = anchor.parent
        while n is not None and n not in last and (n is anchor.parent or n.tag not in ("", "html", "body")):
            last[n] = place[anchor]
            n = n.parent
    for node in page.nodes:
        if node.parent is not None and (node.parent.inside or node in has_text and node not in other and place[node] < last.get(node.parent, -1)):
            node.inside = True


def extract_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    _drop_named(page)
    content = _content_paths(page.pieces)
    regions = _regions(page, content)
    if not regions:
        return ""
    for node in regions:
        node.inside = True
    for node in page.nodes:
        node.inside = node.inside or node.parent is not None and node.parent.inside
    outside = [(node, block) for node, block, text, _ in page.pieces if not node.inside and node.path in content and text.strip()]
    taken = {block for _, block in outside}  # blocks of content text outside the regions
    _take_headings(page, regions, list(dict.fromkeys(node for node, _ in outside)))
    blocks: list[str] = []
    current, number = [], None
    for node, block, text, _ in page.pieces:
        if not node.inside and block not in taken:
            continue
        if block != number:
            blocks.append("".join(current))
            current, number = [], block
        current.append(text)
    blocks.append("".join(current))
    return "\n".join(b for b in (_SPACE.sub(" ", x).strip() for x in blocks) if b)


def main_text(html_col: str) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([extract_text(p.as_py()) for p in pages], pa.string())

    return run(F.col(html_col))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text as a string column; no shuffle, one result per row."""
    return add_struct(pages, out_col, main_text(html_col))
