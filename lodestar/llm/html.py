"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with the path of open elements from the
root (tag and class) to the node. Elements that can't be article text by what
they are (scripts, styles, forms, menus, page headers and footers, asides) or
by what their class, id or role says (adverts, notices, sidebars, comments)
are passed over with all they hold. Blocks named as reader comments, adverts,
newsletters or cookie notices go wherever they stand, nested articles included.
Other words of the list (alert, related, search) may name article text: inside the
article, class and id of headings and inline elements and any id say nothing, and a
block whose class is on the list stays if its path has the ratio of the article's
other text. For the rest, text length and punctuation are aggregated per tag path:

- ratio of a path = (characters / nodes) * (1 + punctuation / nodes);
- the ratios are smoothed along the page with a Gaussian over neighbouring
  nodes, as content is contiguous;
- raw and smoothed ratio are fused (geometric mean), and a path is content if
  the fused ratio of its nodes, weighted by length, reaches a fraction of the
  page's standard deviation from the mean.

The content paths' nodes vote with their characters for a container: from the
root, the walk goes down to the child that holds nearly all votes, and stops at
an article, a main element or a fork. All remaining text of the container is
the result, so short paragraphs between long ones are kept whole.

Character references are decoded; white space inside a block becomes one space,
blocks are trimmed and joined by one space in page order. Inline elements don't
break a block; every other tag does.

Defined results: NULL, empty and textless pages give the empty string; broken
and unclosed markup is read leniently to the end of the page, however deep it
nests (nothing here recurses, and a path is a number, not a string), and any
``<!...>`` or ``<?...>`` is a comment; repeated pages
each give a row; an empty table gives an empty result. Extra columns are not
read unless they are carried.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of HTML: elements without content, elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
# Elements that never hold article text.
NEVER = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video map nav footer aside menu "
    "dialog form fieldset button select option optgroup datalist textarea input label legend".split()
)
# Words of class and id that mark what surrounds an article.
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos "
    "promotion promoted cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login register menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars "
    "widget widgets related recommended recommendations recommend share sharing social comment comments commentlist reply "
    "replies respond disqus discussion footer copyright disclaimer toolbar pagination pager skip sitemap search "
    "searchbox form masthead topbar".split()
)
# Words of a block's class or id that never name article text, and words that stand
# beside them in such names ("comment-list", "post-comments"; not "comments-open").
NEVER_NAMED = frozenset(
    "comments commentlist disqus advert adverts advertisement advertisements advertising adsense adslot sponsored "
    "newsletter cookie cookies gdpr".split()
)
NEVER_CLASS = NEVER_NAMED | {"comment"}
BESIDE = frozenset(
    "list area section body text thread threads block box wrapper wrap container item items unit slot banner top bottom "
    "inner outer main content post article page reader readers user users notice bar form signup hidden visible".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Open elements that a start tag closes.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: Where the search for an element to close ends.
SCOPE = frozenset("html body table div section article main aside nav header footer form ul ol dl blockquote".split())
CONTAINERS = frozenset("html body div section article main center table tbody thead tr td font span".split())
WHOLE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED_RATIO = 100.0  # of a listed block in an article: about a sentence a block
PUNCTUATION = re.compile(r"[.,;:!?、。，！？…¿¡\"'()]")
_TOKENS = re.compile(r"[a-z0-9]+")


def _named(names: list[str], never: frozenset[str]) -> bool:
    """Whether one of the names consists of words of ``never`` and words beside them."""
    for name in names:
        words = [w for w in _TOKENS.findall(name) if not w.isdigit()]
        if any(w in never for w in words) and all(w in never or w in BESIDE for w in words):
            return True
    return False


class Element:
    """An open element. What depends on its parents is settled when it is opened."""

    __slots__ = ("tag", "path", "parent", "skip", "listed", "whole", "plain", "title", "votes", "best", "part")

    def __init__(self, tag, path, parent, skip, listed=""):
        self.tag, self.path, self.parent, self.skip = tag, path, parent, skip
        self.listed = listed  # "class" or "id", whichever is on the list
        self.whole = tag in WHOLE or bool(parent and parent.whole)
        # outside of what the word list names, which inside an article or main
        # element doesn't settle what a heading, an inline element or an id is
        soft = self.whole and (listed == "id" or tag in INLINE or tag in HEADINGS)
        self.plain = (not listed or soft) and (parent is None or parent.plain)
        # the page's first heading is part of its text, however short
        self.title = tag == "h1" or bool(parent and parent.title)
        self.votes, self.best, self.part = 0, None, None


class TextNodes(HTMLParser):
    """Collects (element, block number, text) outside of skipped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paths: dict[tuple[int, str], int] = {}
        self.root = Element("", 0, None, False)
        self.elements = [self.root]  # parents before children
        self.open = [self.root]
        self.opened: dict[str, int] = {}  # open elements by tag
        self.block = 0
        self.nodes: list[tuple[Element, int, str]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in INLINE:
            self.block += 1
            self._close_implied(tag)
        if tag in VOID:
            return
        at = {k: v or "" for k, v in attrs}
        names = {k: at.get(k, "").lower() for k in ("class", "id")}
        classes, ids = (set(_TOKENS.findall(names[k])) for k in ("class", "id"))
        parent = self.open[-1]
        block = tag not in INLINE and tag not in HEADINGS and tag not in ("html", "body", "main")
        never = (
            block
            and (tag != "article" or parent.whole)
            and (_named(names["class"].split(), NEVER_CLASS) or _named([names["id"]], NEVER_NAMED))
        )
        skip = (
            parent.skip
            or never
            or tag in NEVER
            or (tag == "header" and not parent.whole)
            or ("header" in classes | ids and not parent.whole and tag not in WHOLE)
            or at.get("role", "").lower() in ROLES
            or "hidden" in at
            or "display:none" in at.get("style", "").lower().replace(" ", "")
        )
        listed = ""
        if tag not in ("html", "body", "article", "main"):
            listed = "class" if classes & NOT_CONTENT else "id" if ids & NOT_CONTENT else ""
        path = self.paths.setdefault((parent.path, f"{tag}.{at.get('class', '')}"), len(self.paths) + 1)
        e = Element(tag, path, parent, skip, listed)
        self.elements.append(e)
        self.open.append(e)
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def _close(self, first: int, last: int | None = None) -> None:
        for e in self.open[first:last]:
            self.opened[e.tag] -= 1
        del self.open[first:last]

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # "<p/>" opens a p in HTML

    def _close_implied(self, tag: str) -> None:
        closes = CLOSES.get(tag, set()) | {"p"}
        while any(self.opened.get(c) for c in closes):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in closes:
                    self._close(i)
                    break
                if self.open[i].tag in SCOPE:
                    return
            else:
                return
            if tag not in CLOSES:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        if not self.opened.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            e = self.open[i]
            if e.tag == tag:
                if tag in INLINE and any(x.tag not in INLINE for x in self.open[i + 1 :]):
                    self._close(i, i + 1)  # blocks inside go on
                else:
                    self._close(i)
                return
            # an end tag of a part doesn't close what holds it
            if tag not in SCOPE and e.tag in SCOPE:
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        e = self.open[-1]
        if not e.skip and data:
            self.nodes.append((e, self.block, data))


def path_scores(nodes: list[tuple[int, str]], spread: float = 1.5) -> list[float]:
    """Fused ratio of each (path, text) node."""
    chars: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for path, text in nodes:
        chars[path] = chars.get(path, 0) + len(text)
        marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(text))
        count[path] = count.get(path, 0) + 1
    raw = [chars[p] / count[p] * (1 + marks[p] / count[p]) for p, _ in nodes]
    reach = int(3 * spread)
    kernel = [math.exp(-(d * d) / (2 * spread * spread)) for d in range(-reach, reach + 1)]
    fused = []
    for i in range(len(raw)):
        lo, hi = max(0, i - reach), min(len(raw), i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        smooth = sum(a * b for a, b in zip(w, raw[lo:hi])) / sum(w)
        fused.append(math.sqrt(raw[i] * smooth))
    return fused


def content_paths(nodes: list[tuple[int, str]], fraction: float = 0.2) -> set[int]:
    """Paths whose fused ratio, weighted by length, reaches the threshold."""
    if not nodes:
        return set()
    fused = path_scores(nodes)
    mean = sum(fused) / len(fused)
    sd = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    weight: dict[int, int] = {}
    score: dict[int, float] = {}
    for (path, text), f in zip(nodes, fused):
        weight[path] = weight.get(path, 0) + len(text)
        score[path] = score.get(path, 0.0) + f * len(text)
    limit = min(mean, fraction * sd) if sd else mean * 0.5
    kept = {p for p in weight if score[p] / weight[p] >= limit}
    return kept or {max(weight, key=lambda p: (score[p], p))}


def _block_ratios(nodes) -> dict[int, float]:
    """Characters and punctuation by block and path, as ``path_scores`` has them by node."""
    chars: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, set[int]] = {}
    for path, block, text in nodes:
        if not text.isspace():
            chars[path] = chars.get(path, 0) + len(text)
            marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(text))
            count.setdefault(path, set()).add(block)
    return {p: chars[p] / len(count[p]) * (1 + marks[p] / len(count[p])) for p in chars}


def _container(elements: list[Element], whole: bool) -> Element:
    """From the root down to the child with nearly all votes, to an article or
    main element (``whole``), or to the lowest block that holds all votes."""
    at = elements[0]
    while not (whole and at.tag in WHOLE):
        best = at.best
        if best is None or (best.votes < 0.9 * at.votes if whole else best.tag in INLINE or best.votes < at.votes):
            break
        at = best
    return at


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = TextNodes()
    page.feed(html)
    page.close()
    # an article or main inside a listed part belongs to that part
    full = [(e, b, t) for e, b, t in page.nodes if not t.isspace() and e.plain]
    if not full:
        return ""
    paths = [(e.path, t) for e, _, t in full]
    kept = content_paths(paths)
    for (e, _, t), (p, _) in zip(full, paths):
        if p in kept or e.title:
            e.votes += len(t)
    for e in reversed(page.elements[1:]):  # children before parents
        e.parent.votes += e.votes
    for e in page.elements[1:]:
        if e.tag in CONTAINERS and (e.parent.best is None or e.votes > e.parent.best.votes):
            e.parent.best = e
    at = _container(page.elements, True)
    if at.tag not in WHOLE:
        at = _container(page.elements, False)
    # ``part``: the container, the outermost listed block inside it that holds the
    # element, or None
    at.part = at
    for e in page.elements[1:]:
        if e is at:
            continue
        v = e.parent.part
        if v is at and e.listed:
            if at.tag in ("", "html", "body"):  # all of the page, not a container
                v = None
            elif e.listed == "class" and e.tag not in INLINE and e.tag not in HEADINGS:
                v = e
        e.part = v
    held = [(e.part, b, t) for e, b, t in page.nodes if e.part is not None]
    ratios = _block_ratios((v.path if v is not at else -1, b, t) for v, b, t in held)
    own = ratios.get(-1, 0.0)
    blocks: list[list[str]] = []
    last = None
    for v, b, t in held:
        if v is at or ratios.get(v.path, 0.0) >= max(LISTED_RATIO, own):
            if b != last:
                blocks.append([])
                last = b
            blocks[-1].append(t)
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in blocks) if x)


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns, all but the html by default), text, n_chars."""
    carry = [c for c in pages.columns if c != html] if carry is None else carry
    slim = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(html).alias("h"))
    schema = T.StructType(
        [slim.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                texts = [main_text(h.as_py()) for h in batch.column(1).slice(s, 512)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, 512), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["row", "text", "n_chars"],
                )

    return slim.mapInArrow(run, schema)
