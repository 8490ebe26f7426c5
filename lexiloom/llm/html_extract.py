"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of block elements from the root (inline markup adds no step; a step is
a tag with its class, id and role, numbers left out). Over all nodes of a path, text length and punctuation are added up
and divided by the number of nodes there: long, punctuated text is content, short labels and linked words are not (linked
text adds no length). The logarithms of both ratios are added; the sum is smoothed over the path tree, by the paths that
have text of their own beside it, beside its parent and so on up, so that a heading or a list in an article gains from the
paragraphs next to it; and it is fused with what the steps' tags, roles and names are worth (``STEP_WORTH``,
``NAME_WORTH``: an article adds, navigation, footers, forms, asides, comments and adverts take away). Paths whose score
reaches ``threshold`` times the page's level (the mean over its text, without navigation and the like; an article raises
it by ``LEVEL_SHARE`` of its worth, which sets other text back) are content, and all blocks on them, in page order, are the result. The threshold decides on every page: at 0 all text stays, at a
large one none.

Defined results: null and empty pages, and pages without text, give the empty string; unclosed elements end where their
parent or a like element begins or ends; a page that ends within a tag or comment loses that tag only; a quote that is
never closed is a letter of its tag; character references are decoded, unfinished ones stay text; repeated rows are read
each; further columns are dropped. Time and memory grow in proportion to a page: paths are interned, what a closing tag
can close is known from counts, and a failed match is not tried again.
"""

from __future__ import annotations

import functools
import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm.common import bounded_batches, slices

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*+)([^>]*+)>")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "noembed", "noframes", "svg", "math", "object", "select", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var label wbr img".split())
#: What a step is worth by its tag, its role, and the words in its class and id; natural logarithms, added along a path.
ARTICLE_WORTH, LEVEL_SHARE = 9.0, 2 / 3
STEP_WORTH = {"article": ARTICLE_WORTH, "main": ARTICLE_WORTH, "nav": -10.0, "footer": -10.0, "aside": -10.0, "form": -10.0, "head": -10.0, "menu": -10.0, "dialog": -10.0, "button": -10.0, "fieldset": -10.0, "datalist": -10.0, "header": -10.0}
ROLE_WORTH = dict.fromkeys(
    ("navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alertdialog", "alert", "form", "toolbar", "status"), -10.0
)
NAME_WORTH = dict.fromkeys(
    (
        "ad", "ads", "adsense", "adv", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent",
        "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
        "notices", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommendations", "recommended", "related", "replies", "reply", "respond", "share",
        "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
    ), -10.0,
)
HIDDEN_WORTH = -20.0
#: Elements that a new paragraph ends, or that end one; bits of the elements that a like one ends, and where that stops.
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_BITS = {t: 1 << i for i, t in enumerate(("p", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "option"))}
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",),
}
_ENDED = {t: sum(_BITS[x] for x in xs) for t, xs in _ENDS.items()}
_FENCED = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt", "dd"), "table": ("p", "td", "th", "tr", "thead", "tbody"), "td": ("p",), "th": ("p",), "button": ("p",), "select": ("option",)}
_OPEN_BELOW = {t: ~sum(_BITS[x] for x in xs) for t, xs in _FENCED.items()}
_PUNCT = re.compile(r"[.,;:!?…。，、！？»“”]")
_SPACE = re.compile(r"\s+")
#: Weights of a path's own ratio, of those beside it, beside its parent and so on; lengths and marks at which ratios level off.
NEAR = (0.3, 0.4, 0.2, 0.1, 0.1, 0.1, 0.1)
LONG, RICH = 200.0, 10.0
#: What a path outside an article loses if all of its text is linked.
LINKED_COST = 3.0


@functools.lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


class Path:
    """A step of the path tree; equal steps under one parent are one."""

    __slots__ = ("parent", "worth", "article", "steps", "chars", "linked", "marks", "nodes", "content")

    def __init__(self, parent: Path | None, worth: float, article: bool):
        self.parent, self.worth, self.article = parent, worth, article
        self.steps: dict[str, Path] = {}
        self.chars = self.linked = self.marks = self.nodes = 0
        self.content = False

    def step(self, tag: str, attrs: str) -> Path:
        marks = sorted({(m[1].lower(), _CAMEL.sub(r"\1 \2", (m[2] or "").strip("\"'"))) for m in _ATTR.finditer(attrs)}) if attrs else []
        words = {(name, w) for name, value in marks for w in (_NAME.findall(value.lower()) or [""])}
        label = tag + "".join(f" {name}.{w}" for name, w in sorted(words))
        known = self.steps.get(label)
        if known is None:
            article = tag in ("article", "main") or ("role", "main") in words or ("role", "article") in words or ("itemprop", "article") in words
            if article:
                worth = 0.0 if self.article else ARTICLE_WORTH
            else:
                worth = 0.0 if tag == "header" and self.article else STEP_WORTH.get(tag, 0.0)
            if tag not in ("html", "body", "main"):
                worth += min([(ROLE_WORTH if name == "role" else NAME_WORTH).get(w, 0.0) for name, w in words if name in ("role", "class", "id")], default=0.0)
            if any(name == "hidden" or (name, w) == ("aria-hidden", "true") for name, w in words):
                worth += HIDDEN_WORTH
            known = self.steps[label] = Path(self, self.worth + worth, self.article or article)
        return known

    @property
    def ratio(self) -> float:
        """Logarithms of unlinked text and of punctuation by node, added; both level off where a node is long anyway."""
        text, marks = (self.chars - self.linked) / self.nodes, self.marks / self.nodes
        return math.log1p(text * LONG / (text + LONG)) + math.log1p(marks * RICH / (marks + RICH))


class _Element:
    __slots__ = ("tag", "path", "open")

    def __init__(self, tag: str, path: Path, open_: int):
        self.tag, self.path, self.open = tag, path, open_


def text_nodes(page: str) -> tuple[Path, list[tuple[int, Path, str, bool]]]:
    """The root of the path tree, and in page order: (number of the block, its path, raw text of a node in it, linked)."""
    root = Path(None, 0.0, False)
    stack = [_Element("", root, 0)]
    opened: dict[str, int] = {}
    nodes: list[tuple[int, Path, str, bool]] = []
    block = at = links = 0
    n, tag_at = len(page), _TAG

    def pop_to(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    def end(bits: int) -> None:
        """Ends the elements of these kinds that are open here."""
        while stack[-1].open & bits:
            i = len(stack) - 1
            while not _BITS.get(stack[i].tag, 0) & bits:
                i -= 1
            pop_to(i)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            nodes.append((block, stack[-1].path, page[at:], links > 0))
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if lt > at:
                nodes.append((block, stack[-1].path, page[at:lt], links > 0))
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = n if close < 0 else close + 3
            else:
                close = page.find(">", lt)
                at = n if close < 0 else close + 1
            continue
        if not (nxt.isascii() and nxt.isalpha() or nxt == "/" and page[lt + 2 : lt + 3].isalpha()):  # a bare sign is text
            nodes.append((block, stack[-1].path, page[at : lt + 1], links > 0))
            at = lt + 1
            continue
        if lt > at:
            nodes.append((block, stack[-1].path, page[at:lt], links > 0))
        m = tag_at.match(page, lt)
        if m is None and tag_at is _TAG:  # all later signs stand in quotes: from here on, a tag ends at the first sign
            tag_at = _PLAIN_TAG
            m = tag_at.match(page, lt)
        if m is None:
            if page.find(">", lt) < 0:
                break
            at = lt + 1
            continue
        at = m.end()
        tag, empty = m[2].lower(), m[3].endswith("/")
        if m[1]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
                continue
            block += 1
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                pop_to(i)
                links = 0
            continue
        if tag in RAW:
            if not empty:
                close = _closing(tag).search(page, at)
                at = close.end() if close else n
            continue
        if tag in INLINE:
            links = 1 if tag == "a" else links
            continue
        block += 1
        if tag in VOID:
            continue
        if tag in _ENDS_P:
            end(_BITS["p"])
        if tag in _ENDED:
            end(_ENDED[tag])
        up = stack[-1]
        if not empty:
            stack.append(_Element(tag, up.path.step(tag, m[3]), up.open & _OPEN_BELOW.get(tag, -1) | _BITS.get(tag, 0)))
            opened[tag] = opened.get(tag, 0) + 1
    return root, nodes


def main_text(page: str | None, threshold: float = 0.04) -> str:
    """The article of a page, its blocks joined by a blank."""
    if not page:
        return ""
    _, nodes = text_nodes(page)
    paths: list[Path] = []
    before: tuple[int, Path] | None = None
    for block, path, text, linked in nodes:
        size = len(text.strip())
        if not size:
            continue
        if not path.nodes:
            paths.append(path)
        path.nodes += before != (block, path)
        path.chars += size
        if linked:
            path.linked += size
        else:
            path.marks += len(_PUNCT.findall(text))
        before = block, path
    if not paths:
        return ""
    # by parent: the mean ratio, by length of text, of the paths that have text of their own right under it
    beside: dict[Path | None, list[float]] = {}
    for p in paths:
        own = beside.setdefault(p.parent, [0.0, 0.0])
        own[0] += p.ratio * p.chars
        own[1] += p.chars
    smooth: dict[Path, float] = {}
    for p in paths:
        total, weight, up = NEAR[0] * p.ratio, NEAR[0], p.parent
        for w in NEAR[1:]:
            if up is None:
                break
            own = beside.get(up)
            if own:
                total, weight = total + w * own[0] / own[1], weight + w
            up = up.parent
        smooth[p] = total / weight - (0.0 if p.article else LINKED_COST * p.linked / p.chars)
    fine = [p for p in paths if p.worth >= 0] or paths
    chars = sum(p.chars for p in fine)
    level = sum(math.exp(smooth[p] + LEVEL_SHARE * p.worth) * p.chars for p in fine) / chars
    for p in paths:
        p.content = math.exp(smooth[p] + p.worth) >= threshold * level
    blocks: list[list] = []
    for block, path, text, _ in nodes:
        if path.content:
            if not blocks or blocks[-1][0] != block:
                blocks.append([block, []])
            blocks[-1][1].append(text)
    out = (_SPACE.sub(" ", _html.unescape("".join(parts))).strip() for _, parts in blocks)
    return " ".join(x for x in out if x)


def extract(pages: DataFrame, threshold: float = 0.04) -> DataFrame:
    """page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = [main_text(x, threshold) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
