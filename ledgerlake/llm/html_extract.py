"""Main text of web pages from streaming parser events.

The standard library's parser turns a page into lines, one for each run of text between block tags, with the number of
tags met on the way.  A line's ratio is its text length by its tags; the ratios are smoothed with a Gaussian and clustered
by a threshold between two means into content and the rest.  Lines inside elements that name themselves a menu, header,
footer, advert, notice, script or comments never count.  The content lines choose the region: the article (or main)
elements that hold them, else the innermost container of nearly all their text, without the lists of links in it.  They
also decide what names alone can't: a form, sidebar or header around nearly all content is a wrapper and stays, and a
"related" part stays if it reads like content.  Every other line of the region is returned, short ones too.  A page is one
row and needs nothing else: the only stage is a map without shuffle, in time and memory linear in the page (about 20 bytes
of memory a byte of markup).

Results for unusual input: null, empty and markup-only pages have empty text; text outside any element counts as the
page's body; repeated rows are extracted one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

SIGMA = 1.0
#: Two clusters of ratios are two if their means are a factor of two apart.
APART = float(np.log(2))
#: A region or wrapper holds this share of the content.
HOLDS = 0.8
#: A part mostly without content whose text is links by this share is a menu.
MENU = 0.6
CONTENT, LINKS, LAYOUT, EXCLUDED = range(4)

BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
EXCLUDED_TAGS = frozenset("head title nav header footer aside script style noscript template iframe object svg math button select textarea menu dialog search canvas audio video map fieldset label datalist".split())
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
EXCLUDED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored sponsors promo promotion sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer footers header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay alert comment comments commentlist disqus discussion respond reply replies related recommended share sharing social newsletter subscribe subscription signup login search widget widgets toolbar pagination pager copyright paywall".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that a new element of the given kind ends when they are still open.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS = frozenset("table ul ol dl article main section div body html nav aside footer header form".split())


#: Words that a part of the article itself may carry: its ratios and links decide.
LINK_WORDS = frozenset("related recommended".split())
#: Layout words that may also name a wrapper around the article itself.
LAYOUT_WORDS = frozenset("sidebar sidebars header footer nav navbar navigation menu banner topbar widget widgets toolbar modal overlay search login social share sharing".split())
_NEGATED = frozenset("has with no without hide hides show shows".split())


def kind_of(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """How an element counts by its tag, role, class and id."""
    if tag in EXCLUDED_TAGS:
        return EXCLUDED
    if tag in ("html", "body", "main"):
        return CONTENT
    kind = LAYOUT if tag == "form" else CONTENT
    for k, v in attrs:
        if v and k == "role" and v.strip().lower() in EXCLUDED_ROLES:
            return EXCLUDED
        if v and k in ("class", "id"):
            found = [w.lower() for w in _WORD.findall(v)]
            found = {w for w, before in zip(found, ["", *found], strict=False) if before not in _NEGATED}
            bad = found & ({"comment", "comments", "ad", "advert", "sponsored"} if tag == "article" else EXCLUDED_WORDS)
            if bad - LAYOUT_WORDS - LINK_WORDS:
                return EXCLUDED
            if bad:
                kind = max(kind, LAYOUT if bad & LAYOUT_WORDS else LINKS)
    return kind


class Lines(HTMLParser):
    """Elements of a page with their parents, and its lines: text, tags met, element, characters inside links.

    Every event costs a constant: the innermost open element of each kind is known, and nothing copies the open ones.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.kind = ["#page"], [0], [CONTENT]  # by element
        self.text: list[str] = []  # by line
        self.tags: list[int] = []
        self.at: list[int] = []
        self.linked: list[int] = []
        self.stack = [0]
        self.where: dict[str, list[int]] = {}  # depths at which elements of a tag are open
        self.blocks: list[int] = []
        self.keeps: list[int] = []
        self.parts: list[str] = []
        self.links = self.met = 0

    def line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.text.append(text)
            self.tags.append(self.met)
            self.at.append(self.stack[-1])
            self.linked.append(min(self.links, len(text)))
            self.met = 0
        self.parts, self.links = [], 0

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.tag[self.stack.pop()]
            self.where[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in _KEEPS:
                self.keeps.pop()

    def innermost(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kind = kind_of(tag, attrs)
        if tag in BLOCKS or kind:
            self.line()
        self.met += 1
        if tag in VOID:
            return
        if tag in BLOCKS:
            p = self.innermost(("p",))
            if p and self.blocks[-1] == p:  # an open paragraph ends, with the inline elements left open in it
                self.close_to(p)
            head = self.innermost(("head",))
            if head and tag != "title":
                self.close_to(head)
        end = self.innermost(_ENDS.get(tag, ()))
        if end and end > (self.keeps[-1] if self.keeps else 0):
            self.close_to(end)
        depth = len(self.stack)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.kind.append(kind)
        self.stack.append(len(self.tag) - 1)
        self.where.setdefault(tag, []).append(depth)
        if tag in BLOCKS:
            self.blocks.append(depth)
        if tag in _KEEPS:
            self.keeps.append(depth)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "path", "circle", "rect", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.line()
        self.met += 1
        depth = self.innermost((tag,))
        # an inline or paragraph end tag doesn't reach outside its container
        if not depth or (tag not in _KEEPS and self.keeps and self.keeps[-1] > depth):
            return
        if self.kind[self.stack[depth]] and tag not in BLOCKS:
            self.line()
        self.close_to(depth)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.where.get("a"):
            self.links += len(data.strip())


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    r = max(1, int(np.ceil(2 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    weight = np.convolve(np.ones(len(x)), k)[r : r + len(x)]
    return np.convolve(x, k)[r : r + len(x)] / weight


def content_lines(size: np.ndarray, tags: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Lines of the upper of two clusters of smoothed text-to-tag ratios (on a log scale); all if they don't part."""
    ratio = np.log1p(smooth(np.where(open_, size / np.maximum(1, tags), 0)))
    x = ratio[open_]
    lo, hi = x.min(), x.max()
    if hi - lo < APART:
        return open_
    for _ in range(20):
        cut = (lo + hi) / 2
        low, high = x[x < cut].mean(), x[x >= cut].mean()
        if (low, high) == (lo, hi):
            break
        lo, hi = low, high
    return open_ & (ratio >= (lo + hi) / 2) if hi - lo >= APART else open_


def main_text(html: str) -> str:
    p = Lines()
    p.feed(html)
    p.close()
    p.line()
    if not p.text:
        return ""
    n = len(p.tag)
    at, size = np.array(p.at), np.array([len(t) for t in p.text], float)

    def upwards(of_lines: np.ndarray) -> np.ndarray:
        """Sums over all lines inside each element; an element comes after its parent."""
        total = np.bincount(at, of_lines, n).tolist()
        for e in range(n - 1, 0, -1):
            total[p.parent[e]] += total[e]
        return np.array(total)

    def inside(chosen) -> list[bool]:
        """Whether each element is one of ``chosen`` (a flag by element) or lies in one."""
        out = [bool(chosen[0])] + [False] * (n - 1)
        for e in range(1, n):
            out[e] = bool(chosen[e]) or out[p.parent[e]]
        return out

    never = inside([k == EXCLUDED for k in p.kind])
    open_ = ~np.array(never)[at]
    if not open_.any():
        return ""
    content = content_lines(size, np.array(p.tags), open_)
    weight = upwards(size * content)
    # a form or a layout part around nearly all content, or around the only article, is a wrapper of the page
    articles = [e for e in range(1, n) if p.tag[e] in ("article", "main") and not never[e]]
    in_layout = inside([k == LAYOUT for k in p.kind])
    wrapped = np.zeros(n)
    if articles and all(in_layout[e] for e in articles):
        wrapped[articles] = 1
        for e in range(n - 1, 0, -1):
            wrapped[p.parent[e]] += wrapped[e]
    all_, linked = upwards(size * open_), upwards(np.array(p.linked) * open_)
    hidden = inside([
        k == EXCLUDED or (k == LAYOUT and not wrapped[e] and weight[e] < HOLDS * weight[0]) or (k == LINKS and not (2 * weight[e] > all_[e] and 2 * linked[e] < all_[e]))
        for e, k in enumerate(p.kind)
    ])
    good = ~np.array(hidden)[at]
    if not good.any():
        return ""
    content &= good
    if not content.any():
        content = good
    weight = upwards(size * content)
    held = [e for e in articles if weight[e] and not hidden[e]]
    if held:
        first = "article" if any(p.tag[e] == "article" for e in held) else "main"
        region = {e for e in held if p.tag[e] == first}
        menus = [False] * n
    else:
        # the innermost container of nearly all content, without its lists of links
        region = {max((e for e in range(1, n) if p.tag[e] in _KEEPS and weight[e] >= HOLDS * weight[0]), default=0)}
        menus = [p.tag[e] in _KEEPS and 0 < all_[e] > 2 * weight[e] and linked[e] >= MENU * all_[e] for e in range(n)]
    keep = np.array(inside([e in region for e in range(n)])) & ~np.array(inside(menus))
    return " ".join(t for t, k in zip(p.text, (keep[at] & good).tolist(), strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html)."""
    prepare(pages.sparkSession)

    def work(batches):
        for b in batches:
            found = [main_text(x.as_py() or "") for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
