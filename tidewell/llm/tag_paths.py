"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf tag path.  Per path
the text length, the punctuation and the number of blocks are added up; the
ratios text per block and punctuation per block are fused, laid back on the
blocks in page order, smoothed over neighbours and cut at a threshold.  Parts
marked as something else (menus, adverts, comments and so on) are left out where
their paths fall below it or hold at most half of the page's score.  The text is
what the smallest element holds that holds all other blocks above the threshold.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .batches import text_batches

_NAME = re.compile(r"</?+([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_SPECIAL = re.compile(r"[>\"']")
_NUMBER = re.compile(r"&#(?:[xX]0*+([0-9a-fA-F]{7,})|0*+([0-9]{8,}));?")
"""References to numbers beyond all characters, of any length."""
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_STOPS = re.compile(r"[.,;:!?…。，、；：！？¿¡«»]")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noframes", "noembed"}
"""Elements whose content is no markup, or not shown."""
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
OTHER_PARTS = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "math", "object",
               "canvas", "audio", "video", "head", "fieldset", "label", *RAW}
OTHER_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
               "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "header", "masthead",
               "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
               "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "reply", "replies", "login",
               "signup", "search", "widget", "toolbar", "pagination", "pager", "contentinfo", "complementary", "form", "skip"}
HEADER_WORDS = {"header", "masthead"}
ARTICLE_WORDS = {"article", "post", "entry", "story", "content", "page"}
"""With one of these a header word names the head of the article, as <header> in an article does."""
STATE_FIRST, STATE_LAST = {"has", "no", "with", "without", "hide"}, {"enabled", "disabled", "free"}
"""A name such as has-sidebar or share-enabled tells of another element and marks nothing."""
LOOSE_PARTS = {"form", "fieldset", "label", "dialog"}
ARTICLE = {"article", "main"}
NO_CONTAINER = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "tbody", "thead", "tfoot", "table", "ul", "ol", "dl", "dt", "dd",
                "pre", "blockquote", "figure", "figcaption"}
"""Elements that are parts of an article, never all of it."""
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
              "option": {"option"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
           "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_WALLS = {"ul", "ol", "table", "div", "article", "section", "body", "main", "td", "th", "blockquote", "dl"}


@dataclass
class Block:
    """A run of text between block boundaries: number of its path, the innermost element that is not inline, its pieces with the first one's number."""

    path: int
    element: int
    first: int
    pieces: list[str]
    text: str
    linked: int

    def text_without(self, gone: np.ndarray) -> str:
        out = gone[self.first:self.first + len(self.pieces)]
        if not out.any():
            return self.text
        return " ".join("".join(t for t, o in zip(self.pieces, out) if not o).split())


@dataclass
class Elements:
    """Elements in page order, by number: an element's own are the numbers up to its ``last``.

    ``frames`` is the innermost element around one that is not inline, ``heads``
    the outermost h1 at or around it.  Of the marked ones ``marks`` holds whether
    the mark is plain and what alike ones share, ``spans`` the range of their pieces.
    ``articles`` counts the article elements around each, ``plain`` is the innermost plain mark at or around it.
    """

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    frames: list[int] = field(default_factory=list)
    paths: list[int] = field(default_factory=list)
    heads: list[int] = field(default_factory=list)
    articles: list[int] = field(default_factory=list)
    plain: list[int] = field(default_factory=list)
    marks: dict[int, tuple[bool, tuple]] = field(default_factory=dict)
    spans: dict[int, tuple[int, int]] = field(default_factory=dict)

    def shared(self, a: int, b: int) -> int:
        """The innermost element, not inline, that holds both; -1 for the page."""
        while a != b:
            a, b = (self.frames[a], b) if a > b else (a, self.frames[b])
        return a

    def holds(self, outer: int, inner: int) -> bool:
        return outer < 0 or outer <= inner <= self.last[outer]

    def articles_beside(self) -> list[int]:
        """Per element the articles that have no plain mark around them but those around the element itself, and do not hold it."""
        own = [0] * (len(self.tags) + 1)  # by innermost plain mark, the page last
        for e, tag in enumerate(self.tags):
            if tag in ARTICLE:
                own[self.plain[e]] += 1
        seen = [0] * len(self.tags)  # with their innermost plain mark at or around the element
        found = []
        for e, parent in enumerate(self.parents):
            around = seen[parent] if parent >= 0 else own[-1]
            seen[e] = around + own[e]
            found.append(around - self.articles[e])
        return found


class Sums:
    """Running sums of weights that are taken away one by one (a Fenwick tree)."""

    def __init__(self, weights: list[float]):
        self.tree = [0.0, *weights]
        for i in range(1, len(self.tree)):
            up = i + (i & -i)
            if up < len(self.tree):
                self.tree[up] += self.tree[i]

    def before(self, i: int) -> float:
        total = 0.0
        while i:
            total += self.tree[i]
            i &= i - 1
        return total

    def take(self, i: int, weight: float) -> None:
        i += 1
        while i < len(self.tree):
            self.tree[i] -= weight
            i += i & -i


def _marked(tag: str, attributes: str, in_article: bool) -> bool | None:
    """None without a mark; else whether it is plain: a tag or a whole name, not a part of a longer name."""
    if tag in OTHER_PARTS:
        return None if tag == "header" and in_article else tag not in LOOSE_PARTS
    if not attributes or tag in ARTICLE or tag in ("html", "body"):
        return None
    mark = None
    for m in _MARK.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _PARTS.findall(name)]
            if len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST):
                continue
            found = OTHER_WORDS.intersection(words)
            if in_article or not ARTICLE_WORDS.isdisjoint(words):
                found -= HEADER_WORDS
            if found:
                mark = mark or not any(w not in found and not w.isdigit() for w in words)
    return mark


class Markup:
    """Ends of the tags and declarations of a page, whatever is left open in it, in time linear in the page.

    A tag without an end is tried in full once; from then on every sign that was
    seen on such a vain way is remembered, so no part is walked twice.
    """

    def __init__(self, page: str):
        self.page = page
        self.careful = False
        self.vain: set[int] = set()
        self.near = (0, -1)  # no special sign lies between these two but the second
        self.open_end = False  # no > from here on

    def tag_end(self, at: int) -> int:
        """Behind the > that ends the attributes at ``at``; -1 without one."""
        if not self.careful:
            m = _REST.match(self.page, at)
            if m:
                return m.end()
            self.careful = True
        if self.near[0] <= at <= self.near[1]:
            special = self.near[1]
        else:
            special = self._special(at)
            self.near = (at, special)
        way = []
        while special < len(self.page) and special not in self.vain:
            sign = self.page[special]
            if sign == ">":
                return special + 1
            way.append(special)
            close = self.page.find(sign, special + 1)
            if close < 0:
                break
            special = self._special(close + 1)
        self.vain.update(way)
        return -1

    def _special(self, at: int) -> int:
        m = _SPECIAL.search(self.page, at)
        return m.start() if m else len(self.page)

    def declaration_end(self, at: int) -> int:
        end = -1 if self.open_end else self.page.find(">", at)
        self.open_end = end < 0
        return end + 1 if end >= 0 else -1


def _plain_text(raw: str) -> str:
    """Character references decoded; numbers beyond all characters become the replacement character."""
    return html.unescape(_NUMBER.sub("\ufffd", raw)) if "&" in raw else raw


def blocks_of(page: str) -> tuple[list[Block], Elements]:
    """Text blocks in page order, and the elements of the page."""
    blocks: list[Block] = []
    stack: list[int] = []
    places: dict[str, list[int]] = {}  # tag -> where it stands in the stack
    walls: list[int] = []
    elements = Elements()
    markup = Markup(page)
    names: dict[tuple[int, str], int] = {}  # (path around, tag) -> path
    pieces: list[str] = []
    linked = flushed = 0  # flushed: pieces of earlier blocks

    def frame() -> int:
        if not stack:
            return -1
        return stack[-1] if elements.tags[stack[-1]] not in INLINE else elements.frames[stack[-1]]

    def flush() -> None:
        nonlocal pieces, linked, flushed
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                inner = frame()
                blocks.append(Block(elements.paths[inner] if inner >= 0 else 0, inner, flushed, pieces, text, linked))
            flushed += len(pieces)
        pieces, linked = [], 0

    def shut(place: int) -> None:
        while len(stack) > place:
            number = stack.pop()
            tag = elements.tags[number]
            places[tag].pop()
            if tag in _WALLS:
                walls.pop()
            elements.last[number] = len(elements.tags) - 1
            if number in elements.marks:
                elements.spans[number] = elements.spans[number][0], flushed + (len(pieces) if tag in INLINE else 0)

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = _plain_text(raw)
            pieces.append(text)
            if places.get("a"):
                linked += len(text)

    size = len(page)
    at = start = 0  # start: where the text not yet taken begins
    while True:
        at = page.find("<", at)
        if at < 0:
            say(page[start:])
            break
        if page.startswith("<!", at) or page.startswith("<?", at):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = end + 3 if end >= 0 else size
            else:
                end = markup.declaration_end(at + 2)
            if end < 0:
                at += 1
                continue
            say(page[start:at])
            at = start = end
            continue
        name = _NAME.match(page, at)
        end = markup.tag_end(name.end()) if name else -1
        if end < 0:
            at += 1
            continue
        say(page[start:at])
        closing, tag, attributes = page[at + 1] == "/", name[1].lower(), page[name.end():end - 1]
        at = start = end
        if closing:  # up to the nearest open one, not beyond a cell or container
            open_ones = places.get(tag)
            if open_ones and not (tag in INLINE and walls and walls[-1] > open_ones[-1]):
                if tag not in INLINE:
                    flush()
                shut(open_ones[-1])
            continue
        if tag not in INLINE:
            flush()
            if tag == "body" and stack and elements.tags[stack[-1]] == "head":
                shut(len(stack) - 1)
            closes = _CLOSED_BY.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            nearest = max((places[c][-1] for c in closes if places.get(c)), default=-1)
            if nearest >= 0 and not (walls and walls[-1] > nearest):
                shut(nearest)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
            at = start = close.end() if close else size
            continue
        number, parent, outer = len(elements.tags), stack[-1] if stack else -1, frame()
        in_article = bool(places.get("article") or places.get("main"))
        mark = _marked(tag, attributes, in_article)
        path = 0
        if tag not in INLINE:
            path = names.setdefault((elements.paths[outer] if outer >= 0 else 0, tag), len(names) + 1)
        above = elements.heads[parent] if parent >= 0 else -1
        elements.tags.append(tag)
        elements.parents.append(parent)
        elements.last.append(number)
        elements.frames.append(outer)
        elements.paths.append(path)
        elements.heads.append(number if above < 0 and tag == "h1" else above)
        elements.articles.append(elements.articles[parent] + (elements.tags[parent] in ARTICLE) if parent >= 0 else 0)
        elements.plain.append(number if mark else elements.plain[parent] if parent >= 0 else -1)
        if mark is not None:
            elements.marks[number] = mark, (number,) if mark else (parent, tag, attributes)
            begin = flushed + len(pieces)
            elements.spans[number] = begin, begin
        places.setdefault(tag, []).append(len(stack))
        if tag in _WALLS:
            walls.append(len(stack))
        stack.append(number)
    flush()
    shut(0)
    return blocks, elements


def fused_scores(blocks: list[Block], width: float = 1.0) -> np.ndarray:
    """Smoothed tag-path score of every block."""
    number: dict[int, int] = {}
    of = np.array([number.setdefault(b.path, len(number)) for b in blocks])
    length = np.array([len(b.text) - b.linked for b in blocks], float)
    stops = np.array([len(_STOPS.findall(b.text)) for b in blocks], float)
    count = np.bincount(of)
    text_ratio = np.bincount(of, length) / count
    stop_ratio = np.bincount(of, stops) / count
    score = np.sqrt(np.maximum(text_ratio, 0) * (1 + stop_ratio))[of]
    reach = int(3 * width)
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * width ** 2))
    padded = np.pad(score, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def marked_pieces(blocks: list[Block], elements: Elements, score: np.ndarray, bar: float) -> np.ndarray:
    """Pieces to leave out: those in marked elements below ``bar``, or that hold at most half of the score (by length of unlinked text) of what is left.

    Inner ones come first, so a wrapper is judged by what stays in it; loosely
    marked ones come last, and alike ones of one parent count as one.  A plain
    mark also goes by where an article element stands beside it.
    """
    pieces = blocks[-1].first + len(blocks[-1].pieces)
    weight, high = [0.0] * pieces, [0] * pieces
    for b, s in zip(blocks, score):
        each = s * max(len(b.text) - b.linked, 0) / max(sum(map(len, b.pieces)), 1)
        for i, text in enumerate(b.pieces, b.first):
            weight[i], high[i] = each * len(text), int(s >= bar)
    alike: dict[tuple, list[int]] = {}
    for e, (_, key) in elements.marks.items():
        if elements.spans[e][0] < min(elements.spans[e][1], pieces):
            alike.setdefault(key, []).append(e)
    gone = np.zeros(pieces, bool)
    if not alike:
        return gone
    beside = elements.articles_beside()
    left, highs, total = Sums(weight), Sums(high), sum(weight)
    following = list(range(pieces + 1))  # the next piece still there

    def standing(i: int) -> int:
        while following[i] != i:
            following[i] = following[following[i]]
            i = following[i]
        return i

    for members in sorted(alike.values(), key=lambda m: (not elements.marks[m[0]][0], -m[-1])):
        spans = [(elements.spans[e][0], min(elements.spans[e][1], pieces)) for e in members]
        some_high = sum(highs.before(b) - highs.before(a) for a, b in spans) > 0.5
        if some_high and sum(left.before(b) - left.before(a) for a, b in spans) > 0.5 * total * (1 + 1e-9):  # half is no more than half, however it is rounded
            if not (elements.marks[members[0]][0] and beside[members[0]] > 0):
                continue
        for a, b in spans:
            i = standing(a)
            while i < b:
                gone[i] = True
                left.take(i, weight[i])
                highs.take(i, high[i])
                total -= weight[i]
                following[i] = i + 1
                i = standing(i)
    return gone


def main_text(page: str, width: float = 1.0) -> str:
    """The article of one page; empty if the page has no text of its own."""
    blocks, elements = blocks_of(page)
    if not blocks:
        return ""
    score = fused_scores(blocks, width)
    bar = min(score.std(), score.max())
    gone = marked_pieces(blocks, elements, score, bar)
    kept = [(b, s, b.text_without(gone)) for b, s in zip(blocks, score)]
    kept = [k for k in kept if k[2]]
    if not kept:
        return ""
    bar = min(bar, max(s for _, s, _ in kept))
    chosen = [b.element for b, s, _ in kept if s >= bar]
    shared = elements.shared(min(chosen), max(chosen))  # what the first and the last share all share
    while shared >= 0 and elements.tags[shared] in NO_CONTAINER:
        shared = elements.frames[shared]
    held = [elements.holds(shared, b.element) for b, _, _ in kept]
    heads = [elements.heads[b.element] if b.element >= 0 else -1 for b, _, _ in kept]
    if not any(on and h >= 0 for on, h in zip(held, heads)):  # the headline may stand before the article's element
        before = [h for h in heads[:held.index(True)] if h >= 0]
        held = [on or bool(before) and h == before[-1] for on, h in zip(held, heads)]
    return " ".join(text for (_, _, text), on in zip(kept, held) if on)


def page_text(page: Column, batch_bytes: int = 1 << 20) -> Column:
    """Main text of a column of pages (string, empty if none)."""
    @arrow_udf("string")
    def extract(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([main_text(p) for pages in text_batches(column, batch_bytes) for p in pages], pa.string())

    return extract(page)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page.

    A null page is empty and gives an empty text.  Rows are independent, so
    repeated rows, null ids and null urls stay as they are; other columns are
    not read.  A page without markup is one block and is returned whole.
    """
    text = page_text(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias("text")
    return pages.select(id_col, url_col, text).withColumn("n_chars", F.length("text").cast("long"))
