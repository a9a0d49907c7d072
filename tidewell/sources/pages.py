"""Landed career pages: anchors, list-like elements, page state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, first_match, html_to_text, let, matches, record, squeeze, static_html, strip_tags

_ANCHOR = r"(?is)<a\b[^>]*>.*?(?=<a\b|$)"
_ELEMENT = r"(?is)<(?:li|tr|article|div|p|section)\b[^>]*>(?:(?!<(?:li|tr|article|div|section)\b).)*?</(?:li|tr|article|div|p|section)>"
_LIST_LIKE = (
    r"(?is)^<(?:(?:li|tr|article)\b|[a-z]+\b[^>]*(?:class=[\"'][^\"']*(?:item|card|list)[^\"']*[\"']"
    r"|role=[\"']listitem[\"']|onclick=))"
)
_HEADING = (
    r"(?is)<(h[1-5]|strong|b)\b[^>]*>(.*?)</\1>|<[a-z]+\b[^>]*class=[\"'][^\"']*tit[^\"']*[\"'][^>]*>(.*?)</"
)


def _anchors(html: Column, net: str, title_length: tuple[int, int]) -> Column:
    """Anchors whose own text has a length of ``title_length`` and is inside the net; the whole text up to the next anchor is the block."""
    def read(piece: Column) -> Column:
        own = strip_tags(F.regexp_extract(piece, r"(?is)^<a\b[^>]*>(.*?)</a>", 1))
        around = strip_tags(piece)
        href = F.coalesce(
            first_match(piece, r"(?is)^<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\"", 1),
            first_match(piece, r"(?is)^<a\b[^>]*?\bhref\s*=\s*'([^']*)'", 1),
            F.regexp_extract(piece, r"(?is)^<a\b[^>]*?\bhref\s*=\s*([^\s\"'>]+)", 1))
        return record(title=own, href=href, block=around)

    found = F.transform(F.regexp_extract_all(html, F.lit(_ANCHOR), 0), read)
    fits = F.filter(found, lambda a: F.length(a["title"]).between(*title_length) & matches(a["title"], net, True))
    return F.array_distinct(fits)


def _elements(html: Column, net: str, block_length: tuple[int, int]) -> Column:
    """List-like elements for pages without usable anchors."""
    def read(piece: Column) -> Column:
        head = squeeze(strip_tags(F.coalesce(
            F.nullif(F.regexp_extract(piece, _HEADING, 2), F.lit("")), F.regexp_extract(piece, _HEADING, 3))))
        text = strip_tags(piece)
        return record(
            title=F.when(head != "", head).otherwise(text),
            href=F.lit(""), block=text)

    pieces = F.filter(F.regexp_extract_all(html, F.lit(_ELEMENT), 0), lambda p: p.rlike(_LIST_LIKE))
    found = F.transform(pieces, read)
    return F.array_distinct(F.filter(
        found, lambda e: F.length(e["block"]).between(*block_length) & matches(e["block"], net, True)))


def page_candidates(pages: DataFrame, net: str, html: str = "html", title_length: tuple[int, int] = (4, 220),
                    block_length: tuple[int, int] = (6, 400)) -> DataFrame:
    """One row per candidate of a page, in page order (A2, A3).

    Duplicates of (text, link) inside a page are dropped in place, and the
    fallback runs only where a page gave no anchor, so the scan needs no
    shuffle.  A candidate is an anchor whose text has a length of
    ``title_length``, or a list element with one of ``block_length``: shorter
    ones are icons, longer ones whole sections.  Titles and blocks stay whole.
    """
    keep = [c for c in pages.columns if c != html]
    bare = F.regexp_replace(F.col(html), r"(?is)<script\b[^>]*>.*?</script\s*>|<!--.*?-->", "")

    def distinct_anchors(items: Column) -> Column:
        """Same text and link counts once, whatever surrounds it."""
        keys = F.transform(items, lambda a: record(t=a["title"], h=a["href"]))
        return let(keys, lambda k: F.filter(items, lambda a, i: F.array_position(k, record(t=a["title"], h=a["href"])) == i + 1))

    items = let(let(_anchors(F.col("_bare"), net, title_length), distinct_anchors), lambda a: F.when(F.size(a) > 0, a).otherwise(_elements(F.col("_bare"), net, block_length)))
    return (
        pages.withColumn("_bare", bare)
        .select(*keep, F.posexplode(items).alias("pos", "item"))
        .select(*keep, "pos", "item.*")
    )


def is_blocked(html: Column, block_pattern: str | None) -> Column:
    """Little text and the wording of a bot check (A5)."""
    if not block_pattern:
        return F.lit(False)
    return let(_body_text(html), lambda t: (F.length(t) < 2000) & matches(t, block_pattern, True))


def _body_text(html: Column) -> Column:
    body = F.coalesce(first_match(html, r"(?is)<body\b[^>]*>(.*)</body>", 1), html)
    return squeeze(html_to_text(F.regexp_replace(body, r"(?s)<!--.*?-->", " ")))


def page_stats(pages: DataFrame, block_pattern: str | None = None, html: str = "html") -> DataFrame:
    """Text length, anchor count and fetch state per page (A4, A5)."""
    keep = [c for c in pages.columns if c != html]
    staged = pages.select(*keep, _body_text(F.col(html)).alias("_text"),
                          F.size(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\b"), 0)).alias("anchors"))
    length = F.length("_text")
    blocked = (length < 2000) & matches("_text", block_pattern, True) if block_pattern else F.lit(False)
    return staged.select(
        *keep, length.alias("text_len"), "anchors", (~blocked).alias("ok"),
        F.when(blocked, "BLOCKED").alias("error"))


def static_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    return pages.withColumn(html, static_html(col(html), col(url)))
