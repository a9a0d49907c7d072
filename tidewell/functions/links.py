"""Links: posting numbers, kinds, labels, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import ColumnLike, col, first_match, matches, text_or_blank


def host_of(link: ColumnLike) -> Column:
    return F.lower(text_or_blank(F.regexp_extract(text_or_blank(link), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def canon_key(link: ColumnLike, patterns: list[tuple[str, str]] | None = None) -> Column:
    """``site:number`` of the posting behind a link, NULL if unknown."""
    options = []
    for site, pattern in patterns or fixed.CANON_PATTERNS:
        number = first_match(link, pattern, 1, True)
        options.append(F.when(number.isNotNull(), F.concat(F.lit(f"{site}:"), number)))
    return F.coalesce(*options)


def job_id(company: ColumnLike, title: ColumnLike) -> Column:
    """Id from company and the letters and digits of the title."""
    letters = F.regexp_replace(text_or_blank(title), "[^0-9A-Za-z가-힣]", "")
    key = F.concat(text_or_blank(company), F.lit("|"), letters)
    return F.concat(F.lit("j-"), F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 16))


def link_kind(link: ColumnLike, direct_hosts=fixed.DETAIL_HOSTS, blocked_hosts=fixed.BLOCKED_HOSTS,
              number_pattern: str = r"rec_idx=(\d+)") -> Column:
    """How a posting's own page can be found: number / direct / blocked / search / none."""
    host = host_of(link)

    def on(hosts) -> Column:
        hit = F.lit(False)
        for h in hosts:
            hit = hit | F.contains(host, F.lit(h))
        return hit

    return (
        F.when(matches(link, number_pattern), "number")
        .when(on(direct_hosts) & ~matches(link, fixed.SEARCH_LINK), "direct")
        .when(on(blocked_hosts), "blocked")
        .when(host != "", "search")
        .otherwise("none")
    )


def site_label(link: ColumnLike) -> Column:
    """Display name of the site behind a link (I16)."""
    labels = fixed.SITE_LABELS
    out = F.when(F.contains(text_or_blank(link), F.lit(labels[0][0])), labels[0][1])
    for part, label in labels[1:]:
        out = out.when(F.contains(text_or_blank(link), F.lit(part)), label)
    return out.otherwise(fixed.SITE_LABEL_DEFAULT)


def web_link(link: ColumnLike) -> Column:
    """Only http(s) links leave the system (C17)."""
    return F.when(matches(link, r"^https?://"), col(link))


def representative_score(verify: ColumnLike, link: ColumnLike, source: ColumnLike, deadline: ColumnLike) -> Column:
    """4 verified + 2 direct link + 1 live source + 1 dated."""
    verified = F.contains(text_or_blank(verify), F.lit(fixed.VERIFIED_WORD)) & ~F.contains(
        text_or_blank(verify), F.lit(fixed.NEEDED_WORD))
    legacy = text_or_blank(source) == fixed.LEGACY_SOURCE
    return (
        verified.cast("int") * 4
        + matches(link, fixed.DIRECT_LINK).cast("int") * 2
        + (~legacy).cast("int")
        + matches(deadline, r"^\d{4}-").cast("int")
    )
