"""Organisation names: normal forms, variants, aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import ColumnLike, col, first_match, let, record, rx, text_or_blank


def normalize_org(c: ColumnLike, level: str = "posting") -> Column:
    """Name without legal form and punctuation.

    Levels differ in what they strip; see ``fixed.ORG_LEVELS``.  The registry
    level upper-cases, the others lower-case.
    """
    legal, noise = fixed.ORG_LEVELS[level]
    bare = F.regexp_replace(text_or_blank(c), rx(f"{legal}|{noise}"), "")
    return F.upper(bare) if level == "registry" else F.lower(bare)


def org_fold(c: ColumnLike) -> Column:
    """Spelling-independent name: English words to Korean, then Korean to initials."""
    out = F.lower(F.split(text_or_blank(c), "→", 2)[0])
    for english, korean in fixed.EN_TO_KO:
        out = F.replace(out, F.lit(english), F.lit(korean))
    out = F.lower(F.regexp_replace(out, rx(fixed.LEGAL_FULL + r"|\s|[·.,\-&]"), ""))
    for korean, initials in fixed.KO_TO_EN:
        out = F.replace(out, F.lit(korean), F.lit(initials))
    return out


def org_variants(c: ColumnLike) -> Column:
    """All spellings of a name: inside and outside brackets, without the group word."""
    suffix = fixed.GROUP_SUFFIX

    def build(n: Column) -> Column:
        bracketed = r"^(.*?)[(（](.*?)[)）]$"
        base = F.array(
            F.regexp_replace(n, "[()（）]", ""),
            F.when(n.rlike(bracketed), F.regexp_extract(n, bracketed, 1)),
            F.when(n.rlike(bracketed), F.regexp_extract(n, bracketed, 2)),
        )
        plain = F.transform(base, lambda x: F.when(F.endswith(x, F.lit(suffix)),
                                                   F.substring(x, F.lit(1), F.length(x) - len(suffix))))
        return F.array_sort(F.array_distinct(F.filter(F.concat(base, plain), lambda x: F.length(x) >= 2)))

    return let(org_fold(c), build)


def org_mentions(c: ColumnLike) -> Column:
    """Strings to cut from a title so that the poster's own name does not count, longest first."""
    raw = F.lower(F.regexp_replace(F.split(text_or_blank(c), "→", 2)[0], rx(fixed.LEGAL_BASIC + r"|\s"), ""))
    names = F.filter(F.array_union(org_variants(c), F.array(raw)), lambda x: F.length(x) >= 2)
    return F.transform(
        F.array_sort(F.transform(names, lambda x: record(n=-F.length(x), x=x))),
        lambda s: s["x"],
    )


def cut_names(title: Column, names: Column) -> Column:
    """Blank out every listed name in a lower-case title."""
    return F.aggregate(names, title, lambda acc, n: F.replace(acc, n, F.lit(" ")))


def same_company(va: Column, vb: Column) -> Column:
    """Some variant of one equals or contains one of the other."""
    return F.exists(va, lambda x: F.exists(vb, lambda y: F.contains(x, y) | F.contains(y, x)))


def contains_either(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def registry_aliases(norm: ColumnLike, initials: list[tuple[str, str]] | None = None) -> Column:
    """Transliterated spellings, each alone and all together."""
    pairs = sorted(initials or fixed.REGISTRY_INITIALS, key=lambda p: -len(p[0]))
    n = col(norm)
    alone = [F.when(F.contains(n, F.lit(ko)), F.replace(n, F.lit(ko), F.lit(en))) for ko, en in pairs]
    together = n
    for ko, en in pairs:
        together = F.replace(together, F.lit(ko), F.lit(en))
    options = F.array(*alone, together)
    return F.array_sort(F.array_distinct(F.filter(options, lambda x: x.isNotNull() & (x != n))))


def poster_name(title: ColumnLike, company: ColumnLike) -> Column:
    """``[Company]`` at the head of a title overrides the feed's company."""
    return F.coalesce(first_match(title, r"^\s*\[([^\]]+)\]", 1), col(company))
