"""Title features that duplicate and sibling detection compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .orgs import cut_names, org_mentions, org_variants
from .text import ColumnLike, all_matches, col, let, matches, one_of, rx, substitute, text_or_blank


def title_core(title: ColumnLike, company: ColumnLike) -> Column:
    """Title without tags, poster and legal forms; letters, digits, brackets (I4)."""
    plain = F.lower(substitute(text_or_blank(title), r"\[[^\]]*\]", " "))
    plain = F.regexp_replace(cut_names(plain, org_mentions(company)), rx(fixed.LEGAL_BASIC), " ")
    return F.replace(F.regexp_replace(plain, "[^0-9a-z가-힣()]", ""), F.lit("()"), F.lit(""))


def title_tokens(title: ColumnLike, company: ColumnLike, stop: list[str] | None = None) -> Column:
    """Sorted distinct words that tell postings apart."""
    plain = substitute(text_or_blank(title), fixed.DATE_TAIL, " ")
    plain = F.lower(substitute(plain, fixed.YEAR_OR_MONTH, " "))
    words = all_matches(cut_names(plain, org_mentions(company)), r"[가-힣]+|[a-z]+|[0-9]+")
    bare = F.transform(words, lambda w: F.coalesce(
        F.nullif(F.regexp_replace(w, fixed.UNIT_SUFFIX, ""), F.lit("")), w))
    kept = F.filter(F.array_distinct(bare), lambda w: F.length(w) >= 2)
    return F.array_sort(F.array_except(kept, one_of(stop or fixed.STOP_WORDS)))


def title_fields(title: ColumnLike, words: list[str] | None = None) -> Column:
    """Field-of-work terms contained in a title, in list order."""
    return let(F.lower(text_or_blank(title)),
               lambda t: F.filter(one_of(words or fixed.FIELD_WORDS), lambda f: F.contains(t, f)))


def has_field(word: Column, words: list[str] | None = None) -> Column:
    return F.exists(one_of(words or fixed.FIELD_WORDS), lambda f: F.contains(word, f))


def token_cover(a: Column, b: Column) -> Column:
    """Every word of ``a`` equals or shares a head with one of ``b`` (I8)."""
    return F.forall(a, lambda x: F.exists(b, lambda y: F.startswith(x, y) | F.startswith(y, x)))


def same_title(a: Column, b: Column) -> Column:
    """Equal cores, or a long core with at most four signs more."""
    short, long_ = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((short >= 10) & (long_ - short <= 4) & (F.startswith(a, b) | F.startswith(b, a)))


def hiring_part(title: ColumnLike) -> Column:
    """Part of a title before the first separator, whole title without one."""
    t = text_or_blank(title)
    return F.regexp_extract(t, r"(?s)^(.*?)(?:\s[|_]\s|_|\||$)", 1)


def base_tokens(title: ColumnLike, company: ColumnLike) -> Column:
    """Words of the hiring itself: no place, field or role words."""
    def base(w: Column) -> Column:
        return ~has_field(w) & ~w.rlike(fixed.ROLE_SUFFIX)

    words = F.array_except(title_tokens(hiring_part(title), company), one_of(fixed.PLACE_WORDS))
    return F.filter(words, base)


def residual_tokens(title: ColumnLike, company: ColumnLike) -> Column:
    """Words left without field and role words; compared when no base words exist."""
    return F.filter(title_tokens(title, company), lambda w: ~has_field(w) & ~w.rlike(fixed.RESIDUAL_SUFFIX))


def hiring_name(title: ColumnLike, company: ColumnLike) -> Column:
    """Normalised part before a separator, NULL if none or under four signs."""
    t = text_or_blank(title)
    head = F.lower(F.regexp_extract(t, r"(?s)^(.*?)[|_]", 1))
    longest_first = F.reverse(F.array_sort(org_variants(company)))
    bare = F.regexp_replace(
        F.aggregate(longest_first, head, lambda acc, n: F.replace(acc, n, F.lit(""))),
        rx(fixed.HIRING_NOISE), "")
    return F.when(t.rlike(r"[|_]"), let(bare, lambda b: F.when(F.length(b) >= 4, b)))


def bare_title(title: ColumnLike) -> Column:
    """Title without its last bracket."""
    return substitute(text_or_blank(title), r"\s*\([^()]*\)\s*$", "")


def same_posting(ca: Column, cb: Column, fa: Column, fb: Column, ta: Column, tb: Column,
                 core_a: Column, core_b: Column, company_match: Column) -> Column:
    """Same company, same fields and one word set covering the other."""
    both_empty = (F.size(ta) == 0) & (F.size(tb) == 0)
    both_full = (F.size(ta) > 0) & (F.size(tb) > 0)
    return company_match & (fa == fb) & F.when(both_empty, core_a == core_b).otherwise(
        both_full & (token_cover(ta, tb) | token_cover(tb, ta)))


def is_generic(base: ColumnLike, company: ColumnLike) -> Column:
    """Only general hiring words are left once the poster is cut out (C20)."""
    plain = substitute(text_or_blank(base), r"20\d\d\s*년?|\d+\s*월|\d+\s*분기|[\[\]()|_\-·/]", " ")
    names = F.filter(F.concat(F.array(text_or_blank(company)), all_matches(text_or_blank(company), "[가-힣A-Za-z]+")),
                     lambda x: F.length(x) >= 2)
    words = all_matches(F.aggregate(names, plain, lambda acc, n: F.replace(acc, n, F.lit(" "))), "[가-힣A-Za-z]+")
    return F.size(F.array_except(F.transform(words, F.lower), one_of(fixed.GENERIC_WORDS))) == 0


def is_agency(company: ColumnLike, pattern: str | None = None) -> Column:
    return matches(col(company), pattern or fixed.AGENCY_BUNDLE, True)
