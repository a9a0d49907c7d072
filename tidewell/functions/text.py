"""Column helpers for text: regex dialect, clean-up, HTML, normal forms."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(pattern: str, ignore_case: bool = False) -> str:
    """Give a pattern Unicode classes and newline-only line ends.

    Rule files are written for engines whose ``\\s \\d \\w \\b`` are Unicode by
    default; Java needs the flags spelled out.
    """
    return ("(?iduU)" if ignore_case else "(?dU)") + pattern


def led(pattern: str) -> str:
    """The same pattern behind a look at the sign it starts with: one test a place instead of one an alternative.

    Only if every alternative starts with a plain letter, or with a word edge before it.
    """
    heads, depth, start = [], 0, 0
    for i, sign in enumerate(pattern + "|"):
        if sign in "([":
            depth += 1
        elif sign in ")]":
            depth -= 1
        elif sign == "|" and not depth:
            heads.append(pattern[start:i].removeprefix(r"\b")[:2])
            start = i + 1
    if any(not h[:1].isalpha() or h[1:] in ("?", "*", "{", "+") for h in heads):
        return pattern
    return f"(?=[{''.join(sorted({h[0] for h in heads}))}])(?:{pattern})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def record(**fields: Column) -> Column:
    """Struct whose field names survive inside lambdas and generators."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def matches(c: ColumnLike, pattern: str, ignore_case: bool = False) -> Column:
    """True/False, never NULL: a missing text matches nothing."""
    return F.coalesce(col(c).rlike(rx(pattern, ignore_case)), F.lit(False))


def first_match(c: ColumnLike, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """First match of a group, NULL where there is none; the pattern runs once."""
    return let(F.regexp_extract(col(c), rx(pattern, ignore_case), group), lambda v: F.when(v != "", v))


def all_matches(c: ColumnLike, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(col(c), F.lit(rx(pattern, ignore_case)), group)


def last_match(c: ColumnLike, pattern: str, group: int = 0) -> Column:
    """Last match in the text."""
    return F.try_element_at(all_matches(c, pattern, group), F.lit(-1))


def substitute(c: ColumnLike, pattern: str, to: str = " ", ignore_case: bool = False) -> Column:
    return F.regexp_replace(col(c), rx(pattern, ignore_case), to)


def blank_to_null(c: ColumnLike) -> Column:
    return F.nullif(col(c), F.lit(""))


def text_or_blank(c: ColumnLike) -> Column:
    return F.coalesce(col(c), F.lit(""))


def squeeze(c: ColumnLike) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(substitute(c, r"\s+", " "))


def join_present(*parts: ColumnLike, sep: str = " | ") -> Column:
    """Join the parts that have text."""
    return F.concat_ws(sep, *[blank_to_null(squeeze(p)) for p in parts])


def normalize_title(c: ColumnLike) -> Column:
    """Title without bracketed tags, closing notes and day counters."""
    return squeeze(substitute(c, fixed.TITLE_NOISE, " "))


def title_key(c: ColumnLike) -> Column:
    """Letters and digits of a title, lower case: the linkage form."""
    noise = substitute(text_or_blank(c), fixed.TITLE_NOISE_DETAIL, " ")
    return F.regexp_replace(F.lower(noise), "[^0-9a-z가-힣]", "")


def import_title_key(c: ColumnLike) -> Column:
    """Title form used when importing a foreign dump: the whole title without tags, signs and case."""
    plain = substitute(F.lower(text_or_blank(c)), r"\[[^\]]*\]", "")
    return F.regexp_replace(plain, "[^0-9a-z가-힣]", "")


def shorten(c: ColumnLike, n: int = 40) -> Column:
    """Keep short values; cut long ones at the first stop word."""
    return let(
        F.trim(text_or_blank(c)),
        lambda v: F.when(F.length(v) <= n, v).otherwise(
            F.trim(F.substring(F.split(v, rx(fixed.SHORT_STOP), 2)[0], 1, n))
        ),
    )


def to_int(c: ColumnLike) -> Column:
    """Integer with thousands separators, NULL for anything else."""
    return F.trim(F.regexp_replace(col(c), ",", "")).try_cast("int")


def unescape(c: ColumnLike) -> Column:
    """Numeric and named HTML entities to characters; each distinct one of a text is looked up once.

    Those that stand for ``&`` come last so nothing is unescaped twice.  Unknown
    names and numbers that are no character stay as they are.
    """
    pairs = [f"{name}\u0001{sign}" for name, sign in sorted(html.entities.html5.items()) if name.endswith(";")]
    names = F.str_to_map(F.lit("\u0002".join(pairs)), F.lit("\u0002"), F.lit("\u0001"))

    def number(digits: Column, base: int) -> Column:
        code = F.conv(F.when(F.length(digits) <= 8, digits), base, 10).cast("long")
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(real, code)), 8, "0")), "UTF-32")

    def sign(entity: Column) -> Column:
        inner = F.substring(entity, F.lit(3), F.length(entity) - 3)
        return F.when(entity.rlike("^&#[xX]"), number(F.substring(inner, F.lit(2), F.length(inner)), 16)) \
            .when(F.startswith(entity, F.lit("&#")), number(inner, 10)) \
            .otherwise(F.try_element_at(names, F.substring(entity, F.lit(2), F.length(entity))))

    def decoded(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"), 0))
        known = F.filter(F.transform(found, lambda e: record(entity=e, sign=sign(e))), lambda r: r["sign"].isNotNull())
        ordered = let(known, lambda k: F.concat(F.filter(k, lambda r: r["sign"] != "&"), F.filter(k, lambda r: r["sign"] == "&")))
        return F.aggregate(ordered, text, lambda t, r: F.replace(t, r["entity"], r["sign"]))

    return let(col(c), lambda text: F.when(F.contains(text, F.lit("&")), decoded(text)).otherwise(text))


def strip_tags(c: ColumnLike) -> Column:
    return squeeze(unescape(F.regexp_replace(text_or_blank(c), r"<[^>]+>", " ")))


def html_to_text(c: ColumnLike) -> Column:
    """Readable text of a page: block ends become line ends."""
    out = F.regexp_replace(text_or_blank(c), r"(?s)<script.*?</script>|<style.*?</style>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>|</li>|</div>|</tr>", "\n")
    out = unescape(F.regexp_replace(out, r"<[^>]+>", " "))
    return F.btrim(F.regexp_replace(out, "[ \\t\\r\\f\\x0B\\u00a0]+", " "), F.lit(" \n"))


def static_html(c: ColumnLike, url: ColumnLike) -> Column:
    """Page without scripts and with the base its relative links need."""
    quoted = F.replace(F.replace(F.replace(F.replace(
        col(url), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")),
        F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    base = F.concat(F.lit('<base href="'), quoted, F.lit('">'))
    bare = F.regexp_replace(col(c), r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    head = F.regexp_extract(bare, r"(?i)<head\b[^>]*>", 0)
    at = F.locate("<head", F.lower(bare)) + F.length(head)
    return F.when(head == "", F.concat(base, bare)).otherwise(
        F.concat(F.substring(bare, F.lit(1), at - 1), base, F.substring(bare, at, F.length(bare)))
    )


def grab(c: ColumnLike, label: str, stop: str) -> Column:
    """Text between a label and the first stop word."""
    return F.trim(first_match(c, f"(?:{label})\\s+(.+?)\\s+(?:{stop})", 1))


def one_of(literals: Iterable[str]) -> Column:
    return F.array(*[F.lit(x) for x in literals])


def alternation(names: Iterable[str], boundary: bool = True) -> str:
    """Lower-case names, longest first, as one pattern; ASCII ends may not touch ASCII letters."""
    parts = []
    for name in sorted({n.lower() for n in names if n}, key=lambda n: (-len(n), n)):
        p = re.escape(name)
        if boundary and re.search(r"[a-z0-9]$", name):
            p += "(?![a-z])"
        if boundary and re.match(r"[a-z0-9]", name):
            p = "(?<![a-z])" + p
        parts.append(p)
    return "|".join(parts)


def has_any_name(names: Iterable[str], c: ColumnLike) -> Column:
    """Some listed name occurs in the text."""
    pattern = alternation(names)
    return matches(F.lower(text_or_blank(c)), pattern) if pattern else F.lit(False)


def longest_name(names: list[str], c: ColumnLike) -> Column:
    """Longest listed name in the text, list order among equals (D2, G6); NULL if none.

    One pass over the text whatever the number of names: a look-ahead yields the
    longest name starting at each place.
    """
    pattern = alternation(names)
    if not pattern:
        return F.lit(None).cast("string")
    ordered: dict[str, str] = {}
    for n in sorted(names, key=len, reverse=True):
        ordered.setdefault(n.lower(), n)
    keys, shown = one_of(ordered), one_of(ordered.values())
    hits = F.array_distinct(all_matches(F.lower(text_or_blank(c)), f"(?=({pattern}))", 1))
    place = F.array_min(F.transform(hits, lambda h: F.array_position(keys, h)))
    return F.try_element_at(shown, place.cast("int"))
