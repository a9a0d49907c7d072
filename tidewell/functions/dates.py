"""Dates and deadlines written in posting cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import ColumnLike, all_matches, col, first_match, let, matches, record, rx, text_or_blank


def ko_dates(c: ColumnLike) -> Column:
    """Year/month/day words to dotted dates."""
    full = F.regexp_replace(col(c), rx(fixed.KO_FULL_DATE), "$1.$2.$3")
    dotted = F.regexp_replace(full, rx(fixed.KO_SHORT_DATE), "$1.$2")
    return F.when(F.contains(col(c), F.lit("월")), dotted).otherwise(col(c))


def guess_year(month: Column, today: Column) -> Column:
    """Year of a bare month: the one nearest to today."""
    return (
        F.when(month > F.month(today) + 6, F.year(today) - 1)
        .when(month < F.month(today) - 6, F.year(today) + 1)
        .otherwise(F.year(today))
    )


def date_of(y: Column, m: Column, d: Column) -> Column:
    """Date, NULL when there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def _numbers(c: Column) -> Column:
    return F.transform(all_matches(c, r"\d+"), lambda x: x.try_cast("int"))


def _leading_date(c: Column) -> Column:
    """Date from the first three numbers of a matched piece."""
    return let(_numbers(c), lambda n: date_of(F.get(n, F.lit(0)), F.get(n, F.lit(1)), F.get(n, F.lit(2))))


def _range_end_date(piece: Column, today: Column) -> Column:
    def build(n: Column) -> Column:
        short = F.size(n) == 2
        mo = F.when(short, F.get(n, F.lit(0))).otherwise(F.get(n, F.lit(1)))
        day = F.when(short, F.get(n, F.lit(1))).otherwise(F.get(n, F.lit(2)))
        year = F.when(short, guess_year(mo, today)).otherwise(F.get(n, F.lit(0)))
        return date_of(year, mo, day)

    return let(_numbers(piece), build)


def parse_deadline(block: ColumnLike, today: Column) -> Column:
    """``struct(kind, date)`` with kind in rolling / dated / unknown.

    Order: rolling wording, end of a range, dated closing, days left, today.  A
    date that is no calendar day falls through to the next rule.
    """
    def dated(b: Column) -> Column:
        return F.coalesce(  # short-circuit: later patterns run only where earlier ones found nothing
            let(first_match(b, fixed.RANGE_END), lambda p: F.when(p.isNotNull(), _range_end_date(p, today))),
            let(first_match(b, fixed.DATED_UNTIL), lambda p: F.when(p.isNotNull(), _leading_date(p))),
            F.date_add(today, first_match(b, fixed.D_MINUS, 1).cast("int")),
            F.when(matches(b, fixed.DUE_TODAY, True), today))

    def build(b: Column) -> Column:
        rolling = record(kind=F.lit("rolling"), date=F.lit(None).cast("date"))
        read = let(dated(b), lambda d: record(kind=F.when(d.isNotNull(), "dated").otherwise("unknown"), date=d))
        return F.when(matches(b, fixed.ROLLING_WORDING), rolling).otherwise(read)

    return let(ko_dates(text_or_blank(block)), build)


def deadline_text(deadline: Column) -> Column:
    """Text form of a parsed deadline: ISO day, rolling word or NULL."""
    return F.when(deadline["kind"] == "rolling", F.lit(fixed.ROLLING)).otherwise(
        F.date_format(deadline["date"], "yyyy-MM-dd")
    )


def is_dated(c: ColumnLike) -> Column:
    return matches(c, r"^\d{4}-")


def parse_posted(block: ColumnLike, today: Column) -> Column:
    """Day a posting went up: range start, days ago, today, dated."""
    def build(b: Column) -> Column:
        return F.coalesce(
            let(first_match(b, fixed.RANGE_START), lambda p: F.when(p.isNotNull(), _leading_date(p))),
            F.date_sub(today, first_match(b, fixed.DAYS_AGO, 1).cast("int")),
            F.when(matches(b, fixed.POSTED_TODAY), today),
            let(first_match(b, fixed.POSTED_ON), lambda p: F.when(p.isNotNull(), _leading_date(p))))

    return let(ko_dates(text_or_blank(block)), build)


def compact_date(c: ColumnLike) -> Column:
    """Date from the first eight digits of any spelling."""
    digits = F.substring(F.regexp_replace(col(c).cast("string"), r"\D", ""), 1, 8)
    return F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd"))


def compact_timestamp(c: ColumnLike) -> Column:
    """Timestamp from twelve digits."""
    digits = F.substring(F.regexp_replace(col(c).cast("string"), r"\D", ""), 1, 12)
    return F.when(F.length(digits) == 12, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmm")))


def utc_to_local(c: ColumnLike, zone: str = "Asia/Seoul") -> Column:
    """ISO UTC text to local wall-clock time."""
    return F.from_utc_timestamp(F.try_to_timestamp(F.replace(col(c), F.lit("Z"), F.lit("")).substr(1, 19),
                                                   F.lit("yyyy-MM-dd'T'HH:mm:ss")), zone)


def open_now(start: Column, end: Column, now: Column) -> Column:
    """Missing bounds do not restrict."""
    return F.coalesce(start <= now, F.lit(True)) & F.coalesce(end >= now, F.lit(True))


def same_month(a: ColumnLike, b: ColumnLike) -> Column:
    """Two titles that both name months must share one."""
    ma, mb = all_matches(text_or_blank(a), fixed.MONTH_WORD, 1), all_matches(text_or_blank(b), fixed.MONTH_WORD, 1)
    return (F.size(ma) == 0) | (F.size(mb) == 0) | F.arrays_overlap(ma, mb)
