"""Required experience written in cards and on official pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import ColumnLike, all_matches, first_match, last_match, let, matches, record, squeeze, text_or_blank


def parse_exp(block: ColumnLike) -> Column:
    """``struct(label, min_years, new_grad_only)``.

    Order: year range, minimum, any, experienced only, new graduate, unknown.
    """
    null_int = F.lit(None).cast("int")

    def result(label: Column, years: Column, new_only: bool) -> Column:
        return record(label=label, min_years=years.cast("int"), new_grad_only=F.lit(new_only))

    def decide(v: Column) -> Column:
        b, span, least = v["b"], v["span"], v["least"]
        numbers = all_matches(span, r"\d+")
        any_level, experienced, new = (matches(b, p) for p in (fixed.EXP_ANY, fixed.EXPERIENCED, fixed.NEW_GRAD))
        return (
            F.when(span.isNotNull(), result(
                F.concat(F.get(numbers, F.lit(0)), F.lit("~"), F.get(numbers, F.lit(1)), F.lit(fixed.EXP_LABELS["range"])),
                F.get(numbers, F.lit(0)), False))
            .when(least.isNotNull(), result(F.concat(least, F.lit(fixed.EXP_LABELS["min"])), least, False))
            .when(any_level, result(F.lit(fixed.EXP_LABELS["any"]), F.lit(0), False))
            .when(experienced & ~new, result(F.lit(fixed.EXPERIENCED), null_int, False))
            .when(new, result(F.lit(fixed.NEW_GRAD), F.lit(0), True))
            .otherwise(result(F.lit(fixed.EXP_LABELS["unknown"]), null_int, False))
        )

    b = text_or_blank(block)
    span = F.coalesce(first_match(b, fixed.EXP_RANGE_LABELLED), first_match(b, fixed.EXP_RANGE))
    least = F.coalesce(first_match(b, fixed.EXP_MIN_LABELLED, 1), first_match(b, fixed.EXP_MIN, 1))
    return let(record(b=b, span=span, least=least), decide)


def official_exp(c: ColumnLike) -> Column:
    """Experience value directly before the education label, last one."""
    def shown(v: Column) -> Column:
        return F.when(matches(v, r"^(?:신입|경력|무관)"), v).otherwise(F.concat(F.lit("경력 "), v))

    return let(squeeze(last_match(c, fixed.OFFICIAL_EXP, 1)), lambda v: F.when(v.isNotNull(), shown(v)))


def years_cap(c: ColumnLike, cap: int) -> Column:
    """True when the minimum stays within the cap or is unknown."""
    return F.coalesce(parse_exp(c)["min_years"], F.lit(0)) <= cap
