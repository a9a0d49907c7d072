"""Size ranks, company tiers, salary and size bands, score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import ColumnLike, col, let, matches, one_of, record, text_or_blank


def size_rank(is_portal: Column, is_large: Column, is_group_source: Column, is_mid: Column,
              default_rank: Column, company: ColumnLike) -> Column:
    """1 large, 2 affiliate, 4 mid, 5 other; a filtered feed lifts 5, public bodies cap at 3."""
    rank = (F.when(is_portal | is_large, 1).when(is_group_source, 2).when(is_mid, 4).otherwise(5))
    lifted = F.when((rank == 5) & default_rank.isNotNull(), default_rank.cast("int")).otherwise(rank)
    return F.when(matches(company, fixed.PUBLIC_BODY), F.least(lifted, F.lit(3))).otherwise(lifted)


def size_label(rank: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in fixed.SIZE_LABELS.items() for x in kv])
    return F.try_element_at(labels, rank)


def rank_from_size_words(size: ColumnLike) -> Column:
    """Rank from a size wording, first hit wins."""
    words = fixed.SIZE_WORD_RANKS
    out = F.when(F.contains(text_or_blank(size), F.lit(words[0][0])), words[0][1])
    for word, rank in words[1:]:
        out = out.when(F.contains(text_or_blank(size), F.lit(word)), rank)
    return out.otherwise(5)


def form_tokens(form: ColumnLike) -> Column:
    return F.transform(F.split(text_or_blank(form), ","), lambda x: F.trim(x))


def is_form_large(form: ColumnLike, employees: Column) -> Column:
    """Declared large, unless the head count says otherwise."""
    small = F.coalesce((employees > 0) & (employees < 300), F.lit(False))
    return F.array_contains(form_tokens(form), fixed.FORM_LARGE) & ~small


def form_rank(rank: Column, form: ColumnLike) -> Column:
    """A rank from a partial name match falls back to mid when the form says so."""
    tokens = form_tokens(form)
    mid = F.arrays_overlap(tokens, one_of(fixed.FORM_MID))
    exempt = F.arrays_overlap(tokens, one_of(fixed.FORM_EXEMPT))
    return F.when((rank <= 2) & mid & ~exempt, 4).otherwise(rank)


def repaired_size(rank: Column, size: ColumnLike, form: ColumnLike, employees: Column) -> Column:
    """Size wording after the form is taken into account."""
    s = text_or_blank(size)
    return (
        F.when((rank >= 4) & is_form_large(form, employees), F.lit("대기업"))
        .when((rank == 4) & F.startswith(s, F.lit("대기업")), F.lit("중견"))
        .when((rank == 5) & F.contains(text_or_blank(form), F.lit("중견")), F.lit("중견"))
        .otherwise(s)
    )


def company_tier(company: ColumnLike, title: ColumnLike, group: Column, rank: Column, size: ColumnLike,
                 employees: Column, salary: Column, form: ColumnLike, in_mid_list: Column,
                 good_employees: int = 1000, good_salary: int = 7000, salary_min_employees: int = 300) -> Column:
    """``struct(tier, group)`` (J18): proxy poster, group, agency wording, rank, figures, list, rest."""
    name, s = text_or_blank(company), text_or_blank(size)
    emp, sal = F.coalesce(employees, F.lit(0)), F.coalesce(salary, F.lit(0))
    agency = (F.contains(s, F.lit("헤드헌팅")) | F.contains(name, F.lit("→"))
              | matches(name, fixed.AGENCY_TIER, True))
    wording = F.concat_ws(" ", name, text_or_blank(title))
    big_client = matches(wording, r"대기업|그룹|코스피|상장|글로벌|외국계|다국적") & ~matches(wording, r"중견|중소")
    top, mid, rest = (F.lit(x) for x in (fixed.TIER_TOP, fixed.TIER_MID, fixed.TIER_REST))
    good = ((emp >= good_employees) | ((sal >= good_salary) & (emp >= salary_min_employees))
            | F.array_contains(form_tokens(form), fixed.FORM_TOP1000))
    proxy = matches(name, fixed.PROXY_POSTER)
    tier = (
        F.when(proxy, rest)
        .when(group.isNotNull(), top)
        .when(agency, F.when(big_client, top).otherwise(rest))
        .when((F.coalesce(rank, F.lit(5)) <= 3) | F.contains(s, F.lit("대기업")) | matches(name, fixed.PUBLIC_TIER), top)
        .when(good, mid)
        .when((emp == 0) & (sal == 0) & in_mid_list, mid)
        .otherwise(rest)
    )
    return record(tier=tier, group=F.when(~proxy, group))


def compare_salary(salary: Column, base: Column, margin: float = 0.05) -> Column:
    """Difference to the baseline salary with a dead band, half-even percent."""
    def band(r: Column) -> Column:
        pct = F.bround(r * 100, 0).cast("int").cast("string")
        return (F.when(r > margin, F.concat(F.lit("높음 +"), pct, F.lit("%")))
                .when(r < -margin, F.concat(F.lit("낮음 "), pct, F.lit("%")))
                .otherwise(fixed.BAND_SAME))

    known = (F.coalesce(salary, F.lit(0)) > 0) & (F.coalesce(base, F.lit(0)) > 0)
    return F.when(known, let(salary / base - 1, band)).otherwise(fixed.BAND_UNKNOWN)


def compare_size(employees: Column, form: ColumnLike, base_employees: Column, base_form: ColumnLike) -> Column:
    """Head-count band with the declared form taking precedence."""
    big, base_big = matches(form, fixed.FORM_LARGE), matches(base_form, fixed.FORM_LARGE)
    known = (F.coalesce(employees, F.lit(0)) > 0) & (F.coalesce(base_employees, F.lit(0)) > 0)
    ratio = F.when(known, employees / base_employees)
    by_count = (
        F.when(~big & base_big, fixed.SIZE_DOWN)
        .when(ratio >= 1.3, fixed.SIZE_UP)
        .when(ratio < 0.7, fixed.SIZE_DOWN)
        .otherwise(fixed.BAND_SAME)
    )
    by_form = F.when(big, fixed.BAND_SAME).otherwise(fixed.SIZE_DOWN)
    return (
        F.when(known, by_count)
        .when((text_or_blank(form) != "") & base_big, by_form)
        .otherwise(fixed.BAND_UNKNOWN)
    )


def fit_band(score: ColumnLike, high: float = 0.6, mid: float = 0.3) -> Column:
    """High / mid / low score band."""
    top, middle, low = fixed.FIT_BANDS
    return F.when(col(score) >= high, top).when(col(score) >= mid, middle).otherwise(low)
