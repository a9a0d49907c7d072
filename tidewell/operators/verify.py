"""Checks of postings against their own landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.experience import official_exp
from ..functions.links import link_kind
from ..functions.orgs import contains_either, normalize_org
from ..functions.text import (
    all_matches, blank_to_null, first_match, grab, html_to_text, led, let, matches, rx, squeeze, substitute, text_or_blank, unescape,
)
from .groups import budget, first_by
from .rules import RuleSet

# a duty word that no "(closed)" mark precedes; the cheap look-ahead comes first
_OPEN_DUTY = f"(?={led(fixed.DUTY)})" + r"(?<!\(\s{0,9}마감\s{0,9}\)\s{0,9}\S{0,8})" + f"(?:{fixed.DUTY})"
_EDGE = r"^[ \-·•▶■□○◦*:,]+|[ \-·•▶■□○◦*:,]+$"


def eligible_for_check(jobs: DataFrame, state: DataFrame, run_date: str, rules: RuleSet, order: list[Column]) -> DataFrame:
    """Postings to check in this run (C21, F6): web link, not verified lately, no recent failed try, within the budget."""
    today = F.lit(run_date).cast("date")
    since = F.date_format(F.date_sub(today, rules.verify_recheck_days), "yyyy-MM-dd")
    retry = F.date_format(F.date_sub(today, rules.verify_retry_days), "yyyy-MM-dd")
    known = state.select("id", F.col("verified_at").alias("_va"), F.col("verify_tried_at").alias("_vt"))
    joined = jobs.join(known, "id", "left")
    fresh = F.coalesce(F.col("_va") >= since, F.lit(False))
    failed = F.coalesce((F.col("_vt") >= retry) & ~F.col("_vt").eqNullSafe(F.col("_va")), F.lit(False))
    ok = matches("link", r"^https?://") & ~fresh & ~failed
    return budget(joined, ok, order, rules.verify_cap).drop("_va", "_vt")


def duty_check(rows: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Evidence of the field of work in a posting's text.

    Adds ``duty`` (confirmed / title only / doubt), ``duty_evidence`` and
    ``duty_flag``.  Short sentences of site furniture are dropped; where section
    headings exist their 400-sign windows are searched, else the whole text.
    """
    t = text_or_blank(title)
    title_hit = matches(t, fixed.DUTY, True) | matches(t, fixed.DUTY_TITLE_ONLY)
    cut = F.when(t == "", text_or_blank(body)).otherwise(
        F.replace(F.replace(text_or_blank(body), t, F.lit(" ")), F.regexp_replace(t, rx(r"\s+"), " "), F.lit(" ")))

    def keep_sentence(p: Column) -> Column:
        def judged(ended: Column) -> Column:
            core = F.when(ended, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
            furniture = (F.length(core) < 120) & matches(core, led(fixed.PAGE_BOILERPLATE))
            return F.when(furniture, F.when(ended, F.substring(p, -1, 1)).otherwise("")).otherwise(p)

        return let(F.substring(p, -2, 2).rlike(rx(r"(?:\n|[.。!?]\s)\z")), judged)

    pieces = F.split(cut, rx(r"(?<=\n)|(?<=[.。!?]\s)"))
    staged = rows.withColumn("_title_hit", title_hit).withColumn("_body", F.array_join(F.transform(pieces, keep_sentence), ""))
    windows = all_matches("_body", rf"(?={led(fixed.DUTY_SECTION)})(?=([\s\S]{{0,400}}))(?:{fixed.DUTY_SECTION})", 1, True)
    staged = staged.withColumn("_scope", let(windows, lambda w: F.when(F.size(w) > 0, F.array_join(w, "\n")).otherwise(F.col("_body"))))
    lines = F.filter(F.split(F.col("_scope"), rx(r"\n|(?<=[.。])\s")), lambda s: F.length(F.trim(s)) > 2)
    staged = staged.withColumn("_line", F.get(F.filter(lines, lambda s: s.rlike(rx(_OPEN_DUTY, True))), F.lit(0)))

    place = F.regexp_instr(F.col("_line"), F.lit(rx(_OPEN_DUTY, True)))
    hit = F.regexp_extract("_line", rx(_OPEN_DUTY, True), 0)
    start = F.greatest(place - 40, F.lit(1))
    around = F.substring(F.col("_line"), start, place - start + F.length(hit) + 60)
    staged = staged.withColumn("_ev", F.when(F.col("_line").isNotNull(), F.regexp_replace(squeeze(around), rx(_EDGE), "")).otherwise(""))
    staged = staged.withColumn("_flat", F.regexp_replace("_scope", rx(r"\s+"), " ")).withColumn("_near", F.concat(F.col("_ev"), F.lit(" "), t))

    # read more than once below: whole texts are searched once as columns of their own
    staged = staged.withColumn("_site", all_matches(F.concat(F.col("_flat"), F.lit(" "), t), led(fixed.SITE_WORK)))
    staged = staged.withColumn("_closed", F.filter(all_matches("_flat", fixed.CLOSED_PART + r"\s*[^,(\n]{0,20}"), lambda x: matches(x, fixed.DUTY, True)))
    site, closed = F.col("_site"), F.col("_closed")
    other = F.filter(all_matches("_near", fixed.OTHER_WORK), lambda x: ~matches(x, fixed.SITE_WORK))
    found = F.concat(site, other)
    squeezed = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, rx(r"\s+"), "")))
    staged = staged.withColumn("_flags", F.array_join(squeezed, ", "))
    flag = F.col("_flags")
    closed_text = F.array_join(F.array_distinct(F.transform(closed, lambda x: F.trim(x))), ", ")
    flags = F.when(F.size(closed) > 0, F.concat(F.lit(fixed.CLOSED_PART_FLAG), closed_text,
                                                F.when(flag != "", F.concat(F.lit(" · "), flag)).otherwise(""))).otherwise(flag)
    site_safety = (F.size(site) > 0) & matches("_near", fixed.DUTY_SAFETY) & ~matches("_near", fixed.DUTY_ENVIRONMENT)
    verdict = (F.when(site_safety, fixed.VERDICT_DOUBT).when(F.col("_line").isNotNull(), fixed.VERDICT_CONFIRMED)
               .when(F.col("_title_hit"), fixed.VERDICT_TITLE).otherwise(fixed.VERDICT_DOUBT))
    return staged.select(*rows.columns, verdict.alias("duty"), F.col("_ev").alias("duty_evidence"),
                         F.regexp_replace(flags, r"^[ ·]+|[ ·]+$", "").alias("duty_flag"))


def labelled_detail(pages: DataFrame, html: str = "html") -> DataFrame:
    """Official values of a labelled detail page."""
    body = html_to_text(html)
    keep = [c for c in pages.columns if c != html]
    staged = pages.select(*keep, html, body.alias("_body")).withColumn("_t", squeeze("_body"))
    meta = unescape(first_match(html, r'<meta[^>]+property="og:description"[^>]+content="([^"]*)"', 1))
    parts = F.transform(F.split(meta, ","), lambda x: F.trim(x))
    stamp = lambda label, g: first_match("_t", label + r"\s+(\d{4}\.\d{2}\.\d{2})(?:\s+(\d{2}:\d{2}))?", g)
    due = F.replace(stamp("마감일", 1), F.lit("."), F.lit("-"))
    rolling = F.when(matches("_t", r"마감일\s+(?:상시채용|채용시)"), F.lit(fixed.ROLLING))
    emp = F.trim(F.split(grab("_t", "근무형태", "급여|자격요건|근무지역|직급"), rx(r"\s*근무형태\s*상세|\s*상세\s*보기|\s*닫기"), 2)[0])
    where = substitute(grab("_t", "근무지역", "최저임금계산|지도|조회수|홈페이지|급여"), r"\s*(?:지도|최저임금계산).*$", "")
    closed = matches("_t", r"접수\s*마감된\s*공고|마감된\s*공고입니다|채용\s*마감") & ~F.contains("_t", F.lit("남은 기간"))
    return staged.select(
        *keep, first_match(html, r"company-info/view\?csn=([A-Za-z0-9%=+/]+)", 1).alias("csn"),
        F.get(parts, F.lit(0)).alias("company_full"), F.get(parts, F.lit(1)).alias("title_full"),
        F.replace(stamp("시작일", 1), F.lit("."), F.lit("-")).alias("start"), F.coalesce(due, rolling).alias("deadline"),
        stamp("마감일", 2).alias("deadline_time"), official_exp("_t").alias("exp"),
        grab("_t", "학력", "근무형태|급여|자격요건").alias("edu"), blank_to_null(emp).alias("emp_type"),
        blank_to_null(where).alias("location"), closed.alias("closed"), F.col("_body").alias("body"))


_POSTING = (
    "`@type`: string, title: string, hiringOrganization: string, datePosted: string, validThrough: string, "
    "employmentType: string, experienceRequirements: string, educationRequirements: string, jobLocation: string, description: string"
)


def linked_data_detail(pages: DataFrame, run_date: str, html: str = "html") -> DataFrame:
    """Official values of a page's linked-data posting (J13): first JobPosting in a list, graph or object."""
    keep = [c for c in pages.columns if c != html]
    scripts = all_matches(html, r"(?s)<script[^>]+application/ld\+json[^>]*>(.*?)</script>", 1)
    docs = F.flatten(F.array_compact(F.transform(scripts, lambda s: F.from_json(
        F.trim(s), f"array<struct<{_POSTING}, `@graph`: array<struct<{_POSTING}>>>>"))))
    names = [p.split(":")[0].strip(" `") for p in _POSTING.split(", ")]
    plain = lambda d: F.struct(*[d[n].alias(n) for n in names])
    items = F.flatten(F.transform(docs, lambda d: F.coalesce(d["@graph"], F.array(plain(d)))))
    first = F.get(F.filter(items, lambda x: x["@type"] == "JobPosting"), F.lit(0))
    j = lambda c, path: F.get_json_object(c, path)
    # through a generator: a filter on the posting itself would be pushed to the scan and parse every page a second time there
    staged = pages.select(*keep, html, F.explode(F.array(first)).alias("jp")).filter("jp is not null").withColumn("_t", squeeze(html_to_text(html)))
    jp = F.col("jp")
    types = F.transform(F.from_json(F.when(F.startswith(jp["employmentType"], F.lit("[")), jp["employmentType"])
                                    .otherwise(F.to_json(F.array(jp["employmentType"]))), "array<string>"),
                        lambda x: F.coalesce(F.try_element_at(F.create_map(
                            *[F.lit(v) for kv in fixed.EMPLOYMENT_TYPES.items() for v in kv]), x), F.lit("")))
    labelled_type = first_match("_t", r"고용\s*형태\s*[:：]?\s*([가-힣A-Za-z0-9 ,()·/]+?)\s+(?:급여|근무시간|근무지|모집인원|직급|학력|$)", 1)
    months = j(jp["experienceRequirements"], "$.monthsOfExperience").try_cast("int")
    exp = F.coalesce(
        squeeze(first_match("_t", r"경력\s*[:：]\s*([^,|]+?)\s*(?:,|\||학력)", 1)),
        squeeze(first_match(unescape(html), fixed.EXPERIENCE_IN_PAGE, 1)),
        F.when(months > 0, F.concat(F.lit("경력 "), F.floor(months / 12).cast("string"), F.lit("년↑"))),
        F.when(~F.startswith(jp["experienceRequirements"], F.lit("{")), jp["experienceRequirements"]))
    edu = F.when(F.startswith(jp["educationRequirements"], F.lit("{")), j(jp["educationRequirements"], "$.credentialCategory")) \
        .otherwise(jp["educationRequirements"])
    at = lambda leaf: F.coalesce(j(jp["jobLocation"], f"$.address.{leaf}"), j(jp["jobLocation"], f"$[0].address.{leaf}"))
    where = F.coalesce(blank_to_null(F.trim(F.concat_ws(" ", blank_to_null(at("addressRegion")), blank_to_null(at("addressLocality"))))),
                       at("streetAddress"))
    due = first_match(jp["validThrough"], r"^\d{4}-\d{2}-\d{2}")
    closed = F.coalesce(due < F.lit(run_date), F.lit(False)) | matches("_t", r"접수\s*마감|마감된\s*공고|채용이\s*마감")
    og = unescape(first_match(html, r'<meta[^>]+property="og:description"[^>]+content="([^"]*)"', 1))
    section = first_match("_t", r"((?:모집\s*요강|모집\s*분야|모집\s*부문)[\s\S]*)", 1)
    return staged.select(
        *keep, unescape(jp["title"]).alias("title_full"), unescape(j(jp["hiringOrganization"], "$.name")).alias("company_full"),
        F.substring(jp["datePosted"], 1, 10).alias("start"), due.alias("deadline"),
        first_match(jp["validThrough"], r"^.{10}T(\d{2}:\d{2})", 1).alias("deadline_time"), exp.alias("exp"),
        blank_to_null(edu).alias("edu"), blank_to_null(F.coalesce(labelled_type, F.array_join(F.filter(types, lambda x: x != ""), ", "))).alias("emp_type"),
        blank_to_null(where).alias("location"), closed.alias("closed"),
        F.concat_ws("\n", og, section, html_to_text(jp["description"])).alias("body"))


def details_by_priority(jobs: DataFrame, found: list[tuple[str, DataFrame]]) -> DataFrame:
    """Detail of the first way that found one (J24): numbered page, linked data, linkage by name and title."""
    union = None
    for i, (how, part) in enumerate(found):
        one = part.withColumn("_way", F.lit(i)).withColumn("found_by", F.lit(how))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    best = first_by(union, ["id"], F.struct("_way", F.coalesce("start", F.lit("")), F.coalesce("body", F.lit("")))).drop("_way")
    known = [c for c in best.columns if c != "id"]
    return jobs.withColumn("link_kind", link_kind("link")).join(best.select("id", F.struct(*known).alias("detail")), "id", "left")


def apply_details(jobs: DataFrame, run_date: str) -> DataFrame:
    """Verified values, verdicts and vetoes on the batch (D16, J14, H7 inputs)."""
    d = F.col("detail")
    titles = F.concat_ws(" ", "title", F.when(d["title_full"] != F.col("title"), d["title_full"]))
    checked = duty_check(jobs.withColumn("_titles", titles).withColumn("_page", d["body"]), "_titles", "_page")
    full = normalize_org(d["company_full"], "posting")
    own = normalize_org("company", "posting")
    other = F.coalesce(F.col("check_company"), F.lit(False)) & (full != "") & ~contains_either(own, full)
    have = d.isNotNull()
    past = F.coalesce(first_match(d["deadline"], r"^\d{4}-\d{2}-\d{2}$") < F.lit(run_date), F.lit(False))
    note = F.concat(F.when(F.coalesce(d["closed"], F.lit(False)), F.lit("마감됨 · ")).otherwise(""), F.lit("원문 확인 "),
                    F.date_format(F.lit(run_date).cast("date"), "MM.dd"))
    return (
        checked
        .withColumn("verified_at", F.when(have, F.lit(run_date)))
        .withColumn("verify", F.when(have & other, F.concat(F.lit("다른 회사 공고라 제외 (원문 회사: "), d["company_full"], F.lit(")")))
                    .when(have, note).otherwise(F.concat(F.lit("원문 확인 필요 ("), F.col("link_kind"), F.lit(")"))))
        .withColumn("closed", have & (other | F.coalesce(d["closed"], F.lit(False)) | past))
        .withColumn("v_start", d["start"]).withColumn("v_deadline", d["deadline"]).withColumn("v_exp", d["exp"])
        .withColumn("location", d["location"]).withColumn("edu", d["edu"]).withColumn("emp_type", d["emp_type"])
        .withColumn("deadline_time", d["deadline_time"]).withColumn("company_full", d["company_full"])
        .withColumn("tier", F.when(have & (F.col("duty") == fixed.VERDICT_DOUBT), fixed.REVIEW).otherwise(F.col("tier")))
        .drop("_titles", "_page", "detail")
    )
