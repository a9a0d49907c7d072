"""Checks of a batch against landed detail pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import canon_key, link_kind
from ..functions.orgs import normalize_org
from ..operators.lookup import link_records
from ..operators.verify import apply_details, details_by_priority, labelled_detail, linked_data_detail


def verify_batch(jobs: DataFrame, pages: DataFrame, run_date: str, accept: float = 0.85) -> DataFrame:
    """Batch with official values, verdicts and closings.

    ``pages`` holds landed detail pages (url, html).  A posting finds its page by
    number, by its own link (linked data), or by the most similar title of the
    same company.
    """
    keyed = pages.withColumn("page_key", F.coalesce(canon_key("url"), F.col("url")))
    labelled = labelled_detail(keyed)
    linked = linked_data_detail(keyed, run_date)
    by_number = jobs.filter(canon_key("link").isNotNull()).select("id", canon_key("link").alias("page_key")).join(labelled, "page_key").drop("page_key", "url")
    direct = jobs.filter(link_kind("link") == "direct").select("id", F.col("link").alias("url")).join(linked, "url").drop("url", "page_key")
    named = labelled.filter("company_full is not null and title_full is not null").withColumn("org", normalize_org("company_full", "detail"))
    matched = link_records(jobs.withColumn("org", normalize_org("company", "detail")).select("id", "org", "title"),
                           named.select("org", "title_full", "page_key"), ["org"], "title", "title_full", "id", "page_key", accept)
    similar = matched.filter("page_key_match is not null").select("id", F.col("page_key_match").alias("page_key")).join(
        labelled, "page_key").drop("page_key", "url")
    found = details_by_priority(jobs, [("number", by_number), ("linked data", direct), ("similar title", similar)])
    return apply_details(found, run_date)
