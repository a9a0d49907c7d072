"""Batch of postings merged into the snapshot of the last run.

The snapshot is keyed by id.  A batch row finds its id by posting number, else
by the hash of company and title, then follows one duplicate pointer.  All of it
is resolved against the snapshot the run starts from; among batch rows the
first one of an id counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.bands import rank_from_size_words
from ..functions.dates import is_dated
from ..functions.links import canon_key, job_id
from ..functions.orgs import contains_either, normalize_org
from ..functions.text import blank_to_null
from ..sources.state import STATE_SCHEMA, conform_state
from .groups import first_by, survivors

BATCH_COLUMNS = [
    "company", "title", "track", "exp", "posted", "deadline", "link", "source", "snippet", "size", "tier", "verify",
    "verified_at", "verify_tried_at", "location", "edu", "emp_type", "deadline_time", "company_full", "duty",
    "duty_evidence", "duty_flag", "v_start", "v_deadline", "v_exp", "csn", "company_form", "cmp_salary", "cmp_size", "sec",
]


def duplicate_pointer(verify: Column) -> Column:
    """Id a closed duplicate points to."""
    prefix = fixed.DUPLICATE_PREFIX
    return F.when(F.startswith(F.coalesce(verify, F.lit("")), F.lit(prefix)),
                  blank_to_null(F.trim(F.substring(verify, F.lit(len(prefix) + 1), F.length(verify)))))


def canon_owner(state: DataFrame) -> DataFrame:
    """Row that owns each posting number: open first, then earliest seen."""
    rows = state.select("id", "status", "first_seen", canon_key("link").alias("canon")).filter("canon is not null")
    best = F.struct((F.coalesce(F.col("status"), F.lit("")) != "open"), F.coalesce("first_seen", F.lit("")), F.col("id"))
    return rows.groupBy("canon").agg(F.min_by("id", best).alias("owner"))


def resolve_ids(batch: DataFrame, state: DataFrame, order: str = "batch_pos") -> DataFrame:
    """First batch row of every resolved id.

    Copies inside the batch are folded before any join, so the joins meet
    unique keys on both sides.
    """
    keyed = batch.withColumn("_canon", canon_key("link")).withColumn("_key", F.coalesce("_canon", job_id("company", "title")))
    keyed = keyed.withColumn("_numbered", F.col("_canon").isNotNull()).drop("_canon")
    folded = first_by(keyed, ["_key"], F.col(order))
    # rows without a number meet on a key of their own, so they do not pile up on NULL
    folded = folded.withColumn("_meet", F.when(F.col("_numbered"), F.col("_key")).otherwise(F.concat(F.lit("none:"), F.col("_key"))))
    owned = folded.join(canon_owner(state).withColumnRenamed("canon", "_meet"), "_meet", "left")
    owned = owned.withColumn("id", F.coalesce("owner", F.when(F.col("_numbered"), job_id("company", "title")).otherwise(F.col("_key"))))
    pointers = state.select("id", duplicate_pointer(F.col("verify")).alias("_to")).filter("_to is not null")
    hopped = owned.join(pointers, "id", "left").withColumn("id", F.coalesce("_to", "id"))
    return first_by(hopped.drop("_numbered", "_key", "_meet", "owner", "_to"), ["id"], F.col(order))


def _batch_side(batch: DataFrame) -> DataFrame:
    """Batch columns as ``b`` with every optional one present and blanks as NULL."""
    cols = []
    for c in BATCH_COLUMNS:
        if c not in batch.columns:
            value = F.lit(None).cast("string")
        elif c == "sec" and batch.schema[c].dataType.typeName() == "array":
            value = blank_to_null(F.array_join(c, ","))
        else:
            value = blank_to_null(F.col(c).cast("string"))
        cols.append(value.alias(c))
    ints = [(F.col(c).cast("int") if c in batch.columns else F.lit(None).cast("int")).alias(c)
            for c in ("size_rank", "employees", "avg_salary", "salary_year")]
    score = (F.col("rel_score") if "rel_score" in batch.columns else F.lit(None)).cast("double").alias("rel_score")
    closed = (F.coalesce(F.col("closed"), F.lit(False)) if "closed" in batch.columns else F.lit(False)).alias("closed")
    return batch.select("id", F.struct(*cols, *ints, score, closed).alias("b"))


def merge_snapshot(state: DataFrame, batch: DataFrame, run_date: str, failed_sources: DataFrame | None = None,
                   order: str = "batch_pos", stale_days: int = 7, failed_days: int = 30) -> DataFrame:
    """Next snapshot (H1-H11); ``is_new`` marks inserted rows (H6).

    One full join of two id-unique tables.  ``failed_sources`` has a column
    ``source``; the legacy source always counts as failed.
    """
    state = conform_state(state)
    return merge_resolved(state, resolve_ids(batch, state, order), run_date, failed_sources, stale_days, failed_days)


def merge_resolved(state: DataFrame, resolved: DataFrame, run_date: str, failed_sources: DataFrame | list[str] | None = None, stale_days: int = 7,
                   failed_days: int = 30) -> DataFrame:
    """The same for a state of that schema and a batch whose ids are resolved; ``id`` of the state is used as it is."""
    s_cols = STATE_SCHEMA.fieldNames()
    b_side = _batch_side(resolved)
    s_side = state.select("id", F.struct(*[c for c in s_cols if c != "id"]).alias("s"))
    both = s_side.join(b_side, "id", "full")
    s, b = F.col("s"), F.col("b")
    have, seen = s.isNotNull(), b.isNotNull()
    closing = seen & F.coalesce(b["closed"], F.lit(False))
    both = both.filter(have | ~closing)                                                        # H2: never insert closed
    touch, insert = have & seen & ~closing, ~have & seen
    verified_now = b["verified_at"].isNotNull()
    kept_official = touch & s["verified_at"].isNotNull() & ~verified_now                       # H4
    refreshed = touch & ~kept_official                                                         # H5
    official = (touch | insert) & verified_now                                                 # H7
    noted = (touch | insert) & ~verified_now & b["verify"].isNotNull() & s["verified_at"].isNull()   # H8
    shut = F.lit(False)
    for prefix in fixed.CLOSED_BY_SOURCE:
        shut = shut | F.startswith(F.coalesce(s["verify"], F.lit("")), F.lit(prefix))
    reopen = touch & (~shut | verified_now)                                                    # H3
    any_seen = touch | insert
    compared = any_seen & (b["cmp_salary"].isNotNull() | b["cmp_size"].isNotNull())            # H9
    today = F.lit(run_date)

    def pick(*rules: tuple[Column, Column], default: Column) -> Column:
        out = F.when(*rules[0])
        for cond, value in rules[1:]:
            out = out.when(cond, value)
        return out.otherwise(default)

    new: dict[str, Column] = {}
    for c in ("company", "title", "track"):
        new[c] = pick((insert, b[c]), default=s[c])
    for c in ("source", "snippet", "size_rank", "size", "rel_score", "tier"):
        new[c] = pick((any_seen, b[c]), default=s[c])
    new["link"] = pick((insert | refreshed, b["link"]), default=s["link"])
    base_exp = pick((insert | refreshed, b["exp"]), default=s["exp"])
    base_deadline = pick((insert | refreshed, F.coalesce(b["deadline"], s["deadline"])), default=s["deadline"])
    base_posted = pick((insert | refreshed, F.coalesce(s["posted"], b["posted"])), default=s["posted"])
    new["exp"] = pick((official, F.coalesce(b["v_exp"], base_exp)), default=base_exp)
    new["deadline"] = pick((official, F.coalesce(b["v_deadline"], base_deadline)), default=base_deadline)
    new["posted"] = pick((official, F.coalesce(b["v_start"], base_posted)), default=base_posted)
    for c in ("location", "edu", "emp_type", "deadline_time", "company_full"):
        new[c] = pick((official, b[c]), default=s[c])
    for c in ("duty", "duty_evidence", "duty_flag"):
        new[c] = pick((official | noted, b[c]), default=s[c])
    new["verify"] = pick((closing, b["verify"]), (official | noted, b["verify"]), default=s["verify"])
    new["verified_at"] = pick((closing, F.coalesce(b["verified_at"], s["verified_at"])), (official, b["verified_at"]),
                              default=s["verified_at"])
    for c in ("sec", "verify_tried_at"):
        new[c] = pick((any_seen, F.coalesce(b[c], s[c])), default=s[c])
    for c in ("csn", "company_form", "employees", "avg_salary", "salary_year", "cmp_salary", "cmp_size"):
        new[c] = pick((compared, b[c]), default=s[c])
    new["mark"] = s["mark"]
    new["first_seen"] = pick((insert, today), default=s["first_seen"])
    new["last_seen"] = pick((any_seen, today), default=s["last_seen"])
    new["status"] = pick((closing, F.lit("closed")), (insert | reopen, F.lit("open")), default=s["status"])
    types = {f.name: f.dataType for f in STATE_SCHEMA.fields}
    merged = both.select("id", *[new[c].cast(types[c]).alias(c) for c in s_cols if c != "id"], (~have).alias("is_new"))
    return close_stale(merged, run_date, failed_sources, stale_days, failed_days)


def close_stale(rows: DataFrame, run_date: str, failed_sources: DataFrame | list[str] | None = None,
                stale_days: int = 7, failed_days: int = 30) -> DataFrame:
    """Close unseen and overdue postings."""
    today = F.lit(run_date).cast("date")
    week_ago, month_ago = (F.date_format(F.date_sub(today, d), "yyyy-MM-dd") for d in (stale_days, failed_days))
    failed = F.coalesce(F.col("source") == fixed.LEGACY_SOURCE, F.lit(False))
    if isinstance(failed_sources, list):  # few names: no join
        failed = failed | F.coalesce(F.col("source").isin(failed_sources), F.lit(False))
    elif failed_sources is not None:
        flag = failed_sources.select("source").distinct().withColumn("_failed", F.lit(True))
        rows = rows.join(flag, "source", "left")
        failed = failed | F.coalesce("_failed", F.lit(False))
    unseen = (F.col("last_seen") < week_ago) & (~failed | (F.col("last_seen") < month_ago))
    overdue = is_dated("deadline") & (F.col("deadline") < F.lit(run_date))
    close = (F.col("status") == "open") & F.coalesce(unseen | overdue, F.lit(False))
    out = rows.withColumn("status", F.when(close, "closed").otherwise(F.col("status")))
    return out.select(*STATE_SCHEMA.fieldNames(), *[c for c in ("is_new",) if c in rows.columns])


FILL = ["mark", "verify", "verified_at", "location", "edu", "emp_type", "deadline_time", "company_full", "duty",
        "duty_evidence", "duty_flag", "csn", "company_form", "cmp_salary", "cmp_size"]


def collapse_canon(state: DataFrame) -> DataFrame:
    """Open rows that share a posting number become one; the others close with a pointer.

    Survivor order: company agrees with the official name (longer name first),
    verified, marked, earliest seen, id.
    """
    state = conform_state(state)
    cols = STATE_SCHEMA.fieldNames()
    keyed = state.withColumn("_canon", F.when(F.col("status") == "open", canon_key("link")))
    groups = keyed.filter("_canon is not null")
    official = groups.groupBy("_canon").agg(
        F.min_by("company_full", F.when(F.col("company_full").isNotNull(), F.struct("first_seen", "id"))).alias("_full"),
        F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    own = normalize_org("company", "posting")
    full = normalize_org("_full", "posting")
    ranked = groups.join(official, "_canon").withColumn("_same", contains_either(own, full)).withColumn("_rank", F.struct(
        (~F.col("_same")).alias("a"), F.when(F.col("_same"), -F.length(own)).otherwise(F.lit(0)).alias("b"),
        F.col("verified_at").isNull().alias("c"), F.col("mark").isNull().alias("d"),
        F.coalesce("first_seen", F.lit("")).alias("e"), F.col("id").alias("f")))
    keep = survivors(ranked.select("_canon", *cols, "_rank"), "_canon", F.col("_rank"), FILL, ["first_seen"], ["last_seen"])
    keep = keep.select("_canon", *cols)
    lost = ranked.select("_canon", *cols).join(keep.select("_canon", F.col("id").alias("_keep")), "_canon").filter("id <> _keep")
    closed = lost.withColumn("status", F.lit("closed")).withColumn("verify", F.concat(F.lit(fixed.DUPLICATE_PREFIX), F.col("_keep")))
    rest = keyed.join(official.select("_canon"), "_canon", "left_anti")
    return rest.select(*cols).unionByName(keep.select(*cols)).unionByName(closed.select(*cols))


def new_ids(merged: DataFrame) -> DataFrame:
    return merged.filter("is_new").select("id")


def to_import_rows(dump: DataFrame) -> DataFrame:
    """Rows of a foreign dump in the shape of the state."""
    fit = F.col("fit")
    ok_deadline = F.col("deadline").rlike(r"^(?:\d{4}-\d{2}-\d{2}|상시|채용시)$")
    high, mid, _ = fixed.FIT_BANDS
    return conform_state(
        dump.withColumn("track", F.coalesce(blank_to_null("track"), F.lit(fixed.EXPERIENCED)))
        .withColumn("deadline", F.when(ok_deadline, F.col("deadline")))
        .withColumn("source", F.lit(fixed.LEGACY_SOURCE))
        .withColumn("snippet", F.col("reason"))
        .withColumn("status", F.coalesce(blank_to_null("status"), F.lit("open")))
        .withColumn("size_rank", rank_from_size_words("size"))
        .withColumn("rel_score", F.when(fit == high, 0.7).when(fit == mid, 0.4).otherwise(0.2))
        .withColumn("tier", F.when(fit.isin(high, mid), fixed.RECOMMENDED).otherwise(fixed.REVIEW))
    )
