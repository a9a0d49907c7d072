"""Duplicate and sibling postings: links by shared keys, then components.

Comparing all pairs inside a company or a title group is what breaks at scale,
so links are found by *hubs*: if every row with key k on one side must be linked
to every row with key k on the other, it is enough to tie all of them to one hub
node, because the components are the same.  Rows that are equal in everything
that is compared are first folded into one signature.  Real pairs are formed
only for the word-cover rule with two or more words, and there only between
signatures that share the rarest word of one of them, the company and the field set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.links import representative_score, site_label
from ..functions.orgs import org_variants
from ..functions.text import blank_to_null, one_of, record
from ..functions.titles import (
    bare_title, base_tokens, hiring_name, is_agency, residual_tokens, title_core, title_fields, title_tokens, token_cover,
)
from ..session import cut_lineage
from .components import connected_components
from .groups import chunked_members


# Hub nodes carry the last code point in front, so the least node of a component is a posting.
HUB = "\U0010FFFF"


def _key(*parts: Column | str) -> Column:
    """128-bit key of the parts; parts are length-prefixed so they cannot run together."""
    texts = [(F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else (F.col(p) if isinstance(p, str) else p)) for p in parts]
    texts = [F.coalesce(t.cast("string"), F.lit("\u0000")) for t in texts]
    joined = F.concat_ws("\u0001", *[x for t in texts for x in (F.length(t).cast("string"), t)])
    return F.concat(F.lit(HUB), F.md5(F.encode(joined, "UTF-8")))


def _heads(word: Column, shortest: int = 2) -> Column:
    """The word and its heads of at least two signs."""
    return F.when(F.length(word) >= shortest, F.transform(
        F.sequence(F.lit(shortest), F.length(word)), lambda i: F.substring(word, F.lit(1), i))).otherwise(F.array(word))


def contained_variants(companies: DataFrame) -> DataFrame:
    """(company, name, exact): every existing name spelled inside a company's names.

    Two companies are the same when a name of one lies inside a name of the
    other; with this table that test is an equality of names of which at least
    one is exact.  Work grows with distinct companies, not with postings.
    """
    own = companies.select("company", F.explode(org_variants("company")).alias("name"))
    names = own.select("name").distinct()

    def inner(n: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(n) - 1), lambda i: F.transform(
            F.sequence(F.lit(2), F.length(n) - i + 1), lambda w: F.substring(n, i, w))))

    pieces = names.select("name", F.explode(F.array_distinct(inner(F.col("name")))).alias("piece"))
    inside = pieces.join(names.select(F.col("name").alias("piece")), "piece")
    return (
        own.join(inside, "name").select("company", F.col("piece").alias("name"), (F.col("piece") == F.col("name")).alias("exact"))
        .groupBy("company", "name").agg(F.max("exact").alias("exact"))
    )


def _hub_edges(sides: DataFrame) -> DataFrame:
    """(sig, hub) for hubs that have both a left and a right member."""
    ok = sides.groupBy("hub").agg(F.max((F.col("side") == "l")).alias("_l"), F.max(F.col("side") == "r").alias("_r")).filter("_l and _r")
    return sides.join(ok.select("hub"), "hub", "left_semi").select(F.col("sig").alias("u"), F.col("hub").alias("v")).distinct()


def _sides(df: DataFrame, side: str, hub: Column) -> DataFrame:
    return df.select("sig", F.lit(side).alias("side"), hub.alias("hub"))


def _two_way(left: DataFrame, right: DataFrame, tag: str, cols: list[str]) -> DataFrame:
    """Hub memberships for "equal key and at least one exact name" (two families)."""
    parts = []
    for family, l_rows, r_rows in (("1", left.filter("exact"), right), ("2", left, right.filter("exact"))):
        hub = _key(f"={tag}{family}", *cols)
        parts += [_sides(l_rows, "l", hub), _sides(r_rows, "r", hub)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cover_pairs(left: DataFrame, right: DataFrame, cols: list[str], words: str, two_way: bool) -> DataFrame:
    """Pairs where every word of the left set is met in the right set (I8), two or more words on the left."""
    l = left.filter(F.size(words) >= 2).select("sig", F.col(words).alias("_lw"), *cols, *(["exact"] if two_way else []))
    r = right.select(F.col("sig").alias("_rsig"), F.col(words).alias("_rw"), *cols,
                     *([F.col("exact").alias("_rexact")] if two_way else []))
    if two_way:  # one side must be exact: two joins, so that pairs of inexact rows never arise
        inexact = l.filter(~F.coalesce("exact", F.lit(False))).drop("exact")
        pairs = l.filter("exact").drop("exact").join(r.drop("_rexact"), cols).unionByName(
            inexact.join(r.filter("_rexact").drop("_rexact"), cols))
    else:
        pairs = l.join(r, cols)
    return pairs.filter(F.col("sig") != F.col("_rsig")).filter(token_cover(F.col("_lw"), F.col("_rw"))).select(F.col("sig").alias("u"), F.col("_rsig").alias("v"))


def _with_anchor(sets: DataFrame, group: list[str], words: str) -> DataFrame:
    """Rarest word of each set inside its group as ``anchor``; a word all sets share anchors only sets of such words."""
    exploded = sets.select("sig", *group, F.explode(words).alias("_w"))
    counts = exploded.groupBy(*group, "_w").agg(F.count(F.lit(1)).alias("_c"))
    best = exploded.join(counts, [*group, "_w"]).groupBy("sig", *group).agg(
        F.min_by("_w", F.struct("_c", -F.length("_w"), F.col("_w"))).alias("anchor"))
    return sets.join(best, ["sig", *group])


def _word_keys(df: DataFrame, words: str, side: str) -> DataFrame:
    """Word keys: left rows by their anchor word, right rows by all words.

    Word x meets word y when one is a head of the other: x equals a head of y
    (form 0) or y equals a proper head of x (form 1).
    """
    def forms(w: Column) -> Column:
        whole, heads = F.array(w), _heads(w)
        own, other = (whole, F.slice(heads, 1, F.greatest(F.size(heads) - 1, F.lit(0)))) if side == "l" else (heads, whole)
        tag = lambda arr, t: F.transform(arr, lambda x: record(form=F.lit(t), word=x))
        return F.concat(tag(own, 0), tag(other, 1))

    if side == "l":
        keys = forms(F.col("anchor"))
    else:
        keys = F.array_distinct(F.flatten(F.transform(F.col(words), forms)))
    return df.filter(F.size(words) > 0).withColumn("_wk", F.explode(keys)).withColumn("form", F.col("_wk.form")).withColumn(
        "word", F.col("_wk.word")).drop("_wk")


def _postings_only(roots: DataFrame) -> DataFrame:
    return roots.filter(~F.startswith("node", F.lit(HUB)))


def duplicate_signatures(jobs: DataFrame) -> DataFrame:
    """One row per distinct (status, company, title) with compared features; ``sig`` is its least id."""
    sig = jobs.groupBy("status", "company", "title").agg(F.min("id").alias("sig"))
    return sig.select(
        "sig", "status", "company", "title",
        title_core("title", "company").alias("core"), title_tokens("title", "company").alias("words"),
        F.array_join(title_fields("title"), ",").alias("fields"))


def duplicate_edges(sigs: DataFrame) -> DataFrame:
    """Links between signatures of one posting: equal or extended title core at one company (I5),
    or equal field set and covering words at one company (I9)."""
    names = contained_variants(sigs.select("company").distinct())
    rows = cut_lineage(sigs.join(names, "company"))

    # Core of one equals the other's, or is its head with at most four signs more
    cores = F.concat(F.array("core"), F.filter(F.transform(
        F.sequence(F.lit(1), F.lit(4)), lambda k: F.when(F.length("core") - k >= 10, F.substring(F.col("core"), F.lit(1), F.length("core") - k))),
        lambda x: x.isNotNull()))
    core_hubs = _two_way(rows.withColumn("c", F.col("core")), rows.withColumn("c", F.explode(cores)), "core",
                         ["status", "c", "name"])
    # I9 without words: equal cores, covered by I5.  Equal word sets at one company: one hub,
    # and only their first signature takes part below.
    full = rows.filter(F.size("words") > 0)
    same = ["status", "company", "fields", "words"]
    ties = full.select(F.col("sig").alias("u"), _key("=set", *same[:3], F.array_join("words", "\u0002")).alias("v"))
    sets = cut_lineage(full.groupBy(*same, "name", "exact").agg(F.min("sig").alias("sig")))
    sets = cut_lineage(_with_anchor(sets, ["status", "fields", "name"], "words"))
    left, right = _word_keys(sets, "words", "l"), _word_keys(sets, "words", "r")
    cols = ["status", "fields", "name", "form", "word"]
    # one word: hubs; two and more: pairs that share the rarest word
    word_hubs = _two_way(left.filter(F.size("words") == 1), right, "word", cols)
    pairs = _cover_pairs(left, right, cols, "words", True)
    return _hub_edges(core_hubs.unionByName(word_hubs)).unionByName(ties).unionByName(pairs).distinct()


def duplicate_roots(jobs: DataFrame) -> DataFrame:
    """(id, root) of every posting: same status, transitively the same posting."""
    sigs = cut_lineage(duplicate_signatures(jobs))
    roots = connected_components(duplicate_edges(sigs))
    by_sig = sigs.select("sig", "status", "company", "title", (F.size(org_variants("company")) > 0).alias("_named")) \
        .join(_postings_only(roots).withColumnRenamed("node", "sig"), "sig", "left")
    ids = jobs.select("id", "status", "company", "title").join(
        by_sig, jobs["status"].eqNullSafe(by_sig["status"]) & jobs["company"].eqNullSafe(by_sig["company"])
        & jobs["title"].eqNullSafe(by_sig["title"]))
    # copies of a posting whose company has no usable name stay apart
    return ids.select("id", F.when(F.col("_named"), F.coalesce("root", "sig")).otherwise(F.col("id")).alias("root"))


def sibling_edges(rows: DataFrame) -> DataFrame:
    """Links between postings of one hiring at exactly one company.

    Shared link, shared hiring name, same title but for the last bracket,
    covering base words, or equal residual words when no base words exist.
    """
    plain = rows.filter(~is_agency("company")).select(
        F.col("id").alias("sig"), "status", "pos", blank_to_null("link").alias("link"), "title",
        bare_title("title").alias("bare"), hiring_name("title", "company").alias("hiring"),
        base_tokens("title", "company").alias("words"), residual_tokens("title", "company").alias("rest"),
        F.explode(org_variants("company")).alias("name"))
    plain = cut_lineage(plain)

    def shared(df: DataFrame, tag: str, *cols: Column | str) -> DataFrame:
        return df.select(F.col("sig").alias("u"), _key(f"={tag}", "status", "name", *cols).alias("v"))

    link = shared(plain.filter("link is not null"), "link", "link")
    hiring = shared(plain.filter("hiring is not null"), "hiring", "hiring")
    rest = shared(plain.filter((F.size("words") == 0) & (F.size("rest") > 0)), "rest", F.array_join("rest", "\u0002"))
    # the earlier of two postings must be the one that carries a bracket
    group = ["status", "name", "bare"]
    long_bare = plain.filter(F.length("bare") >= 8)
    first = long_bare.filter(F.col("bare") != F.col("title")).groupBy(*group).agg(F.min("pos").alias("_first"))
    bracket = shared(long_bare.join(first, group).filter(F.col("pos") >= F.col("_first")), "bare", "bare")

    # equal word sets are tied by a hub, so only distinct sets are compared
    equal_sets = shared(plain.filter(F.size("words") > 0), "set", F.array_join("words", "\u0002"))
    sets = plain.filter(F.size("words") > 0).groupBy("status", "name", "words").agg(F.min("sig").alias("sig"))
    sets = cut_lineage(_with_anchor(sets, ["status", "name"], "words"))
    left, right = _word_keys(sets, "words", "l"), _word_keys(sets, "words", "r")
    cols = ["status", "name", "form", "word"]
    hub = _key("=base", *cols)
    one_word = _hub_edges(_sides(left.filter(F.size("words") == 1), "l", hub).unionByName(_sides(right, "r", hub)))
    pairs = _cover_pairs(left, right, cols, "words", False)
    out = link
    for part in (hiring, rest, bracket, one_word, equal_sets, pairs):
        out = out.unionByName(part)
    return out.distinct()


def sibling_roots(rows: DataFrame) -> DataFrame:
    """(id, root): transitive closure of sibling links."""
    roots = connected_components(sibling_edges(rows))
    own = _postings_only(roots).withColumnRenamed("node", "id")
    return rows.select("id").join(own, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _with_rank(jobs: DataFrame) -> DataFrame:
    """Representative order: score, then view order (newest first), then id."""
    score = representative_score("verify", "link", "source", "deadline")
    pos = jobs if "pos" in jobs.columns else jobs.withColumn(
        "pos", F.struct((-F.coalesce(F.unix_date(F.try_to_date("first_seen")), F.lit(0))).alias("newest"), F.col("id").alias("pid")))
    return pos.withColumn("_rank", F.struct((-score).alias("s"), F.col("pos").alias("p")))


def _sections_union(name: str) -> Column:
    """Union of section sets in fixed order."""
    return F.array_distinct(F.flatten(F.collect_set(name)))


def _is_dated(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(r"^\d{4}-"), F.lit(False))


def collapse(jobs: DataFrame, roots: DataFrame, how: str, section_order: list[str] | None = None) -> DataFrame:
    """One representative row per root; everything is an aggregate with map-side combine.

    ``how`` is ``duplicate`` (deadline of the best-ranked dated member) or
    ``bundle`` (earliest dated deadline).
    """
    order = one_of(section_order or fixed.SECTION_ORDER)
    ranked = _with_rank(jobs.join(roots, "id"))
    payload = [c for c in jobs.columns if c not in ("first_seen", "deadline", "sec", "n_merged", "pos")]
    dated = F.when(_is_dated("deadline"), F.col("deadline"))
    if how == "bundle":
        other = F.min(dated)
    else:
        other = F.min_by(dated, F.when(dated.isNotNull(), F.col("_rank")))
    already = F.col("n_merged") if "n_merged" in jobs.columns else F.lit(1)
    best = ranked.groupBy("root").agg(
        F.min_by(F.struct(*payload), F.col("_rank")).alias("_b"), F.min_by("deadline", F.struct(F.col("_rank"))).alias("_dl"),
        F.min(F.col("pos")).alias("pos"), F.min("first_seen").alias("first_seen"), other.alias("_other"),
        _sections_union("sec").alias("_sec"), F.sum(already).alias("n_merged"))
    own = F.coalesce(F.col("_dl").rlike(r"^\d{4}-"), F.lit(False))
    return best.select(
        "_b.*", "first_seen", F.when(own, F.col("_dl")).otherwise(F.coalesce("_other", "_dl")).alias("deadline"),
        F.filter(order, lambda s: F.array_contains(F.col("_sec"), s)).alias("sec"), "pos", "n_merged")


def members_of(jobs: DataFrame, roots: DataFrame, reps: DataFrame, kind: str) -> DataFrame:
    """Tidy member rows of each representative: alias ids, other links, roles."""
    best = roots.join(reps.select(F.col("id")), "id", "left_semi").select("root", F.col("id").alias("rep_id"))
    rows = jobs.select("id", "title", "link").join(roots, "id").join(best, "root").filter(F.col("id") != F.col("rep_id"))
    return rows.select("rep_id", F.col("id").alias("alias_id"), "title", "link", site_label("link").alias("site"),
                       F.lit(kind).alias("kind"))


def merge_duplicates(jobs: DataFrame, section_order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """View of postings without duplicates and siblings, and the member table.

    ``jobs`` needs ``id, status, company, title, link, source, verify,
    deadline, first_seen, sec``.  A component may hold any share of the rows, so
    aliases and roles are rows of the second table; ``nest_members`` turns them
    into arrays of bounded length.
    """
    jobs = cut_lineage(jobs)
    dup_roots = cut_lineage(duplicate_roots(jobs))
    reps = cut_lineage(collapse(jobs, dup_roots, "duplicate", section_order))
    sib_roots = cut_lineage(sibling_roots(reps))
    view = collapse(reps, sib_roots, "bundle", section_order)
    aliases = members_of(jobs, dup_roots, reps, "also")
    roles = members_of(reps, sib_roots, view, "role")
    # duplicates of a bundled posting follow it to the final representative
    moved = aliases.join(roles.select(F.col("alias_id").alias("rep_id"), F.col("rep_id").alias("_to")), "rep_id", "left")
    final = moved.select(F.coalesce("_to", "rep_id").alias("rep_id"), "alias_id", "title", "link", "site", "kind")
    return view, final.unionByName(roles)


def other_links(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct further links of each representative (the "also" list)."""
    own = reps.select(F.col("id").alias("rep_id"), F.col("link").alias("_own"))
    return (
        members.filter((F.col("kind") == "also") & blank_to_null("link").isNotNull()).join(own, "rep_id")
        .filter(~F.col("link").eqNullSafe(F.col("_own"))).select("rep_id", "site", "link").distinct())


def nest_members(members: DataFrame, max_len: int = 1000) -> DataFrame:
    """Members as arrays of bounded length, all of them kept."""
    item = F.struct("alias_id", "title", "link", "site", "kind")
    return chunked_members(members, "rep_id", item, "alias_id", max_len)
