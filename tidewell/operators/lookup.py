"""Lookups and record linkage between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import same_month
from ..functions.links import canon_key
from ..functions.orgs import normalize_org
from ..functions.text import import_title_key, record, text_or_blank, title_key
from ..session import cut_lineage
from .automaton import with_longest_name
from .groups import first_by


def spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 1) -> DataFrame:
    """Equality join that splits hot keys of the big side over ``salts`` tasks.

    With one salt Spark decides alone: it broadcasts the small side when its
    size is known to be under the threshold and splits skewed partitions
    otherwise.  More salts replicate the small side, never the big one.
    """
    if salts <= 1:
        return big.join(small, on, how)
    left = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _longest_mentions(texts: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, head: int, longest: int, boundary: bool) -> DataFrame:
    """(id, name): the longest name of ``head`` to ``longest`` signs in each text that has one."""
    lengths = dictionary.groupBy(F.substring("_n", 1, head).alias("_g")).agg(
        F.array_sort(F.collect_set(F.length("_n"))).alias("_lengths"))  # at most `longest` numbers
    framed = F.concat(F.lit("\u0000"), F.lower(text_or_blank(text_col)), F.lit("\u0000"))
    # the sign before a place, the place, one sign more; a look-ahead yields all of them in one pass
    windows = F.array_distinct(F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{head + 1},{longest + 2}}}))"), 1))
    places = texts.select(id_col, F.explode(windows).alias("_w")).withColumn("_g", F.substring("_w", 2, head))
    cut = places.join(lengths, "_g").select(id_col, "_w", F.explode("_lengths").alias("_len")).filter(
        F.length("_w") > F.col("_len")).withColumn("_n", F.substring(F.col("_w"), F.lit(2), F.col("_len")))
    if boundary:
        before, after = F.substring("_w", 1, 1), F.substring(F.col("_w"), F.col("_len") + 2, F.lit(1))
        cut = cut.filter(~(before.rlike("[a-z]") & F.col("_n").rlike("^[a-z0-9]")) & ~(after.rlike("[a-z]") & F.col("_n").rlike("[a-z0-9]$")))
    hit = cut.select(id_col, "_n").join(dictionary, "_n")
    return hit.groupBy(id_col).agg(F.min_by("name", F.struct(-F.length("_n"), F.col("_n"))).alias("name"))


def mention_join(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str,
                 gram: int = 4, boundary: bool = False) -> DataFrame:
    """Longest dictionary name inside each text, for a dictionary that no worker holds.

    Every place of a text is cut to the longest name's length; places whose head
    starts no name go out in an equality join on that head, the others are cut
    to the name lengths that occur with the head and meet the whole names in a
    second equality join.  No text meets more names than it has places and
    lengths, however many names share a head.

    Heads have ``gram`` signs.  Shorter names cannot be the longest of a text
    that holds a longer one, so they are looked up, with heads of half the
    signs each time, only in the texts that are left.
    """
    dictionary = _dictionary(names, name_col)
    shortest, longest = dictionary.agg(F.min(F.length("_n")), F.max(F.length("_n"))).first()  # two numbers
    if longest is None:
        return texts.withColumn("name", F.lit(None).cast("string"))
    found, rest, head, below = None, texts, gram, longest + 1
    while True:
        head = max(head, shortest)
        if head < below:
            if found is not None:
                found = cut_lineage(found)
                rest = texts.join(found, id_col, "left_anti")
            tier = dictionary.filter(F.length("_n").between(head, below - 1))
            hits = _longest_mentions(rest, id_col, text_col, tier, head, below - 1, boundary)
            found, below = hits if found is None else found.unionByName(hits), head
        if head == shortest:
            return texts.join(found, id_col, "left")
        head //= 2


def _dictionary(names: DataFrame, name_col: str) -> DataFrame:
    """(_n, name): distinct names in lower case, each with the first of its spellings."""
    keyed = names.select(F.col(name_col).alias("name"), F.lower(name_col).alias("_n"))
    return keyed.filter(F.length("_n") >= 1).groupBy("_n").agg(F.min("name").alias("name"))


AUTOMATON_SIGNS = 8_000_000
"""Signs of all names together up to which a dictionary is broadcast; an automaton takes some 40 bytes a sign at most."""


def longest_mentions(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str, gram: int = 4, boundary: bool = False,
                     automaton_signs: int = AUTOMATON_SIGNS) -> DataFrame:
    """``texts`` with ``name``, the longest dictionary name inside each, ties to the first in the alphabet.

    The signs of the dictionary are counted first.  Up to ``automaton_signs`` the
    names are broadcast and every worker compiles one automaton of them: one
    pass over each text where it is read, no explode, no shuffle.  A larger
    dictionary stays distributed and meets the texts in :func:`mention_join`;
    only then must the ids be unique.
    """
    dictionary = _dictionary(names, name_col)
    signs = dictionary.agg(F.sum(F.length("_n"))).first()[0]  # one number
    if signs is None:
        return texts.withColumn("name", F.lit(None).cast("string"))
    if signs <= automaton_signs:
        return with_longest_name(texts, text_col, dictionary, boundary)
    return mention_join(texts, id_col, text_col, names, name_col, gram, boundary).select(*texts.columns, "name")


def affiliate_group(rows: DataFrame, aliases: DataFrame, names: list[str], out: str = "group") -> DataFrame:
    """Group of the first name that equals a registered alias (D3)."""
    found = rows
    own = F.concat(F.lit("\u0000"), F.xxhash64(*rows.columns).cast("string"))  # rows without a name do not pile up on one key
    for i, name in enumerate(names):
        side = aliases.select(F.col("alias").alias(f"_a{i}"), F.col("group").alias(f"_g{i}"))
        found = found.withColumn(
            f"_a{i}", F.coalesce(F.nullif(normalize_org(name, "affiliate"), F.lit("")), own)).join(side, f"_a{i}", "left").drop(f"_a{i}")
    return found.withColumn(out, F.coalesce(*[f"_g{i}" for i in range(len(names))])).drop(*[f"_g{i}" for i in range(len(names))])


def latest_profiles(log: DataFrame, keys: list[str], fetched: str) -> DataFrame:
    return first_by(log, keys, F.col(fetched), latest=True)


def fresh_profile(rows: DataFrame, profiles: DataFrame, keys: list[str], run_date: Column, fetched: str = "fetched",
                  ttl_days: int = 30) -> DataFrame:
    """Newest profile per name; stale ones count as not known, negative ones are fresh too."""
    newest = latest_profiles(profiles, keys, fetched)
    values = [c for c in newest.columns if c not in keys]
    joined = rows.join(newest, keys, "left")
    fresh = F.coalesce(F.col(fetched) >= F.date_sub(run_date, ttl_days), F.lit(False))
    out = joined.withColumn("_fresh", fresh)
    for c in values:
        out = out.withColumn(c, F.when(F.col("_fresh"), F.col(c)))
    return out.withColumnRenamed("_fresh", "fresh")


def best_company(queries: DataFrame, listing: DataFrame, query_id: str, name: str, listed: str, pos: str) -> DataFrame:
    """Search results of a name: 3 equal, 2 containing; first best of at least 2.

    ``listing`` carries the query id of the search it came from, so this is an
    equality join and an arg-max.
    """
    q, n = normalize_org(name, "profile"), normalize_org(listed, "profile")
    score = F.when(n == "", 0).when(n == q, 3).when(F.contains(n, q) | F.contains(q, n), 2).otherwise(0)
    scored = queries.join(listing, query_id).withColumn("score", score).filter("score >= 2")
    return first_by(scored, [query_id], F.struct(-F.col("score"), F.col(pos)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _segments(k: Column, tau: float) -> Column:
    """A title key cut into one part more than the edits its partners may need: array of (text, start)."""
    n = F.length(k)
    parts = F.floor(n * (1 - tau) / tau + 1e-9).cast("int") + 1
    cuts = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: record(
        text=F.substring(k, (F.floor(i * n / parts) + 1).cast("int"), (F.floor((i + 1) * n / parts) - F.floor(i * n / parts)).cast("int")),
        start=(F.floor(i * n / parts) + 1).cast("int")))
    return F.when(n == 0, F.array(record(text=F.lit(""), start=F.lit(1)))).otherwise(cuts)


def _pieces(k: Column, tau: float) -> Column:
    """Substrings of a title key as long as the segments of any partner: array of (text, start)."""
    n = F.length(k)
    partner = F.sequence(F.ceil(n * tau - 1e-9).cast("int"), F.floor(n / tau + 1e-9).cast("int"))

    def spans(m: Column) -> Column:
        parts = F.floor(m * (1 - tau) / tau + 1e-9) + 1
        return F.array(F.floor(m / parts).cast("int"), F.ceil(m / parts).cast("int"))

    def windows(w: Column) -> Column:
        return F.when((w >= 1) & (w <= n), F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: record(text=F.substring(k, i, w), start=i)))

    widths = F.array_distinct(F.flatten(F.transform(partner, spans)))
    return F.when(n == 0, F.array(record(text=F.lit(""), start=F.lit(1)))).otherwise(
        F.flatten(F.array_compact(F.transform(widths, windows))))


def _best_titles(a: DataFrame, b: DataFrame, keys: list[str], tau: float, accept: float, extra: Column) -> DataFrame:
    """(keys, _ta, _idb, score): the best of ``b`` (_tb, _kb, _idb) for every title of ``a`` (_ta, _ka) among equal keys.

    If two keys differ by at most k edits and one is cut into k + 1 segments,
    some segment survives whole in the other, at most k signs away from where it
    was: an equality of keys and segment, not all pairs of equal keys, and it
    loses nothing.  A segment common to many titles pairs only those whose
    lengths and places agree.
    """
    x = a.select("*", F.explode(_pieces(F.col("_ka"), tau)).alias("_pa")).select(*keys, "_ta", "_ka", F.col("_pa.text").alias("_s"), F.col("_pa.start").alias("_sa"))
    y = b.select("*", F.explode(_segments(F.col("_kb"), tau)).alias("_pb")).select(
        *[F.col(c).alias(f"{c}_b") for c in keys], "_tb", "_kb", "_idb", F.col("_pb.text").alias("_sb"), F.col("_pb.start").alias("_sbat"))
    la, lb = F.length("_ka"), F.length("_kb")
    meet = F.col("_s") == F.col("_sb")
    for c in keys:
        meet = meet & (F.col(c) == F.col(f"{c}_b"))
    long_enough = F.least(la, lb) >= F.greatest(la, lb) * tau - 1e-9
    near = x.join(y, meet & long_enough & (F.abs(F.col("_sa") - F.col("_sbat")) <= F.floor(F.greatest(la, lb) * (1 - tau) + 1e-9)))
    scored = near.withColumn("score", F.round(similarity(F.col("_ka"), F.col("_kb")) + extra, 6)).filter(F.col("score") >= accept).filter(same_month("_ta", "_tb"))
    return first_by(scored.select(*keys, "_ta", "_idb", "score"), [*keys, "_ta"], F.struct(-F.col("score"), F.col("_idb")))


def link_records(left: DataFrame, right: DataFrame, block: list[str], title_left: str, title_right: str, id_left: str,
                 id_right: str, accept: float, company_bonus: Column | None = None, most_bonus: float = 0.0) -> DataFrame:
    """Best partner by title similarity inside a block.

    Only titles that can reach the needed similarity meet, see
    :func:`_best_titles`.  Equal titles are compared once.  Titles that name
    different months never match (J22).  ``most_bonus`` is the largest value
    ``company_bonus`` may add.
    """
    tau = accept - most_bonus
    if not 0.5 < tau <= 1:
        raise ValueError("the needed similarity must lie between 0.5 and 1")

    def reduced(df: DataFrame, title: str, id_col: str, tag: str) -> DataFrame:
        keyed = df.select(*block, F.col(title).alias(f"_t{tag}"), title_key(title).alias(f"_k{tag}"), F.col(id_col).alias(f"_id{tag}"))
        return keyed.groupBy(*block, f"_t{tag}", f"_k{tag}").agg(F.min(f"_id{tag}").alias(f"_id{tag}"))

    a, b = reduced(left, title_left, id_left, "a"), reduced(right, title_right, id_right, "b")
    best = _best_titles(a, b, block, tau, accept, company_bonus if company_bonus is not None else F.lit(0.0))
    renamed = best.select(*block, F.col("_ta").alias(title_left), F.col("_idb").alias(f"{id_right}_match"), "score")
    return left.join(renamed, [*block, title_left], "left")


def contained_names(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(name, piece): every ``name`` of ``inner`` spelled inside a ``name`` of ``outer``, itself included.

    At every sign of an outer name only lengths that inner names with this first
    sign have are cut out, so a long name costs its length times a few.
    """
    names = inner.select("name").filter("name <> ''").distinct()
    lengths = names.groupBy(F.substring("name", 1, 1).alias("_head")).agg(F.collect_set(F.length("name")).alias("_lengths"))
    at = outer.select("name").filter("name <> ''").distinct().select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("_at"))
    fits = F.filter("_lengths", lambda w: w <= F.length("name") - F.col("_at") + 1)
    cut = at.withColumn("_head", F.substring(F.col("name"), F.col("_at"), F.lit(1))).join(lengths, "_head").select(
        "name", F.explode(F.transform(fits, lambda w: F.substring(F.col("name"), F.col("_at"), w))).alias("piece"))
    return cut.join(names.select(F.col("name").alias("piece")), "piece", "left_semi").select("name", "piece").distinct()


def link_by_evidence(left: DataFrame, right: DataFrame, title_left: str, title_right: str, company_left: str, company_right: str,
                     id_right: str, accept: float = 0.95, bonus: float = 0.35, malus: float = -0.5) -> DataFrame:
    """Best partner by title similarity, plus ``bonus`` where the companies agree and ``malus`` where not.

    Companies agree if one name without legal form lies inside the other; a
    blank name agrees with none.  No block is needed: names that lie in others
    are found among distinct names, and each side is met under the names inside
    its own, so agreement is an equality too.  A side is cut down to one row per
    meeting name and title before the join: neither a short name inside many nor
    a title at many companies is paired with all of them.  Partners elsewhere
    are searched only if ``accept - malus`` can be reached, by that similarity.
    ``<id_right>_match`` and ``score`` are null without a partner; ties go to
    the smaller id; rows keep their columns, repeated rows stay.
    """
    if not 0.5 < accept - bonus <= 1 or malus > bonus:
        raise ValueError("accept - bonus must lie between 0.5 and 1, and malus not above bonus")
    org = lambda c: normalize_org(c, "detail")
    a = left.select(org(company_left).alias("_ca"), F.coalesce(F.col(title_left), F.lit("")).alias("_ta"), title_key(title_left).alias("_ka")).distinct()
    b = right.groupBy(org(company_right).alias("_cb"), F.coalesce(F.col(title_right), F.lit("")).alias("_tb"), title_key(title_right).alias("_kb")).agg(
        F.min(id_right).alias("_idb"))
    names_a, names_b = a.select(F.col("_ca").alias("name")), b.select(F.col("_cb").alias("name"))
    inside_b = contained_names(names_b, names_a).select(F.col("name").alias("_cb"), F.col("piece").alias("_meet"))
    inside_a = contained_names(names_a, names_b).filter("name <> piece").select(F.col("name").alias("_ca"), F.col("piece").alias("_meet"))

    under = a.filter("_ca <> ''").select(F.lit(1).alias("_way"), F.col("_ca").alias("_meet"), "_ca", "_ta", "_ka").unionByName(
        a.join(inside_a, "_ca").select(F.lit(2).alias("_way"), "_meet", "_ca", "_ta", "_ka"))
    other = b.join(inside_b, "_cb").select(F.lit(1).alias("_way"), "_meet", "_tb", "_kb", "_idb").unionByName(
        b.filter("_cb <> ''").select(F.lit(2).alias("_way"), F.col("_cb").alias("_meet"), "_tb", "_kb", "_idb"))
    keys = ["_way", "_meet"]
    agreeing = _best_titles(under.select(*keys, "_ta", "_ka").distinct(), other.groupBy(*keys, "_tb", "_kb").agg(F.min("_idb").alias("_idb")),
                            keys, accept - bonus, accept, F.lit(bonus))
    found = under.join(agreeing, [*keys, "_ta"]).select("_ca", "_ta", "_idb", "score")
    if accept - malus <= 1:
        elsewhere = _best_titles(a.select("_ta", "_ka").distinct(), b.groupBy("_tb", "_kb").agg(F.min("_idb").alias("_idb")), [], accept - malus, accept, F.lit(malus))
        found = found.unionByName(a.select("_ca", "_ta").join(elsewhere, "_ta").select("_ca", "_ta", "_idb", "score"))
    best = first_by(found, ["_ca", "_ta"], F.struct(-F.col("score"), F.col("_idb"))).select("_ca", "_ta", F.col("_idb").alias(f"{id_right}_match"), "score")
    keyed = left.withColumn("_ca", org(company_left)).withColumn("_ta", F.coalesce(F.col(title_left), F.lit("")))
    return keyed.join(best, ["_ca", "_ta"], "left").drop("_ca", "_ta")


def _prefixes(name: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, F.lit(1), i))


def import_new(dump: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of a foreign dump the state does not know.

    Known means: same id, same (company, title), same posting number, or same
    title with one company name a prefix of the other.  The prefix test becomes
    an equality join on the existing prefixes, so no title group is compared in
    pairs.
    """
    d = (dump.withColumn("_org", normalize_org("company", "posting")).withColumn("_title", import_title_key("title"))
         .withColumn("_canon", canon_key("link")))
    s = state.select("id", normalize_org("company", "posting").alias("_org"), import_title_key("title").alias("_title"),
                     canon_key("link").alias("_canon"))
    names = s.select("_title", "_org").distinct()
    d = d.join(s.select("id").distinct(), "id", "left_anti")
    d = d.join(names, ["_title", "_org"], "left_anti")
    own = F.concat(F.lit("none:"), F.xxhash64("_org", "_title").cast("string"))  # rows without a number do not pile up on NULL
    d = d.withColumn("_meet", F.coalesce("_canon", own))
    d = d.join(s.filter("_canon is not null").select(F.col("_canon").alias("_meet")).distinct(), "_meet", "left_anti").drop("_meet")

    filled = names.filter("_org <> ''")
    known_heads = filled.select("_title", F.explode(_prefixes(F.col("_org"))).alias("_head")).distinct()  # state name starts with the dump's name
    d = d.join(known_heads, (d["_title"] == known_heads["_title"]) & (d["_org"] == known_heads["_head"]), "left_anti")
    # dump name starts with a state name
    exploded = d.filter("_org <> ''").select("_title", "_org").distinct().select(
        "_title", "_org", F.explode(_prefixes(F.col("_org"))).alias("_head"))
    longer = exploded.join(filled.withColumnRenamed("_org", "_head"), ["_title", "_head"], "left_semi").select("_title", "_org").distinct()
    return d.join(longer, ["_title", "_org"], "left_anti").drop("_org", "_title", "_canon")


def semi_flag(rows: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """Membership in another list as a flag."""
    return rows.join(members.select(key).distinct().withColumn(out, F.lit(True)), key, "left").withColumn(
        out, F.coalesce(out, F.lit(False)))
