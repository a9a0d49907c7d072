"""Landed feed payloads to candidates, described by data.

A ``FeedSpec`` says where the records of a payload are and how each output
field is read; the payloads themselves are files or table columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, matches, record, squeeze, strip_tags
from ..operators.groups import first_by

Read = Callable[[Column], Column]


@dataclass(frozen=True)
class FeedSpec:
    """How to read one kind of payload.

    ``kind``    ``json``: the payload is JSON of type ``schema``;
                ``script``: JSON sits in page script, ``pattern`` captures it;
                ``cards``: ``pattern`` captures each card of a page;
                ``variant``: the payload is JSON of no stated type, ``path``
                leads to its list of records.
    ``items``   record list inside the parsed payload (JSON kinds).
    ``fields``  output field -> reader over one record; ``title`` is required.
    ``key``     record number; the first record of a number wins.
    ``is_open`` filter over a record and the run time.
    ``known``   keys of a variant record that are read; the other ones are kept
                as text in a map ``rest``.
    ``roles``   list of roles of a record; each role that passes ``role_net``
                becomes a row, a record without one stays a title-only row.
    """

    name: str
    kind: str
    fields: dict[str, Read]
    schema: str | None = None
    pattern: str | None = None
    items: Read | None = None
    script_key: Read | None = None
    escaped: bool = False
    key: Read | None = None
    is_open: Callable[[Column, Column], Column] | None = None
    roles: Read | None = None
    role_name: Read | None = None
    role_net: str | None = None
    extra: dict[str, Read] = field(default_factory=dict)
    path: str = "$"
    known: list[str] | None = None


def variant_field(path: str, kind: str = "string") -> Read:
    """Reader of a variant record: the value at ``path`` (below ``$.``), NULL if it is missing or of another kind."""
    return lambda rec: F.try_variant_get(rec, f"$.{path}", kind)


def _variant_rest(rec: Column, known: list[str]) -> Column:
    return F.map_filter(F.try_variant_get(rec, "$", "map<string,string>"), lambda k, _: ~k.isin(known) if known else F.lit(True))


def _records(raw: DataFrame, spec: FeedSpec, payload: str) -> DataFrame:
    keep = [c for c in raw.columns if c != payload]
    if spec.kind == "cards":
        return raw.select(*keep, F.posexplode(F.regexp_extract_all(F.col(payload), F.lit(spec.pattern), 1)).alias("pos", "rec"))
    if spec.kind == "json":
        parsed = raw.select(*keep, F.from_json(payload, spec.schema, {"mode": "PERMISSIVE"}).alias("_doc"))
        return parsed.select(*keep, F.posexplode(spec.items(F.col("_doc"))).alias("pos", "rec"))
    if spec.kind == "variant":
        docs = raw.select(*keep, F.try_parse_json(F.col(payload)).alias("_doc"))
        return docs.select(*keep, F.posexplode(F.try_variant_get("_doc", spec.path, "array<variant>")).alias("pos", "rec"))
    if spec.kind == "script":
        # every JSON block of the page, then the ones that carry the wanted list
        blocks = F.regexp_extract_all(F.col(payload), F.lit(spec.pattern), 1)
        if spec.escaped:  # the block is itself a JSON string literal
            blocks = F.transform(blocks, lambda b: F.from_json(
                F.concat(F.lit('{"v":"'), b, F.lit('"}')), "v string")["v"])
        docs = F.transform(blocks, lambda b: F.from_json(b, spec.schema, {"mode": "PERMISSIVE"}))
        ok = spec.script_key or (lambda d: F.size(spec.items(d)) > 0)
        first = F.get(F.filter(docs, lambda d: d.isNotNull() & F.coalesce(ok(d), F.lit(False))), F.lit(0))
        return raw.select(*keep, first.alias("_doc")).select(*keep, F.posexplode(spec.items(F.col("_doc"))).alias("pos", "rec"))
    raise ValueError(f"unknown feed kind {spec.kind}")


def normalize_feed(raw: DataFrame, spec: FeedSpec, now: Column | None = None, payload: str = "payload",
                   order: list[str] | None = None) -> DataFrame:
    """Payload rows to candidate rows.

    Columns beside the payload are kept (for example the source name).  Output
    adds ``pos, title, href, block, company`` and the fields of ``extra``.
    """
    keep = [c for c in raw.columns if c != payload]
    recs = _records(raw, spec, payload)
    rec = F.col("rec")
    if spec.is_open is not None:
        recs = recs.filter(spec.is_open(rec, now if now is not None else F.current_timestamp()))
    read = {"company": lambda r: F.lit(None).cast("string"), "href": lambda r: F.lit(None).cast("string"),
            "block": lambda r: F.lit(""), **spec.fields, **spec.extra}
    cols = [fn(rec).alias(name) for name, fn in read.items()]
    if spec.known is not None:
        cols.append(_variant_rest(rec, spec.known).alias("rest"))
    if spec.key is not None:
        cols.append(spec.key(rec).cast("string").alias("rec_key"))
    if spec.roles is not None:
        wanted = F.filter(spec.roles(rec), lambda r: matches(spec.role_name(r), spec.role_net or ".", False))
        names = F.transform(wanted, lambda r: squeeze(spec.role_name(r)))
        cols.append(names.alias("_roles"))
    out = recs.select(*keep, "pos", *cols)
    if spec.key is not None:  # first record of a number wins
        ordering = F.struct(*[F.col(c) for c in (order or [])], F.col("pos"))
        out = first_by(out, [c for c in keep if c not in (order or [])] + ["rec_key"], ordering)
    if spec.roles is not None:
        # a record none of whose roles or title is wanted is no candidate at all
        out = out.filter((F.size("_roles") > 0) | matches("title", spec.role_net or "."))
        out = out.withColumn("_role", F.explode_outer("_roles")).withColumn(
            "title", F.concat_ws(" | ", "title", "_role")).drop("_roles", "_role")
    return out.withColumn("title", squeeze("title")).filter(blank_to_null("title").isNotNull())


def feed_rejects(raw: DataFrame, spec: FeedSpec, payload: str = "payload") -> DataFrame:
    """What :func:`normalize_feed` cannot use of a ``variant`` feed: kept columns, ``pos``, ``reason``, ``rejected``.

    A document (``pos`` NULL) is ``empty``, ``broken`` (no JSON) or has ``no
    records`` (no list at ``path``; an empty list is none); a record is ``no
    object`` or has ``no title``.  ``rejected`` is its text as landed, so
    nothing is lost.  One pass without a shuffle.
    """
    if spec.kind != "variant":
        raise ValueError("only variant feeds tell broken documents from empty ones")
    keep = [c for c in raw.columns if c != payload]
    docs = raw.select(*keep, F.col(payload).alias("_text"), F.try_parse_json(F.col(payload)).alias("_doc")).withColumn(
        "_list", F.try_variant_get("_doc", spec.path, "array<variant>"))
    state = F.when(F.coalesce(F.trim("_text"), F.lit("")) == "", "empty").when(F.col("_doc").isNull(), "broken").when(F.col("_list").isNull(), "no records")

    def told(i: Column, r: Column) -> Column:
        title = blank_to_null(squeeze(spec.fields["title"](r)))
        reason = F.when(F.try_variant_get(r, "$", "map<string,variant>").isNull(), "no object").when(title.isNull(), "no title")
        return record(pos=i, reason=reason, rejected=F.to_json(r))

    whole = F.array(record(pos=F.lit(None).cast("int"), reason=state, rejected=F.col("_text")))
    each = F.transform(F.coalesce("_list", F.array().cast("array<variant>")), lambda r, i: told(i, r))
    found = F.filter(F.concat(whole, each), lambda x: x["reason"].isNotNull())
    return docs.select(*keep, F.explode(found).alias("_x")).select(*keep, "_x.pos", "_x.reason", "_x.rejected")


def reject_counts(rejects: DataFrame, source: str = "source") -> DataFrame:
    """Rejected documents and records per source and reason."""
    return rejects.groupBy(source, "reason").agg(F.count(F.lit(1)).alias("n"), F.count("pos").alias("n_records"))


def net_filter(candidates: DataFrame, net: str) -> DataFrame:
    """Wide keyword net over title and block."""
    return candidates.filter(matches(F.concat_ws(" ", "title", "block"), net, True))


def feed_counts(raw_rows: DataFrame, candidates: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source; a feed without rows is a soft warning, not a failure."""
    n = candidates.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("title") + F.length(F.coalesce("block", F.lit("")))).alias("_chars"))
    out = raw_rows.select(source).distinct().join(n, source, "left")
    empty = F.coalesce("n_rows", F.lit(0)) == 0
    return out.select(
        source, F.coalesce("n_rows", F.lit(0)).cast("long").alias("anchors"),
        F.when(empty, F.lit(0)).otherwise(F.col("_chars") + 1000).cast("long").alias("text_len"),
        F.lit(True).alias("ok"), F.when(empty, "empty feed").alias("error"))


def translate(code: Column, labels: dict[str, str]) -> Column:
    """Code to label, unknown codes as they are."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code.cast("string")), code.cast("string"))


def ordered_unique(texts: Column, sep: str = ", ") -> Column:
    """Nested lists to one text, sorted and without repeats."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != ""))), sep)


def stable_first(texts: Column, first_pattern: str, sep: str = ", ") -> Column:
    """Sorted unique texts with the matching ones in front."""
    keyed = F.transform(F.array_distinct(texts), lambda x: record(late=~matches(x, first_pattern), x=x))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), sep)


def attach_kinds(main: DataFrame, tagged: dict[str, DataFrame], key: str, out: str = "kinds", sep: str = "/") -> DataFrame:
    """Join of the main list with lists filtered by kind."""
    union = None
    for label, part in tagged.items():
        one = part.select(key).withColumn("_kind", F.lit(label))
        union = one if union is None else union.unionByName(one)
    flags = union.groupBy(key).agg(*[
        F.max(F.when(F.col("_kind") == label, F.lit(label))).alias(f"_k{i}") for i, label in enumerate(tagged)])
    shown = F.concat_ws(sep, *[f"_k{i}" for i in range(len(tagged))])
    return main.join(flags.select(key, shown.alias(out)), key, "left")


def attach_details(listing: DataFrame, details: DataFrame, key: str, text: str = "detail") -> DataFrame:
    """Detail sections appended to the block of a listing."""
    found = listing.join(details.select(key, text), key, "left")
    return found.withColumn("block", F.concat_ws("\n", blank_to_null("block"), blank_to_null(text))).drop(text)


def keyword_union(parts: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Union of keyword sweeps, first sweep wins per (link, title)."""
    keys = keys or ["href", "title"]
    union = None
    for i, part in enumerate(parts):
        one = part.withColumn("_sweep", F.lit(i))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    order = F.struct("_sweep", "pos") if "pos" in union.columns else F.struct("_sweep")
    return first_by(union, keys, order).drop("_sweep")


def reconcile(declared: DataFrame, rows: DataFrame, key: str, total: str) -> DataFrame:
    """Feeds whose declared total differs from the rows read."""
    read = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        declared.select(key, F.col(total).cast("long").alias("declared")).join(read, key, "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
        .filter(F.col("declared").isNotNull() & (F.col("declared") != F.col("n_rows")))
    )


# Ready-made readers for the common shapes ----------------------------------

def card_field(pattern: str) -> Read:
    return lambda rec: strip_tags(F.regexp_extract(rec, f"(?s){pattern}", 1))


def cards_feed(name: str, card: str, number: str, title: str, href_prefix: str = "", company: str | None = None,
               block: list[str] | None = None) -> FeedSpec:
    """Result cards of a landed page."""
    def block_of(rec: Column) -> Column:
        return F.concat_ws(" · ", *[blank_to_null(card_field(p)(rec)) for p in block or []])

    fields: dict[str, Read] = {
        "title": card_field(title),
        "href": lambda rec: F.concat(F.lit(href_prefix), F.regexp_extract(rec, number, 1)),
        "block": block_of,
    }
    if company:
        fields["company"] = card_field(company)
    return FeedSpec(name, "cards", fields, pattern=f"(?s){card}", key=lambda rec: F.regexp_extract(rec, number, 1))
