"""Merkle manifest of a dataset, its runs pivoted into slot columns.

Leaves are hashes of framed columns.  Inside a group every run of ``fanout``
nodes in a row becomes one row with a column per slot (conditional aggregates);
the columns concatenated give the parent, the columns without the own slot give
a node's siblings.  The subroots of the groups are the leaves of one more tree.
Proofs go down from the root: a row of slots meets its parent's proof and hands
each child that proof with its own siblings before it.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<before: string, after: string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the concatenated parts; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value, so that neighbours cannot be told apart differently."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


@dataclass(frozen=True)
class Climb:
    """Levels of a forest of trees: rows of slots per level, from the leaves up, and the top node of every tree."""

    runs: list[DataFrame]
    tops: DataFrame
    fanout: int


def climb(nodes: DataFrame, tallest: int, fanout: int, extra: tuple[str, ...] = ()) -> Climb:
    """Trees over nodes (group, pos, n, hash[, extra]); ``n`` is the group's number of nodes, ``tallest`` the largest of them.

    A group is done when one node of it is left; that is its row (group, hash,
    level) in ``tops``.  Each level is written, as the next one and the proofs
    both read it; its rows are a part of ``fanout`` of those below.
    """
    runs, tops, level = [], [], 0
    while True:
        tops.append(nodes.filter(F.col("n") == 1).select("group", "hash", F.lit(level).alias("level")))
        if tallest <= 1:
            break
        slot, carried = F.col("pos") % fanout, ["hash", *(extra if level == 0 else ())]
        node = F.struct(*carried)
        slots = [F.max(F.when(slot == i, node)).alias(f"s{i}") for i in range(fanout)]
        up = nodes.filter(F.col("n") > 1).groupBy("group", F.floor(F.col("pos") / fanout).alias("pos"), "n").agg(*slots)
        runs.append(cut_lineage(up))
        nodes = runs[-1].select("group", "pos", F.ceil(F.col("n") / fanout).alias("n"), digest(*[F.col(f"s{i}.hash") for i in range(fanout)]).alias("hash"))
        tallest, level = -(-tallest // fanout), level + 1
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return Climb(runs, cut_lineage(found), fanout)


def descend(forest: Climb, tops: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(group, hash, path, *columns of ``tops`` [, extra]) of every leaf; ``path`` holds (before, after) from the leaf up.

    ``tops`` has the columns of the forest's tops and ``path``, what stands above
    each top node.  A leaf that is its group's top node is not in a run and is
    not returned: the caller has it in ``tops``.
    """
    own = [c for c in tops.columns if c not in ("group", "hash", "level", "path")]
    known = None
    for level in range(len(forest.runs), 0, -1):
        ended = tops.filter(F.col("level") == level).select("group", F.lit(0).cast("long").alias("pos"), "path", *own)
        known = ended if known is None else known.unionByName(ended)
        slots = [f"s{i}" for i in range(forest.fanout)]
        children = []
        for i, s in enumerate(slots):
            before, after = (F.concat_ws("", *[F.col(f"{x}.hash") for x in part]) for part in (slots[:i], slots[i + 1:]))
            step = F.struct(before.alias("before"), after.alias("after")).cast(_STEP)
            carried = [F.col(f"{s}.{c}").alias(c) for c in ("hash", *(extra if level == 1 else ()))]
            children.append(F.when(F.col(s).isNotNull(), F.struct((F.col("pos") * forest.fanout + i).alias("pos"), *carried, step.alias("step"))))
        met = forest.runs[level - 1].join(known, ["group", "pos"])
        each = met.select("group", *own, "path", F.explode(F.array_compact(F.array(*children))).alias("_c"))
        known = each.select("group", *own, "_c.*", F.concat(F.array("_c.step"), "path").alias("_path")).drop("step")
        known = known.withColumnRenamed("_path", "path").drop(*([] if level == 1 else ["hash"]))
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that a node and its siblings, level by level, lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, fanout: int = 3,
             extra: list[Column] = ()) -> DataFrame:
    """(id, leaf, subroot, root, path[, extra]) of every row; ``path`` is the proof, an array of (before, after) from the leaf up.

    Leaves are ordered in their group by id, null first, then by leaf; equal rows
    have leaves of their own.  Groups are ordered by name, null first, by UTF-8
    bytes.  A null field is framed apart from an empty one.  Other columns are
    not read, but for ``extra``, so their names may clash.  An empty table gives
    no rows and has no root.
    """
    named = tuple(c for c in docs.select(*extra).columns) if extra else ()
    leaf = F.sha2(F.concat(*[framed(F.col(f)) for f in fields]).cast("binary"), 256)
    rows = cut_lineage(docs.select(F.col(id_col).alias("_id"), F.col(group_col).cast("string").alias("_name"), leaf.alias("hash"), *extra))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())  # of written rows: the same whenever a task runs again
    listed = numbered(rows, [F.col(c) for c in ("_name", "_id", "hash", "_tie")]).drop("_tie")
    groups = listed.groupBy("_name").agg(F.min("_row").alias("_base"), F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(numbered(groups, [F.col("_base")], "group").withColumnRenamed("_name", "_of"))
    sizes = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("tallest")).first()
    if not sizes["groups"]:
        return rows.select(F.col("_id").alias(id_col), F.col("hash").alias("leaf"), F.col("hash").alias("subroot"), F.col("hash").alias("root"),
                           F.array().cast(f"array<{_STEP}>").alias("path"), *named)
    carried = ("_id", *named)
    nodes = cut_lineage(listed.join(groups, F.col("_name").eqNullSafe(F.col("_of"))).select(
        "group", (F.col("_row") - F.col("_base")).alias("pos"), "n", "hash", *carried))
    below = climb(nodes, sizes["tallest"], fanout, carried)
    names = below.tops.select(F.lit(0).alias("group"), F.col("group").alias("pos"), F.lit(sizes["groups"]).cast("long").alias("n"), "hash", "level")
    above = climb(names, sizes["groups"], fanout, ("level",))
    root = above.tops.first()["hash"]
    none = F.array().cast(f"array<{_STEP}>")
    if above.runs:
        tops = descend(above, above.tops.withColumn("path", none), ("level",)).select(
            F.col("pos").alias("group"), "hash", "level", "path", F.col("hash").alias("subroot"))
    else:
        tops = names.select(F.col("pos").alias("group"), "hash", "level", none.alias("path"), F.col("hash").alias("subroot"))
    tops = cut_lineage(tops)
    single = nodes.filter(F.col("n") == 1).join(tops.select("group", "path", "subroot"), "group")
    out = [F.col("_id").alias(id_col), F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", *named]
    leaves = single.select(*out)
    if below.runs:
        leaves = leaves.unionByName(descend(below, tops, carried).select(*out))
    return leaves


def tamper_check(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS,
                 fanout: int = 3) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Rows whose id has an even crc32 are tampered with before their proof is
    checked: their texts lose all line feeds (a null text stays null; a text
    without one stays as it is and verifies).  A null id is never tampered with.
    For nulls, ties and empty tables see :func:`manifest`.
    """
    chosen = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = [framed(F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == text_col else F.col(f)) for f in fields]
    altered = F.when(chosen & F.contains(F.col(text_col), F.lit("\n")), F.sha2(F.concat(*changed).cast("binary"), 256))
    made = manifest(docs, id_col, group_col, fields, fanout, [altered.alias("_altered")])
    back = folded(F.coalesce("_altered", "leaf"), F.col("path"))
    return made.select(id_col, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
