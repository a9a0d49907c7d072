"""Near-duplicates by b-bit MinHash.

Texts with the same shingle set form a class.  A class has 128 minima: bands of
four make candidates, and the low bits of all of them, packed, give the
collision-corrected similarity of a pair by bit counts.  What may be similar
enough is confirmed on the full shingle sets.

A bucket is never expanded into all its pairs: its members are compared with
one pivot first, the member that shares most buckets.  What the links found so
far leave apart is compared again with a second pivot, and members of buckets that are still
apart are then compared in blocks on their packed bits, those of buckets with the
same largest part together; no link is lost.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage, cut_narrow
from .batches import text_batches, text_or_empty

MINIMA, BAND, BITS = 128, 4, 4
"""32 bands of 4: a pair of similarity 0.8 shares no bucket with a chance of (1 - 0.8**4)**32 = 5e-8."""
SLACK = 0.2
"""A pair is confirmed if its estimate reaches the similarity less this: more than five standard errors at 0.8."""
FINE, FINE_SLACK = 2048, 0.05
"""Minima of the second, longer signature that only candidates get, and its slack: more than five standard errors again."""
BLOCK = 2048
GROUP = 8 * BLOCK
"""Members up to which the buckets of one largest part are compared as one group."""
LEAST_BLOCKS, BLOCK_SHINGLES = 3, 1 << 20
"""Blocks that classes are dealt to for the confirmation: three at least, and one for every 8 MB of sets."""
MOST_IDS = 1_000_000
"""Ids of documents up to which they are broadcast to the texts."""
PART = 1 << 19
"""Bytes of a text that are hashed at a time."""

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(1, 2 ** 63, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
_FACTORS = (_rng.integers(1, 2 ** 31, FINE, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_TERMS = _rng.integers(0, 2 ** 32, FINE, np.uint64).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    forth, back = np.full(n, _STEP), np.full(n, _BACK)
    forth[0] = back[0] = 1
    return np.multiply.accumulate(forth), np.multiply.accumulate(back)


@functools.lru_cache(maxsize=1)
def _kept_table() -> tuple[np.ndarray, np.ndarray]:
    return _power_table(2 * PART)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word, the same wherever it stands; long texts go in parts, so only a word beyond a part needs a longer table."""
    words, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + PART, "right")))
        own = data[low:ends[last - 1]]
        forth, back = _kept_table() if len(own) < 2 * PART else _power_table(len(own) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[own] * forth[:len(own)], dtype=np.uint64)))
        begin, end = starts[first:last] - low, ends[first:last] - low
        words[first:last] = _mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
        first = last
    return words


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The distinct shingles of ``n`` words of each text as sorted 64-bit hashes; a shorter text is one shingle, one without words none."""
    encoded = [t.encode("utf-8").translate(_LOWER) for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[data].view(np.int8), prepend=1))
    starts, ends = edges[::2], edges[1::2]
    words = _word_hashes(data, starts, ends)
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum([len(e) + 1 for e in encoded])))).astype(np.int64)
    joined = words.copy()
    for i in range(1, min(n, len(words))):
        joined[:len(words) - i] = _mixed(joined[:len(words) - i] * np.uint64(31) + words[i:] + np.uint64(i))
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(joined[lo:hi - n + 1]))
        elif hi > lo:
            h = np.array([hi - lo], np.uint64) * np.uint64(0x5851F42D4C957F2D)
            for i in range(lo, hi):
                h = _mixed(h * np.uint64(31) + words[i:i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(hashes: np.ndarray, number: int = MINIMA) -> np.ndarray:
    """The least values of a set under each of ``number`` hash functions."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(number, 2 ** 32 - 1, np.uint32)
    step = max(1, (1 << 17) // number)
    for start in range(0, len(short), step):
        x = np.multiply.outer(_FACTORS[:number], short[start:start + step])
        x += _TERMS[:number, None]
        x ^= x >> np.uint32(15)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def digest(hashes: np.ndarray) -> int:
    """64-bit name of a shingle set; among n sets the chance that any two share one is n**2 / 2**65."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def packed(least: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of all minima in 64-bit words."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(MINIMA // BAND, dtype=np.uint64) + np.uint64(1)
    for column in least.reshape(-1, BAND).T.astype(np.uint64):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def features(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, bands, bits) of every row; the last three are null for an empty set."""
    text = text_or_empty(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_batches(batch.column(2), 1 << 19):
                sets = shingle_sets(texts, n)
                names, bands, bits = [], [], []
                for s in sets:
                    least = minima(s) if len(s) else None
                    names.append(digest(s) if len(s) else None)
                    bands.append(band_keys(least) if len(s) else None)
                    bits.append(packed(least) if len(s) else None)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "cls", "bands", "bits"])
                at += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, cls long, bands array<long>, bits array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles, fine) of the wanted classes, from the text of each one's first document; ``fine``: bits of the longer signature."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_batches(batch.column(0), 1 << 19):
                sets = [s for s in shingle_sets(texts, n) if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([packed(minima(s, FINE)) for s in sets], pa.list_(pa.int64()))], names=["cls", "shingles", "fine"])

    ids = cut_narrow(wanted.select(F.col("doc_id").alias("_id")).distinct())
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)  # of a checked size; else whole texts are shuffled to find the few that are wanted
    met = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text")
    found = met.mapInArrow(run, "cls long, shingles array<long>, fine array<long>")
    return found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the share of equal groups of bits, corrected for chance collisions."""
    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return (1 - differ / float(MINIMA) - chance) / (1 - chance)


def _pairs_with_pivot(members: DataFrame, weight: str) -> DataFrame:
    """(a, b) of every bucket's heaviest member with all others; ``members``: key, cls, n_shingles, bits, weight."""
    pivot = members.groupBy("key").agg(F.max(F.struct(F.col(weight), F.col("cls"))).alias("_p")).select("key", F.col("_p.cls").alias("a"))
    return members.select("key", F.col("cls").alias("b")).join(pivot, "key").filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(one: np.ndarray, two: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= similarity * union."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= similarity * (len(small) + len(large) - common)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Views of a column of shingle arrays."""
    values = np.asarray(column.combine_chunks().flatten(), np.int64).view(np.uint64)
    stops = np.cumsum(np.asarray(pc.list_value_length(column), np.int64))
    return [values[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= similarity * union.

    The classes of the pairs are dealt to blocks; a cell of two blocks gets its
    pairs and each set that one of them needs once, so what is shuffled grows
    with classes times blocks and not with pairs.
    """
    one = classes.select(F.col("cls").alias("a"), F.col("n_shingles").alias("_na"), F.col("bits").alias("_ba"))
    two = classes.select(F.col("cls").alias("b"), F.col("n_shingles").alias("_nb"), F.col("bits").alias("_bb"))
    size_fits = 100 * F.least("_na", "_nb") >= similarity * F.greatest("_na", "_nb")
    near = cut_narrow(pairs.join(one, "a").join(two, "b").filter(
        size_fits & (estimate(F.col("_ba"), F.col("_bb")) >= similarity / 100 - SLACK)).select("a", "b", "_na", "_nb"))
    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("_na").alias("n")), F.struct(F.col("b").alias("cls"), F.col("_nb").alias("n")))).alias("_e"))
    shingles = ends.select("_e.*").distinct().agg(F.sum("n")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-shingles // BLOCK_SHINGLES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cells = near.select("a", "b", F.least(block("a"), block("b")).alias("_i"), F.greatest(block("a"), block("b")).alias("_j"))
    ends = cells.select(F.col("_i").alias("_k"), F.col("_j").alias("_l"), F.explode(F.array("a", "b")).alias("cls")).distinct()
    needed = ends.join(sets.select("cls", "shingles"), "cls")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(right.column("cls").to_pylist(), _sets(right.column("shingles"))))
        out: tuple[list[int], list[int]] = ([], [])
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            if _similar(held[a], held[b], similarity):
                out[0].append(a)
                out[1].append(b)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    found = cells.groupBy("_i", "_j").cogroup(needed.groupBy("_k", "_l")).applyInArrow(run, "a long, b long")
    return cut_narrow(found)


def _groups_apart(left: DataFrame) -> DataFrame:
    """(group, cls, root): the members that buckets leave apart, brought together once.

    Buckets whose largest part is the same are one group, as the members of a
    group of near copies share many buckets; a group of too many members stays
    in its single buckets.  ``left``: key, cls, root.
    """
    parts = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_c"))
    main = parts.groupBy("key").agg(F.max_by("root", F.struct("_c", "root")).alias("_main"))
    met = left.join(main, "key").select("key", "_main", "cls", "root")
    sizes = met.select("_main", "cls").distinct().groupBy("_main").agg(F.count(F.lit(1)).alias("_g"))
    group = F.when(F.col("_g") <= GROUP, F.col("_main")).otherwise(F.xxhash64("key", "_main"))
    return cut_narrow(met.join(sizes, "_main").select(group.alias("group"), "cls", "root").distinct())


def _apart_in_groups(members: DataFrame, signatures: DataFrame, similarity: int) -> DataFrame:
    """Links between members of a group that have different roots; compared and confirmed block by block.

    ``members``: group, cls, root; ``signatures``: cls, n_shingles, bits, fine,
    shingles.  A class goes to the cells of its blocks, however many buckets it
    was in, and a pair that proves not similar enough never leaves its cell: a
    group of near copies has far more of those than links.
    """
    weighed = members.join(signatures.select("cls", "n_shingles"), "cls")
    size = weighed.groupBy("group").agg(F.count(F.lit(1)).alias("_m"), F.sum("n_shingles").alias("_s"))
    blocks = F.ceil(F.greatest(F.col("_m") / BLOCK, F.col("_s") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    spread = members.join(size, "group").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    narrow = spread.select("group", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "cls", "root")
    cells = narrow.join(signatures, "cls")

    def near(bits: np.ndarray, i: int, rest: np.ndarray, number: int, slack: float) -> np.ndarray:
        d = bits[rest] ^ bits[i]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        differ = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1)
        chance = 1.0 / (1 << BITS)
        return rest[(1 - differ / number - chance) / (1 - chance) >= similarity / 100 - slack]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words = {c: np.asarray(table.column(c).combine_chunks().flatten(), np.int64).reshape(len(table), -1) for c in ("bits", "fine")}
        bits, fine = words["bits"].view(np.uint64), words["fine"].view(np.uint64)
        roots, n, own = (np.asarray(table.column(c)) for c in ("root", "n_shingles", "_own"))
        sets = _sets(table.column("shingles"))
        left = np.flatnonzero(own == own[0])
        right = np.flatnonzero(own != own[0])  # empty for the members of one block among themselves
        a: list[int] = []
        b: list[int] = []
        for p, i in enumerate(left.tolist()):
            rest = right if len(right) else left[p + 1:]
            rest = rest[(roots[rest] != roots[i]) & (100 * np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i]))]
            rest = near(bits, i, rest, MINIMA, SLACK)
            if len(rest):
                rest = near(fine, i, rest, FINE, FINE_SLACK)
                linked = [j for j in rest.tolist() if _similar(sets[i], sets[j], similarity)]
                a += [i] * len(linked)
                b += linked
        names = table.column("cls")
        return pa.table({"a": names.take(pa.array(a, pa.int64())), "b": names.take(pa.array(b, pa.int64()))})

    pairs = cells.groupBy("group", "_i", "_j").applyInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row.

    Rows are linked if their sets of ``n``-word shingles have 100 * intersection
    >= ``similarity`` * union; ``component_id`` is the least id reachable over
    links, ``kept`` whether that is the row's own id.  Null texts and texts
    without words have an empty set and are linked with nothing, so they are
    kept.  Null ids are rows like others (their component is named by the least
    id that is not null; kept is false, or true if there is none); repeated rows
    get equal results.  ``text_key`` is Spark's xxhash64 of the text.  Other columns are not read.
    """
    rows = cut_lineage(features(docs, n, id_col, text_col))
    # rows of a class are alike in all that is taken first
    named = cut_narrow(rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    buckets = named.select("cls", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    members = cut_narrow(buckets.join(shared, "key"))
    weights = members.groupBy("cls").agg(F.sum(F.col("_m") - 1).alias("weight"))
    classes = cut_narrow(named.join(weights, "cls").select("cls", F.col("rep").alias("doc_id"), "n_shingles", "bits", "bands", "weight"))
    sets = cut_lineage(sets_of(docs, classes, n, id_col, text_col))

    weighed = cut_narrow(members.join(classes.select("cls", "weight"), "cls"))
    links = _confirmed(_pairs_with_pivot(weighed, "weight"), classes, sets, similarity)
    for last in (False, True):
        roots = connected_components(links, "a", "b").withColumnRenamed("node", "cls")
        rooted = weighed.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        open_keys = rooted.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.max("_m").alias("_n")).filter("_lo <> _hi AND _n > 2")
        left = cut_narrow(rooted.join(open_keys.select("key"), "key").select("key", "cls", "root", "weight"))
        if left.isEmpty():
            break
        if last:
            signatures = classes.select("cls", "n_shingles", "bits").join(sets, "cls")
            more = _apart_in_groups(_groups_apart(left), signatures, similarity)
        else:  # heaviest member outside the largest part of the bucket
            parts = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_c"))
            main = parts.groupBy("key").agg(F.max_by("root", F.struct("_c", "root")).alias("_main"))
            second = left.join(main, "key").filter("root <> _main").groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("_p"))
            second = second.select("key", F.col("_p.cls").alias("a"))
            met = left.select("key", F.col("cls").alias("b"), F.col("root").alias("_rb")).join(second, "key")
            own = left.select("key", F.col("cls").alias("a"), F.col("root").alias("_ra"))
            pairs = met.join(own, ["key", "a"]).filter("_ra <> _rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            more = _confirmed(pairs, classes, sets, similarity)
        links = cut_narrow(links.unionByName(more).distinct())
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "cls")
    found = named.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = found.select("cls", "root").join(least, "root").select(F.col("cls").alias("_cls"), "component_id")
    out = rows.select("doc_id", "text_key", "n_shingles", "cls").join(of_class, F.col("cls") == F.col("_cls"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
