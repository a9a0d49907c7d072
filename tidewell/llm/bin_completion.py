"""Packing documents into sequences by bin completion with branch and bound.

Pieces are dealt to groups of bounded size; a group is packed by filling the
sequence of its largest remaining piece: fillings are enumerated, the least
wasteful first, dominated ones are passed over, and the search turns back where the waste so far
exceeds what a better solution than the incumbent could afford.  The first
incumbent is best-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import text_batches, text_or_empty
from .pieces import encoder, tokenizer_path

FULL_GROUP = -1


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on numbers of pieces per length: [(lengths in a bin, bins like that)].

    Pieces of one length are placed together: as many as fit go into the open
    bins with the least room left that still holds them.
    """
    rooms: dict[int, list[list]] = {}  # room left -> [[lengths, bins]]
    done: list[tuple[tuple[int, ...], int]] = []
    present = 0  # bit r: a bin with room r is open
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fitting = present >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                entry = rooms[room][-1]
                n = min(left, entry[1])
                entry[1] -= n
                if not entry[1]:
                    rooms[room].pop()
                    if not rooms[room]:
                        present &= ~(1 << room)
                lengths, rest = (*entry[0], length), room - length
            else:
                each = min(capacity // length, left)
                n, lengths, rest = left // each, (length,) * each, capacity - length * each
            if rest:
                rooms.setdefault(rest, []).append([lengths, n])
                present |= 1 << rest
            else:
                done.append((lengths, n))
            left -= n * (1 if fitting else each)
    return done + [(tuple(e[0]), e[1]) for entries in rooms.values() for e in entries]


def dominated(way: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of ``way`` fit together into the places of the pieces of ``other``."""
    if way == other or sum(way) > sum(other) or (way and way[0] > max(other, default=0)):
        return False
    seen: set[tuple[int, tuple[int, ...]]] = set()

    def place(i: int, rooms: tuple[int, ...]) -> bool:
        if i == len(way):
            return True
        if (i, rooms) in seen or len(seen) > 200:  # unproven counts as not dominated: nothing is lost
            return False
        seen.add((i, rooms))
        return any(place(i + 1, tuple(sorted((*rooms[:j], r - way[i], *rooms[j + 1:]))))
                   for j, r in enumerate(rooms) if r >= way[i] and r not in rooms[:j])

    return place(0, tuple(sorted(other)))


def fillings(counts: np.ndarray, room: int, tries: int, first: bool = False) -> list[tuple[int, ...]]:
    """Ways to fill ``room`` so that no further piece fits: the perfect ones first, then by waste, fewer and longer pieces first.

    Fillings of one piece come first, then of two and so on, without a bound on
    their number; ``tries`` bounds the steps of all.  The way that takes the
    longest piece that fits each time is always among them.  With ``first`` only the
    first perfect one, if there is one.
    """
    lengths = np.flatnonzero(counts[:room + 1])[::-1].tolist()
    if not lengths:
        return [()]
    have = counts[lengths].tolist()
    least, left, longest = lengths[-1], room, []
    for size, n in zip(lengths, have):
        n = min(n, left // size)
        longest += [size] * n
        left -= n * size
    if first and not left:
        return [tuple(longest)]
    used = dict.fromkeys(lengths, 0)

    def fit(start: int, left: int) -> int:
        lo, hi = start, len(lengths)
        while lo < hi:  # first length that fits
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if lengths[mid] > left else (lo, mid)
        return lo

    found = {tuple(longest): left}  # filling -> its waste
    for most in range(1, room // least + 1):
        if tries <= 0:
            break
        taken: list[int] = []
        at, left = [fit(0, room)], room  # next length to try at each depth
        while at:
            i, more = at[-1], most - len(taken)
            # a piece of the shortest length would fit besides whatever follows from here
            hopeless = i < len(lengths) and have[-1] > most and more * lengths[i] <= left - least
            if i == len(lengths) or hopeless or tries <= 0:
                at.pop()
                if taken:
                    size = taken.pop()
                    used[size] -= 1
                    left += size
                continue
            at[-1] += 1
            tries -= 1
            size = lengths[i]
            if size > left or used[size] >= have[i]:
                continue
            if more == 1:
                rest = left - size
                way = (*taken, size)
                if first and not rest:
                    return [way]
                if way not in found and not any(used[lengths[j]] + (lengths[j] == size) < have[j] for j in range(fit(0, rest), len(lengths))):
                    found[way] = rest
                continue
            used[size] += 1
            taken.append(size)
            left -= size
            at.append(fit(i, left))
    return sorted(found, key=found.get)


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the larger of two published bounds.

    L2 of Martello and Toth (1990): for a threshold k, pieces over capacity - k
    take a bin each that nothing of length k or more joins; pieces over half a
    bin take one each too, and what of the pieces from k to half a bin does not
    fit into their rooms needs more.  And the dual feasible functions of Fekete
    and Schepers (2001), which round lengths to parts of a bin: where all pieces
    are just over a seventh of it, for one, six of them fill a bin.
    """
    sizes = np.arange(capacity + 1)
    number, length = np.cumsum(counts), np.cumsum(counts * sizes)
    half, k = capacity // 2, np.arange(1, capacity // 2 + 1)
    alone = number[capacity] - number[capacity - k]
    large = number[capacity - k] - number[half]
    room = large * capacity - (length[capacity - k] - length[half])
    small = length[half] - length[k - 1]
    needed = alone + large + np.maximum(0, -(-(small - room) // capacity))
    best = max(int(needed.max(initial=0)), -(-int(length[capacity]) // capacity))
    for parts in range(2, 41):
        whole, rest = np.divmod(parts * sizes, capacity)
        rounded = np.where(rest == 0, (parts - 1) * sizes, whole * capacity)
        best = max(best, -(-int((counts * rounded).sum()) // ((parts - 1) * capacity)))
    return best


def pack(lengths: np.ndarray, capacity: int, tries: int = 400, turns: int = 2000) -> np.ndarray:
    """Number of the bin of each piece (each of 0 to ``capacity``).

    ``tries`` bounds the steps of the enumeration of fillings for one bin, ``turns`` how often the search may
    turn back; then the incumbent stands.  Pieces of length 0 join the first bin.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    counts[0] = 0
    total = int((counts * np.arange(capacity + 1)).sum())
    incumbent = best_fit(counts, capacity)
    best = sum(n for _, n in incumbent)
    floor = least_bins(counts, capacity)
    left, waste = counts.copy(), 0
    path: list[tuple[int, tuple[int, ...], int, list[tuple[int, ...]] | None, int, list]] = []  # largest piece, filling, bins, other fillings, waste, fillings tried
    options: list[tuple[int, ...]] | None = None
    tried: list[tuple[int, ...]] = []
    top = capacity
    while best > floor:
        while top and not left[top]:
            top -= 1
        if not top:  # all placed, within the waste allowed: a better solution
            incumbent = [((p[0], *p[1]), p[2]) for p in path]
            best = sum(p[2] for p in path)
            options = []
        elif options is None:
            left[top] -= 1
            options, tried = fillings(left, capacity - top, tries, first=True), []
            left[top] += 1
        allowed = (best - 1) * capacity - total  # a better solution wastes no more than this
        if options:
            way, lost = options[0], capacity - top - sum(options[0])
            alike = min([left[top], *(left[s] // way.count(s) for s in set(way))]) if top not in way else 1
            n = int(alike) if lost == 0 or not way else 1  # a perfect filling, or none at all, serves all bins alike
            if waste + n * lost <= allowed:
                left[top] -= n
                for s in way:
                    left[s] -= n
                waste += n * lost
                path.append((top, way, n, options[1:] if lost or len(options) > 1 else None, n * lost, [*tried, way]))
                options = None
                continue
        turns -= 1
        if not turns or not path:
            break
        top, way, n, options, lost, tried = path.pop()
        left[top] += n
        for s in way:
            left[s] += n
        waste -= lost
        if options is None:  # the other fillings besides the perfect one that was taken first
            left[top] -= 1
            options = [other for other in fillings(left, capacity - top, tries) if other != way]
            left[top] += 1
        while options and any(dominated(options[0], other) for other in tried):
            options = options[1:]
    order = np.argsort(-lengths, kind="stable")
    first_of = np.zeros(capacity + 2, np.int64)  # where each length's pieces begin in that order
    first_of[:-1] = len(lengths) - np.cumsum(np.bincount(lengths, minlength=capacity + 1))
    bins = np.zeros(len(lengths), np.int64)
    number = 0
    for sizes, n in incumbent:
        for s in sizes:
            bins[order[first_of[s]:first_of[s] + n]] = np.arange(number, number + n)
            first_of[s] += n
        number += n
    return bins


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, salt long"


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json",
               capacity: int = 2048, end_id: int = 0, keep_words: bool = True) -> DataFrame:
    """Pieces of every document's ids: only longer ones are cut, and the first piece is the shorter one.

    Without ``keep_words`` a worker gives its tables of words up after each task;
    that costs time and leaves its memory to other work.

    ``salt`` numbers the pieces a task makes; with the task's number it is the same in every attempt.
    """
    rows = docs.select(F.col(id_col).cast("long"), text_or_empty(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(tokenizer_path(tokenizer))
        tail = np.array([end_id], "<u4").tobytes()
        salt = TaskContext.get().partitionId() << 36
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            out: list[tuple] = []
            for texts in text_batches(batch.column(1)):
                for data in engine.encode(texts):
                    data, name = data + tail, next(names)
                    n = len(data) // 4
                    stops = list(range(n, 0, -capacity))[::-1]
                    for piece, (lo, hi) in enumerate(zip([0, *stops[:-1]], stops)):
                        out.append((name, piece, lo, hi - lo, zlib.crc32(data[4 * lo:4 * hi]), salt))
                        salt += 1
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
        if not keep_words:
            engine.forget()

    return rows.mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json",
                   capacity: int = 2048, group_pieces: int = 40_000, keep_words: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    Pieces that fill a sequence are one of their own.  The others are dealt at random to
    groups of about ``group_pieces``, one task each; so however many documents
    share an id or a length, no task grows, and each group loses at most its
    last, partly filled sequence.  A null or empty text is the end id alone;
    null and repeated ids are rows like others; other columns are not read.
    """
    pieces = cut_lineage(cut_pieces(docs, id_col, text_col, tokenizer, capacity, keep_words=keep_words))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.filter(F.col("length") == capacity).select(
        *columns, (F.lit(1 << 62) + F.col("salt")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))

    def run(table: pa.Table) -> pa.Table:
        lengths = np.asarray(table.column("length"), np.int64)
        bins = pack(lengths, capacity)
        order = np.lexsort((np.asarray(table.column("salt")), bins))
        sizes = lengths[order]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
        offset = np.zeros(len(bins), np.int64)
        offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        group = int(table.column("_group")[0].as_py())
        return pa.table({**{c: table.column(c) for c in columns}, "sequence_id": pa.array((group << 32) + bins, pa.int64()),
                         "offset": pa.array(offset, pa.int64())})

    dealt = short.withColumn("_group", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(
        run, "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(whole).withColumn("length", F.col("length").cast("long"))
