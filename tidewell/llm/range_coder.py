"""Token ids as binary blocks: an adaptive context-mixing range coder.

A block starts from an empty model, so blocks can be read alone, and ends with a
checksum.  Three predictions are mixed for every id:

* order 2: the id last seen after the two ids before, order 1: after the one id
  before.  Each slot has a confidence; the pair of confidences selects adaptive
  probabilities that order 2, else order 1, is right;
* order 0: adaptive frequencies over the whole vocabulary on top of a prior that
  favours low ids (merges are numbered by frequency), renewed at fixed numbers of ids.

The mixture divides the coder's range: a share for the order-2 id, one for the
order-1 id, and the rest split by order 0.  Blocks are coded side by side: one
numpy step codes the next id of each of up to ``LANES`` blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .batches import shuffle_count, text_batches, text_or_empty
from .pieces import encoder, tokenizer_path

MAGIC = b"TWB1"
HEADER = struct.Struct("<4sIIIII")
"""Magic, ids, documents, bytes of the packed document table, 16-bit words of code, crc32 of all that follows and the ids' own."""

BLOCK_IDS = 1 << 14
"""Ids in a block; a document that reaches over the end is continued in the next block."""
LANES = 512
_RENEWED = {64, 256, 1024, 2048, 4096, 8192}
"""Numbers of ids after which order 0 is renewed; beyond the last one at every multiple of it."""
_SLOTS1, _SLOTS2 = 11, 12
_ONE = 1 << 12
_ALL = 1 << 20
_U = np.uint64


class _Model:
    """Predictions of a group of blocks ("lanes"); used in the same way by both directions."""

    def __init__(self, lanes: int, vocabulary: int):
        self.vocabulary, self.bits = vocabulary, max(1, (vocabulary - 1).bit_length())
        self.lane = np.arange(lanes, dtype=np.int64)
        kind = np.uint16 if vocabulary <= 1 << 16 else np.int32
        self.id2, self.sure2 = np.zeros(lanes << _SLOTS2, kind), np.zeros(lanes << _SLOTS2, np.uint8)
        self.id1, self.sure1 = np.zeros(lanes << _SLOTS1, kind), np.zeros(lanes << _SLOTS1, np.uint8)
        self.hit2 = np.full(lanes * 16, _ONE // 8, np.int32)
        self.hit1 = np.full(lanes * 16, _ONE // 8, np.int32)
        self.before1 = np.zeros(lanes, np.int64)
        self.before2 = np.zeros(lanes, np.int64)
        prior = 1.0 / (np.arange(vocabulary) + 200.0)
        self.prior = prior / prior.sum()
        self.renew(np.zeros((0, lanes), np.int64), 0)

    def renew(self, ids: np.ndarray, active: int) -> None:
        """Order 0 from the ids coded so far (one row per step).

        Every id has 1 + its share of the prior, the same in all lanes; ids that
        a lane has seen have more.  So there is one table of limits for all
        lanes, and a short sorted list of seen ids for each.
        """
        coded, free = len(ids), _ALL - self.vocabulary
        rule = np.floor(self.prior * (free * 1024 // (1024 + coded))).astype(np.int64) + 1
        self.rule = np.concatenate(([0], np.cumsum(rule)))
        left = _ALL - int(self.rule[-1])
        keys = np.sort((ids[:, :active] + (self.lane[:active] << self.bits)).reshape(-1))
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        end = np.array([1 << 62])
        self.key = np.concatenate([keys[first], end])
        self.more = np.append(np.diff(first, append=len(keys)) * left // max(coded, 1), 0)
        total = np.cumsum(self.more) - self.more
        opens = np.searchsorted(self.key, self.lane << self.bits)
        self.less = total - np.append(total[opens[(self.key[:-1] >> self.bits)]], 0)  # what seen ids before this one in its lane have
        lane_of = self.key >> self.bits
        self.begin = np.concatenate([(lane_of[:-1] << 21) + self.rule[self.key[:-1] & (1 << self.bits) - 1] + self.less[:-1], end])

    def limits(self, lane: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where an id's share of order 0 begins, and its size."""
        wanted = (lane << self.bits) + ids
        place = np.searchsorted(self.key, wanted)
        hit = self.key[place] == wanted
        last = np.maximum(place - 1, 0)
        behind = np.where((self.key[last] >> self.bits == lane) & (place > 0), self.less[last] + self.more[last], 0)
        low = self.rule[ids]
        return low + behind, self.rule[ids + 1] - low + np.where(hit, self.more[place], 0)

    def find(self, lane: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose share of order 0 holds ``target``, with where the share begins and its size."""
        last = np.searchsorted(self.begin, (lane << 21) + target, side="right") - 1
        at = np.maximum(last, 0)
        own = (last >= 0) & (self.key[at] >> self.bits == lane)
        seen = self.key[at] & (1 << self.bits) - 1
        before, more = np.where(own, self.less[at], 0), np.where(own, self.more[at], 0)
        plain = np.searchsorted(self.rule, target - before - more, side="right") - 1
        ids = np.where(own, np.maximum(plain, seen), np.minimum(plain, self.vocabulary - 1))
        same, low = own & (ids == seen), self.rule[ids]
        return ids, low + before + np.where(same, 0, more), self.rule[ids + 1] - low + np.where(same, more, 0)

    def predict(self, k: int) -> None:
        b1, b2, lane = self.before1[:k], self.before2[:k], self.lane[:k]
        mixed = b1 * 0x9E3779B1
        self.at1 = (lane << _SLOTS1) + ((mixed & 0xFFFFFFFF) >> (32 - _SLOTS1))
        self.at2 = (lane << _SLOTS2) + ((mixed + b2 * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - _SLOTS2))
        self.guess2, self.guess1 = self.id2[self.at2], self.id1[self.at1]
        self.c2, self.c1 = self.sure2[self.at2], self.sure1[self.at1]
        self.state = (lane << 4) + (self.c2 << 2) + self.c1
        self.share2 = self.hit2[self.state]
        self.p1 = self.hit1[self.state]
        self.share1 = np.maximum((_ONE - self.share2) * self.p1 >> 12, 1)

    def learn(self, k: int, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        """``right1`` counts only where order 2 was wrong; probabilities stay off 0 and 1."""
        self.hit2[self.state] = self.share2 + (np.where(right2, 4032, 64) - self.share2 >> 4)
        self.hit1[self.state] = np.where(right2, self.p1, self.p1 + (np.where(right1, 4032, 64) - self.p1 >> 4))
        same1 = ids == self.guess1
        self.sure2[self.at2] = np.where(right2, np.minimum(self.c2 + 1, 3), self.c2 >> 1)
        self.sure1[self.at1] = np.where(same1, np.minimum(self.c1 + 1, 3), self.c1 >> 1)
        self.id2[self.at2] = np.where(self.c2 < 2, ids, self.guess2)
        self.id1[self.at1] = np.where(self.c1 < 2, ids, self.guess1)
        self.before2[:k] = self.before1[:k]
        self.before1[:k] = ids


def _renews(step: int) -> bool:
    return step in _RENEWED or step > 0 and step % 8192 == 0


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest block first, and how many blocks still have an id at each step."""
    order = np.argsort(-lengths, kind="stable")
    steps = np.arange(int(lengths.max(initial=0)))
    return order, np.searchsorted(-lengths[order], -steps, side="left")


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Code of each block of ids (each below ``vocabulary``)."""
    out: list[bytes] = []
    for start in range(0, len(blocks), LANES):
        out += _encode_lanes(blocks[start:start + LANES], vocabulary)
    return out


def _encode_lanes(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks], np.int64)
    order, active = _order(lengths)
    n, longest = len(blocks), int(lengths.max(initial=0))
    ids = np.zeros((longest, n), np.int64)
    for lane, b in enumerate(order):
        ids[:lengths[b], lane] = blocks[b]
    model = _Model(n, vocabulary)
    low, size = np.zeros(n, _U), np.full(n, 2 ** 64 - 1, _U)
    words = np.zeros((n, 2 * longest + 6), np.uint32)  # a digit may hold a carry until the end
    at = np.zeros(n, np.int64)
    for t in range(longest):
        k = int(active[t])
        if _renews(t):
            model.renew(ids[:t], k)
        x = ids[t, :k]
        model.predict(k)
        right2 = x == model.guess2
        right1 = ~right2 & (x == model.guess1)
        rest = ~(right2 | right1)
        unit = size[:k] >> _U(12)
        start = np.where(right2, 0, np.where(right1, model.share2, model.share2 + model.share1))
        share = np.where(right2, model.share2, np.where(right1, model.share1, _ONE - model.share2 - model.share1))
        old = low[:k].copy()
        step = unit * start.astype(_U)
        span = unit * share.astype(_U)
        other = np.flatnonzero(rest)
        lo, wide = model.limits(other, x[other])
        fine = span[other] >> _U(20)
        step[other] += fine * lo.astype(_U)
        span[other] = fine * wide.astype(_U)
        new = old + step
        carry = np.flatnonzero(new < old)
        if carry.size:
            words[carry, at[carry] - 1] += 1
        low[:k], size[:k] = new, span
        full = np.flatnonzero(span < _U(1 << 48))
        while full.size:
            words[full, at[full]] = (low[full] >> _U(48)).astype(np.uint32)
            at[full] += 1
            low[full] <<= _U(16)
            size[full] <<= _U(16)
            full = full[size[full] < _U(1 << 48)]
        model.learn(k, x, right2, right1)
    for _ in range(4):
        words[np.arange(n), at] = (low >> _U(48)).astype(np.uint32)
        at += 1
        low <<= _U(16)
    while True:  # settle the carries
        over = words >> 16
        if not over.any():
            break
        words &= 0xFFFF
        words[:, :-1] += over[:, 1:]
    coded = [b""] * n
    for lane, b in enumerate(order):
        coded[b] = words[lane, :at[lane]].astype("<u2").tobytes()
    return coded


def decode_blocks(coded: list[bytes], lengths: list[int], vocabulary: int) -> list[np.ndarray]:
    """Ids of each block from its code and its number of ids."""
    out: list[np.ndarray] = []
    for start in range(0, len(coded), LANES):
        out += _decode_lanes(coded[start:start + LANES], lengths[start:start + LANES], vocabulary)
    return out


def _decode_lanes(coded: list[bytes], lengths: list[int], vocabulary: int) -> list[np.ndarray]:
    sizes = np.array(lengths, np.int64)
    order, active = _order(sizes)
    n, longest = len(coded), int(sizes.max(initial=0))
    words = np.zeros((n, max(len(c) for c in coded) // 2 + 4), _U)
    for lane, b in enumerate(order):
        code = np.frombuffer(coded[b], "<u2")
        words[lane, :len(code)] = code
    ids = np.zeros((longest, n), np.int64)
    model = _Model(n, vocabulary)
    size = np.full(n, 2 ** 64 - 1, _U)
    value = np.zeros(n, _U)  # code minus the encoder's low end
    for i in range(4):
        value = value << _U(16) | words[:, i]
    at = np.full(n, 4, np.int64)
    for t in range(longest):
        k = int(active[t])
        if _renews(t):
            model.renew(ids[:t], k)
        model.predict(k)
        unit = size[:k] >> _U(12)
        first = unit * model.share2.astype(_U)
        second = first + unit * model.share1.astype(_U)
        v = value[:k]
        right2 = v < first
        right1 = ~right2 & (v < second)
        x = np.where(right2, model.guess2, model.guess1).astype(np.int64)
        span = np.where(right2, first, second - first)
        less = np.where(right2, _U(0), first)
        other = np.flatnonzero(v >= second)
        rest = unit[other] * (_ONE - model.share2[other] - model.share1[other]).astype(_U)
        fine = rest >> _U(20)
        tail = v[other] - second[other]
        x[other], lo, wide = model.find(other, np.minimum(tail // fine, _U(_ALL - 1)).astype(np.int64))
        less[other] = second[other] + fine * lo.astype(_U)
        span[other] = fine * wide.astype(_U)
        value[:k], size[:k] = v - less, span
        full = np.flatnonzero(span < _U(1 << 48))
        while full.size:
            value[full] = value[full] << _U(16) | words[full, at[full]]
            at[full] += 1
            size[full] <<= _U(16)
            full = full[size[full] < _U(1 << 48)]
        model.learn(k, x, right2, right1)
        ids[t, :k] = x
    out = [np.zeros(0, np.int64)] * n
    for lane, b in enumerate(order):
        out[b] = ids[:sizes[b], lane].copy()
    return out


NULL_ID, GOES_ON = 1, 2


def pack_block(ids: np.ndarray, code: bytes, entries: list[tuple[int | None, bool, int, int]]) -> bytes:
    """Header, document table, code.

    An entry is a document's id, whether it goes on in the next block, how many
    of its ids earlier blocks hold, and how many this one holds.
    """
    table = np.array([(d or 0, NULL_ID * (d is None) + GOES_ON * on, done, n) for d, on, done, n in entries], "<i8").reshape(-1, 4)
    packed = zlib.compress(table.T.tobytes(), 6)
    check = zlib.crc32(ids.astype("<u4").tobytes(), zlib.crc32(packed + code))
    return HEADER.pack(MAGIC, len(ids), len(entries), len(packed), len(code) // 2, check) + packed + code


def unpack_blocks(blocks: list[bytes], vocabulary: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, document table) of each block; raises ValueError for a damaged one."""
    heads, tables, codes = [], [], []
    for block in blocks:
        magic, n, docs, packed, words, _ = head = HEADER.unpack_from(block)
        if magic != MAGIC or len(block) != HEADER.size + packed + 2 * words:
            raise ValueError("not a block of token ids")
        body = block[HEADER.size:]
        heads.append((head, zlib.crc32(body)))
        try:
            tables.append(np.frombuffer(zlib.decompress(body[:packed]), "<i8").reshape(4, docs).T)
        except (zlib.error, ValueError) as e:
            raise ValueError("damaged document table") from e
        codes.append(body[packed:])
    found = decode_blocks(codes, [h[0][1] for h in heads], vocabulary) if blocks else []
    for (head, body_crc), ids in zip(heads, found):
        if zlib.crc32(ids.astype("<u4").tobytes(), body_crc) != head[5]:
            raise ValueError("block fails its checksum")
    return list(zip(found, tables))


_FILE = pa.schema([("bucket", pa.int32()), ("block_no", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())])
_PART = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("entry", pa.int64()), ("done", pa.int64()),
                   ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
FILE_SCHEMA = "bucket int, block_no long, first_id long, n_ids long, block binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts and write them as blocks in ascending order of the ids.

    ``bucket`` is the range of ids a file belongs to, ``block_no`` the place in
    it, ``first_id`` the ids of the bucket before the block.  Spark's own
    committer writes the files, so a lost task leaves nothing behind.  A null
    text is empty (only the end id); null ids come first; rows with equal ids
    are ordered by text.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dealt = rows.repartitionByRange(shuffle_count(docs), "doc_id", "text").sortWithinPartitions("doc_id", "text")

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(tokenizer_path(tokenizer))
        bucket = TaskContext.get().partitionId()
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        waiting: list[tuple[np.ndarray, list]] = []
        ids: list[np.ndarray] = []
        entries: list[tuple] = []
        filled = block_no = first = 0

        def close() -> None:
            nonlocal ids, entries, filled
            if entries:
                waiting.append((np.concatenate(ids), entries))
            ids, entries, filled = [], [], 0

        def coded() -> pa.RecordBatch:
            nonlocal block_no, first
            rows = []
            for (values, docs_in), code in zip(waiting, encode_blocks([w[0] for w in waiting], engine.vocabulary)):
                rows.append((bucket, block_no, first, len(values), pack_block(values, code, docs_in)))
                block_no, first = block_no + 1, first + len(values)
            waiting.clear()
            return _batch(rows, _FILE)

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in text_batches(batch.column(1)):
                for data in engine.encode(texts):
                    values, name, done = np.frombuffer(data + tail, "<u4"), next(names), 0
                    while True:
                        take = min(len(values), block_ids - filled)
                        ids.append(values[:take])
                        values = values[take:]
                        entries.append((name, len(values) > 0, done, take))
                        filled, done = filled + take, done + take
                        if filled >= block_ids:
                            close()
                        if not len(values):
                            break
                if len(waiting) >= LANES:
                    yield coded()
        close()
        if waiting:
            yield coded()

    dealt.mapInArrow(blocks_of, FILE_SCHEMA).write.mode("errorifexists").option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """Documents decoded from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids as binary.

    ``start`` counts the ids of all documents before; a document that is spread
    over several blocks is put together again.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # one row per written partition

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(tokenizer_path(tokenizer)).vocabulary
        waiting: list[tuple] = []

        def decoded() -> pa.RecordBatch:
            rows = []
            for (bucket, block_no, first, _, _), (ids, table) in zip(waiting, unpack_blocks([w[4] for w in waiting], vocabulary)):
                data, lo = ids.astype("<u4").tobytes(), 0
                for place, (doc, flags, done, n) in enumerate(table.tolist()):
                    piece, whole = data[4 * lo:4 * (lo + n)], not done and not flags & GOES_ON
                    rows.append((bucket, None if flags & NULL_ID else doc, first + lo - done, (block_no << 20) + place if whole else -1,
                                 done, n, zlib.crc32(piece) if whole else None, piece if with_ids or not whole else None))
                    lo += n
            waiting.clear()
            return _batch(rows, _PART)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append(row)
                if len(waiting) >= LANES:
                    yield decoded()
        if waiting:
            yield decoded()

    parts = files.mapInArrow(parts_of, "bucket int, doc_id long, begin long, entry long, done long, n long, crc long, ids binary")
    # a whole document is a group of its own; the parts of a spread one share the place where it begins
    together = parts.groupBy("bucket", "doc_id", "begin", "entry").agg(
        F.sum("n").alias("n_tokens"), F.max("crc").alias("crc"),
        F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("done", "ids")))).alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    out = together.join(offsets, "bucket").select(
        "doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens",
        F.coalesce("crc", F.crc32(ids)).alias("ids_crc32"), *([ids.alias("ids")] if with_ids else []))
    return out


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write a table's token files to the shared folder and read them back (see the two functions above)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, id_col, text_col, tokenizer)
    return read_token_files(spark, path, tokenizer)
