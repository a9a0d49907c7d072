"""Token ids, counts, files and packing against the tokenizers library and exhaustive search."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bin_completion, range_coder, token_counts
from tidewell.llm import pieces as pieces_module
from tidewell.llm.pieces import PieceEncoder, encoder, tokenizer_path

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokenizer_path(NAME))


def _odd_texts(n):
    rnd = random.Random(4)
    parts = ["a", "Be", "é", " ", "  ", "\n", "\t", " \n", "'s", "don't", "12", "３", " ", " ", "<|endoftext|>", "你好", "🙂", "...", "_", "\x85", "\0", "<|"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)] + ["", " ", "w " * 50_000]


def _docs(spark):
    rows = [(3, "one two  three\n\n four"), (1, None), (2, ""), (2, "same id"), (None, "no id"), (7, "long " * 5000), (8, "x\ty"), (8, "x\ty")]
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, n_tokens string, sequence_id int")


def test_pieces_equal_the_library(library):
    texts = _odd_texts(3000)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    small = PieceEncoder(tokenizer_path(NAME), table_bytes=100)  # tables overflow again and again
    got = [x for i in range(0, len(texts), 200) for x in small.encode(texts[i:i + 200])]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert encoder(tokenizer_path(NAME), True).encode(texts) == [len(w) for w in want]


def test_words_of_letters_are_looked_up_once(library):
    """Only parts of words go through the table of parts; a word of letters that a batch has made serves it too."""
    texts = ["alpha beta gamma, x1 delta. éta", "beta, Zeta beta", "theta\niota (kappa) beta"]
    engine, seen = PieceEncoder(tokenizer_path(NAME)), set()
    own = engine._of_pieces
    engine._of_pieces = lambda pieces, *rest: seen.update(pieces) or own(pieces, *rest)
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in engine.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert {" gamma", " delta", " beta", ",", " x"} <= seen and not {" éta", " Zeta", "alpha"} & seen


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    counts = encoder(tokenizer_path(name), True).encode(["Hello world", "", "a b"])
    assert counts[1] == 0 and counts[0] >= 2 and [len(x) // 4 for x in encoder(tokenizer_path(name)).encode(["Hello world", "", "a b"])] == counts


def test_counts(spark, library):
    docs = _docs(spark)
    got = token_counts.count_tokens(docs, limit=4).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(((g.doc_id or -1, g.n_bytes, g.n_tokens) for g in got)) == sorted((d or -1, b, n) for d, b, n in want)
    assert all(g.over_limit == (g.n_tokens > 4) for g in got)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_coder_round_trip_and_damage():
    rnd = np.random.default_rng(0)
    blocks = [np.zeros(0, int), np.array([5]), np.full(3000, 50256), rnd.integers(0, 50257, 2000), np.arange(2500) % 7] + [
        rnd.zipf(1.3, rnd.integers(0, 3000)) % 50257 for _ in range(12)]
    codes = range_coder.encode_blocks(blocks, 50257)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, range_coder.decode_blocks(codes, [len(b) for b in blocks], 50257)))
    assert range_coder.encode_blocks(blocks[3:4], 50257)[0] == codes[3]  # a block does not depend on its neighbours
    assert len(codes[2]) < 60
    block = range_coder.pack_block(blocks[4], codes[4], [(9, False, 0, 2500)])
    ids, table = range_coder.unpack_blocks([block], 50257)[0]
    assert (ids == blocks[4]).all() and table.tolist() == [[9, 0, 0, 2500]]
    for at in (0, 8, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError):
            range_coder.unpack_blocks([block[:at] + bytes([block[at] ^ 1]) + block[at + 1:]], 50257)


def test_pieces_are_merged_in_groups(library, monkeypatch):
    """op5, op2: pieces of a group are parted by a token of their own, so nothing merges over their ends."""
    engine = PieceEncoder(tokenizer_path(NAME))
    pieces = [" onbleinges", "Onshon", "es", "On", "'s", ".", "..", "À", " À", "ÀÀ", "é", " a", "12"] * 11
    want = [np.array(engine._model.encode_batch_fast([[p.encode("utf-8").decode("latin-1").translate(pieces_module._LETTERS)]], is_pretokenized=True,
                                                     add_special_tokens=False)[0].ids, "<u4").tobytes() for p in pieces]
    assert engine._between is not None
    for together in (1, 2, 64, 1000):
        monkeypatch.setattr(pieces_module, "_TOGETHER", together)
        assert engine._made(pieces) == want
    engine._between = None
    assert engine._made(pieces) == want


def test_token_files(spark, library, monkeypatch):
    docs = _docs(spark)
    got = range_coder.token_files(docs).collect()
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "")):
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((-1 if r.doc_id is None else r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.start, g.n_tokens, g.ids_crc32) for g in got) == sorted(want)
    assert range_coder.token_files(docs.limit(0)).count() == 0


def test_documents_over_several_blocks(spark, library, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (40 * i)) for i in range(30)], "doc_id long, text string")
    path = str(tmp_path / "files")
    range_coder.write_token_files(docs, path, block_ids=64)
    got = {r.doc_id: r for r in range_coder.read_token_files(spark, path, with_ids=True).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids + [0]
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == ids and got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def _fewest(sizes, capacity):
    best = len(sizes)
    bins = []

    def place(i):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += sizes[i]
                place(i + 1)
                bins[b] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1)
        bins.pop()

    place(0)
    return best


def test_packing_against_exhaustive_search():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = sorted((rnd.randint(1, 100) for _ in range(rnd.randint(1, 9))), reverse=True)
        bins = bin_completion.pack(np.array(sizes), 100)
        assert np.bincount(bins, sizes).max() <= 100 and len(set(bins)) == _fewest(sizes, 100)
    many = np.array([rnd.randint(1, 2048) for _ in range(5000)])
    bins = bin_completion.pack(many, 2048)
    assert np.bincount(bins, many).max() <= 2048 and len(set(bins)) <= 1.01 * -(-many.sum() // 2048) + 1
    assert len(bin_completion.pack(np.zeros(0, int), 10)) == 0 and set(bin_completion.pack(np.full(9, 30), 100)) == {0, 1, 2}


def test_packed_documents(spark, library):
    docs = _docs(spark).unionByName(_docs(spark))  # repeated rows
    got = bin_completion.pack_documents(docs, capacity=64, group_pieces=8).collect()
    sequences = {}
    for g in got:
        sequences.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = []
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(r.doc_id or -1, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((g.doc_id or -1, g.piece, g.start, g.length, g.ids_crc32) for g in got) == sorted(want)
    assert bin_completion.pack_documents(docs.limit(0)).count() == 0


def test_sequences_of_many_short_pieces():
    sizes = np.array([1, 2, 2, 2, 2, 3, 3, 3, 4, 5, 7, 7, 8, 8, 10, 11, 11, 17, 20, 22, 32])  # best fit needs four
    bins = bin_completion.pack(sizes, 60)
    assert len(set(bins.tolist())) == 3 and np.bincount(bins, sizes).tolist() == [60, 60, 60]
    counts = np.bincount([9] * 6 + [7] * 3 + [6] * 9 + [5])
    ways = bin_completion.fillings(counts, 54, 100_000)
    assert sum(sum(w) == 54 for w in ways) > 1 and (9,) * 6 in ways and (6,) * 9 in ways
    want = {tuple(sorted(c, reverse=True)) for c in ((9,) * a + (7,) * b + (6,) * c + (5,) * d for a in range(7) for b in range(4) for c in range(10) for d in range(2))
            if 49 < sum(c) <= 54 or 49 == sum(c) and 5 in c}
    assert set(ways) == {w for w in want if all(54 - sum(w) < x or w.count(x) == counts[x] for x in (9, 7, 6, 5))}
    assert bin_completion.dominated((3, 2, 2), (5, 2)) and not bin_completion.dominated((4, 3), (5, 2))


def test_tables_stay_bounded():
    engine = PieceEncoder(tokenizer_path(NAME), table_bytes=200_000)
    for i in range(0, 30_000, 500):
        engine.encode([" ".join(f"word{j}, x{j}y" for j in range(i, i + 500))])
        assert all(len(t.young) + len(t.old) < 6_000 for t in (engine._words, engine._pieces))
    assert engine._words.old


def test_least_bins_is_a_bound():
    def fewest(sizes, capacity):
        best = len(sizes)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                    place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1:]])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return best

    tight = 0
    for seed in range(150):
        rnd = np.random.default_rng(seed)
        capacity = int(rnd.integers(5, 25))
        sizes = sorted(rnd.integers(1, capacity + 1, 8).tolist(), reverse=True)
        bound, best = bin_completion.least_bins(np.bincount(sizes, minlength=capacity + 1), capacity), fewest(sizes, capacity)
        assert bound <= best
        tight += bound == best
    assert tight > 120
    assert bin_completion.least_bins(np.bincount([300] * 60, minlength=2049), 2048) == 10
