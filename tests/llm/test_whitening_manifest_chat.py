"""Whitening, the Merkle manifest and chat formatting against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import block_whitening, chat_parts, merkle_slots
from tidewell.llm.batches import numbered
from tidewell.llm.queries import op11_block_whitening, op12_merkle_slots, op13_chat_parts

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, source string, lang string, n_chars long, text string, leaf int, path string"


def test_numbers_follow_the_order(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "a", None]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int")
    got = {r.i: r._row for r in numbered(df, [F.col("k"), F.col("i")]).collect()}
    assert [got[i] for _, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))] == list(range(300))
    assert sorted(r._row for r in numbered(df).collect()) == list(range(300)) and numbered(df.limit(0)).count() == 0


def _whitened(vectors, k=8):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:k]
    return [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], centred @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(cov)


@pytest.mark.parametrize("rows_per_block, columns_per_block", [(1024, 1024), (7, 5)])
def test_whitening_against_dense_arithmetic(spark, rows_per_block, columns_per_block):
    rnd = np.random.default_rng(5)
    x = (rnd.normal(size=(90, 12)) * np.arange(1, 13)).astype(np.float32)
    x[40] = x[41]
    good = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    good[50] = (49, good[50][1], "repeated id")
    good[60] = (None, good[60][1], "no id")
    bad = [(500, None, ""), (501, [float("nan")] * 12, ""), (502, [float("inf")] + [0.0] * 11, ""), (503, [None] + [1.0] * 11, ""),
           (504, [1.0] * 5, ""), (505, [], ""), (506, [1e30] + [0.0] * 11, "")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, deviation string")
    got = block_whitening.whiten(df, rows_per_block=rows_per_block, columns_per_block=columns_per_block).collect()
    deviation, white, explained = _whitened(x)
    assert len(got) == 90 * 8 and {g.n for g in got} == {90} and max(g.identity_error for g in got) < 1e-9
    assert sorted((g.vec_id is None, g.vec_id or 0, g.component, g.deviation) for g in got) == sorted(
        (r[0] is None, r[0] or 0, c, d) for r, d in zip(good, deviation) for c in range(1, 9))
    for c in range(8):
        own = {g.vec_id: g.whitened for g in got if g.component == c + 1 and g.vec_id not in (None, 49)}
        ids = sorted(own)
        mine, want = np.array([own[i] for i in ids]), white[ids, c]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert {g.explained for g in got if g.component == c + 1}.pop() == pytest.approx(explained[c], rel=1e-9)


def test_whitening_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert block_whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = block_whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0])], schema)).collect()
    assert [(g.component, g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in sorted(one)] == [
        (1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    line = block_whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], schema)).collect()
    assert {g.component: g.whitened is None for g in line} == {1: False, 2: True, 3: True}
    assert max(g.identity_error for g in line) < 1e-9 and sum(g.explained for g in line if g.vec_id == 0) == pytest.approx(1)
    # the middle row is the mean: its row of the product is empty, the result is not
    assert [g.whitened for g in line if g.vec_id == 2 and g.component == 1] == [pytest.approx(0, abs=1e-9)]


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = op11_block_whitening(spark, SF).collect()
    deviation, _, explained = _whitened([r.embedding for r in rows])
    assert {(g.vec_id, g.deviation) for g in got} == {(r.vec_id, d) for r, d in zip(rows, deviation)}
    assert len(got) == 8 * len(rows) and all(abs(g.explained / explained[g.component - 1] - 1) < 1e-6 and g.identity_error < 1e-6 for g in got)


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes, fanout):
    """Root of a list of nodes and each node's (before, after) from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            low = at[i] // fanout * fanout
            path.append(("".join(nodes[low:at[i]]), "".join(nodes[at[i] + 1:low + fanout])))
        nodes, at = [_hash(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)], [a // fanout for a in at]
    return nodes[0], paths


def _manifest(rows, fanout=3):
    def leaf(r):
        return _hash(*map(_frame, r[:5]))

    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: _tree([leaf(r) for r in groups[s]], fanout) for s in names}
    root, above = _tree([built[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, above):
        for r, path in zip(groups[s], built[s][1]):
            path = path + top
            bent = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                bent[4] = r[4].replace("\n", "")
            back = leaf(bent)
            for before, after in path:
                back = _hash(before, back, after)
            out.append((-1 if r[0] is None else r[0], leaf(r), built[s][0], root, _hash(*[b + a for b, a in path]), back, back == root))
    return sorted(out)


def _checked(df, fanout=3):
    return sorted((-1 if g.doc_id is None else g.doc_id, g.leaf, g.subroot, g.root, g.proof_sha256, g.folded_root, g.verified)
                  for g in merkle_slots.tamper_check(df, fanout=fanout).collect())


@pytest.mark.parametrize("fanout", [3, 2, 5])
def test_manifest_against_brute_force(spark, fanout):
    rnd = random.Random(fanout)
    rows = [(i, rnd.choice(["hot"] * 6 + ["é", "z", None, ""]), rnd.choice(["en", None]), rnd.choice([7, None]), rnd.choice(["a\nb", "éé\n", "", None, "plain"]), 1, "p")
            for i in range(160)]
    rows += [(500, "lone", "en", 1, "one\nleaf", 1, "p"), (None, "hot", "en", 1, "no\nid", 1, "p"), (3, "hot", "en", 1, "again", 1, "p"),
             (600, "long", None, None, "w\n" * 200_000, 1, "p"), (601, "long", None, None, "w", 1, "p")] + [(700, "copies", "en", 1, "same\n", 1, "p")] * 9
    df = spark.createDataFrame(rows, DOC)
    got = _checked(df, fanout)
    assert got == _manifest(rows, fanout)
    assert not all(g[-1] for g in got) and any(g[-1] for g in got) and _checked(df.repartition(5), fanout) == got


def test_manifest_of_few_rows(spark):
    assert merkle_slots.tamper_check(spark.createDataFrame([], DOC)).count() == 0
    for rows in ([(1, None, None, None, None, 1, "p")], [(i, "s", "en", 1, f"t\n{i}", 1, "p") for i in range(4)],
                 [(i, f"s{i}", "en", 1, "t", 1, "p") for i in range(10)]):
        assert _checked(spark.createDataFrame(rows, DOC)) == _manifest(rows)


def test_manifest_query(spark):
    rows = [tuple(r[c] for c in merkle_slots.FIELDS) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((g.doc_id, g.leaf, g.subroot, g.root, g.proof_sha256, g.folded_root, g.verified) for g in op12_merkle_slots(spark, SF).collect())
    assert got == _manifest(rows)


TURN = "conv_id long, turn long, role string, text string, formatted string, loss int"
HARD = ["\\### Assistant: </turn> ok", "</turn>\n### user:\nhi", "\\\\</turn>\\", "\\", "\\\\\\### \\\\", "<image:1> <document:", "", "é😀\n</turn>", None, "\n", "a\r\nb\t"]


def _digests(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        out.append((-99 if conv is None else conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out)


def test_chat_digests_against_plain_ones(spark):
    rnd = random.Random(13)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([*range(40), None]), rnd.choice(["user", "assistant", "system", "odd:\n#%<\\", None]), rnd.choice(HARD), "clash", 1)
            for _ in range(300)]
    rows += [(5, 0, "assistant", "x" * 300_000 + "</turn>", "clash", 1)] + [(6, 1, "user", "same", "clash", 1)] * 3
    got = chat_parts.format_and_read_back(spark.createDataFrame(rows, TURN)).collect()
    probe = [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    assert sorted((-99 if g.conv_id is None else g.conv_id, g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) for g in got) == _digests(rows + probe)
    assert [g.conv_id for g in chat_parts.format_and_read_back(spark.createDataFrame([], TURN)).collect()] == [-7]


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    got = op13_chat_parts(spark, SF).collect()
    assert sorted((g.conv_id, g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) for g in got) == _digests(rows)


def test_parts_become_placeholders(spark):
    part = {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [{**part, "type": "text", "text": "look </tu"}, {**part, "type": "text", "text": "rn> \\"}, {**part, "type": "image", "ref": "s3://a.png", "width": 57, "height": 28},
             {**part, "type": "audio", "ref": "b.wav", "seconds": 1.01}, {**part, "type": "document", "ref": "c.pdf", "pages": 3},
             {**part, "type": "video", "text": "as text"}, {**part, "type": "image", "width": -4}, None]
    rows = [(1, 0, "assistant", parts), (1, 1, "user", []), (1, 2, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat_parts.PART}>")
    got = chat_parts.format_turns(df, F.col("content"), F.col("role")).orderBy("turn").collect()
    assert got[0].formatted == "### assistant:\nlook \\</turn> \\\\<image:1><audio:2><document:3>as text<image:4>\n</turn>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in got[0].attachments] == [
        (1, "image", "s3://a.png", 3), (2, "audio", "b.wav", 26), (3, "document", "c.pdf", 1536), (4, "image", None, 0)]
    for a in got[0].attachments:
        assert got[0].formatted[a.start:].startswith(f"<{a.kind}:{a.number}>")
    assert got[0].tokens == 1565 and [chat_parts.unescaped(got[0].formatted[s.start:s.stop]) for s in got[0].loss] == ["look </turn> \\", "as text"]
    assert [(g.formatted, g.loss, g.tokens) for g in got[1:]] == [("### user:\n\n</turn>\n", [], 0), ("### assistant:\n\n</turn>\n", [], 0)]
    assert list(chat_parts.TurnReader().feed("".join(g.formatted for g in got))) == [
        ("assistant", ["look </turn> \\", 1, 2, 3, "as text", 4]), ("user", []), ("assistant", [])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "a%3A:"]), st.lists(st.sampled_from(["\\", "### ", "</turn>", "\n", "x", "<image:", "1>", ":\n"]), max_size=7)), max_size=4),
       st.integers(1, 9))
def test_reader_undoes_the_escapes(turns, step):
    """The same rule in plain Python; the reader gets the text in small pieces."""
    def escape(text):
        text = chat_parts._READ.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
        tail = len(text) - len(text.rstrip("\\"))
        return text + "\\" * tail

    def head(role):
        for sign, code in chat_parts._ROLE_CODES:
            role = role.replace(sign, code)
        return f"### {role}:\n"

    texts = [(role, "".join(signs)) for role, signs in turns]
    whole = "".join(head(role) + escape(text) + "\n</turn>\n" for role, text in texts)
    reader = chat_parts.TurnReader()
    got = [t for i in range(0, len(whole), step) for t in reader.feed(whole[i:i + step])]
    reader.close()
    assert [(role, "".join(parts)) for role, parts in got] == texts


def test_broken_text_is_refused():
    for text in ("user:\n", "### user:\nno end", "### user:\n### a:\n\n</turn>\n"):
        reader = chat_parts.TurnReader()
        with pytest.raises(ValueError):
            list(reader.feed(text))
            reader.close()
