"""Mixing, near-duplicates and the pipeline against brute-force versions."""

import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import bbit_minhash, mixing
from tidewell.llm.batches import by_bytes, running_sum

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_running_sum_in_any_order(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rnd.randint(0, 9)) for i in range(500)]
    got = running_sum(spark.createDataFrame(rows, "k string, i int, v long"), [F.col("k"), F.col("i")], ["v"]).collect()
    total = 0
    want = {}
    for k, i, v in sorted(rows):
        want[i] = total
        total += v
    assert {g.i: g.v_before for g in got} == want
    assert [(s.start, s.stop) for s in by_bytes([5, 1, 9, 2, 2], 6)] == [(0, 2), (2, 3), (3, 5)] and list(by_bytes([], 3)) == []


def _mixed(rows, weights=(3, 1, 2), share=1.5):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, *_) in enumerate(rows)}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[3] == s) for s in sources}
    w = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    left = share * sum(total.values())
    while open_:  # share by weight, cut what is above, share the rest again
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if w[s] * level >= 2 * total[s]}
        if not above:
            target.update({s: w[s] * level for s in open_})
            break
        for s in above:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= above
    out = []
    for s in sources:
        own = [i for i, r in enumerate(rows) if r[3] == s]

        def key(i):
            digits = int(hashlib.md5(f"mix:{'null' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:12], 16)
            q = 1 / (1 + abs(len(rows[i][1] or "") / max(size[i], 1) - 6))
            return -math.log((digits + 0.5) / 2 ** 48) / max(q, 1e-6)

        epochs = int(target[s] // total[s]) if total[s] else 0
        budget, at = target[s] - epochs * total[s], 0
        for i in sorted(own, key=lambda i: (key(i), rows[i][0] or -1, size[i])):
            out.append((rows[i][0] or -1, size[i], total[s], round(target[s], 6), size[i] * min(2, epochs + (at + size[i] / 2 < budget))))
            at += size[i]
    return sorted(out)


def test_mix_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["a", "bcdef", "ghijklmno"]) for _ in range(rnd.randint(0, 30))), "en", rnd.choice(["s1", "s2", "s3", "hot", "hot", "hot", None]), 0)
            for i in range(300)]
    rows += [(400, None, "en", "s1", 0), (401, "", "en", "empty", 0), (None, "x y", "en", "s2", 0), (5, "again five", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, DOC).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mixing.mix(docs).collect()
    assert sorted((g.doc_id or -1, g["size"], g.source_size, round(g.target, 6), g.taken) for g in got) == _mixed(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    for s in {g.source_size for g in got}:
        of = [g for g in got if g.source_size == s]
        assert abs(sum(g.taken for g in of) - of[0].target) <= max(g["size"] for g in of) and all(g.copies <= 2 for g in of)
    assert mixing.mix(docs.limit(0)).count() == 0


def _set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def _components(rows, n):
    sets = [_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def _texts(seed):
    """Families whose members differ from each other by more than from their base, chains, copies and strangers."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 90))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
        for _ in range(10):  # a chain
            base = base[2:] + [rnd.choice(vocabulary)]
            texts.append("  ".join(base).upper())
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(50)) for _ in range(40)] + [texts[0]] * 30
    rnd.shuffle(texts)
    return texts + [None, "", " \t\n", "one", "ONE", "one two", "a b a b a b", "é é"]


def test_components_against_all_pairs(spark):
    for n, seed in ((2, 1), (5, 2)):
        rows = list(enumerate(_texts(seed)))
        got = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")), n=n).collect()
        assert sorted((g.doc_id, g.n_shingles, g.component_id, g.kept) for g in got) == sorted(_components(rows, n))


def test_pairs_left_apart_in_blocks(spark, monkeypatch):
    """Without pivots all links must come from the block comparison."""
    monkeypatch.setattr(bbit_minhash, "BLOCK", 7)
    monkeypatch.setattr(bbit_minhash, "_pairs_with_pivot", lambda members, weight: members.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0))
    rows = list(enumerate(_texts(3)))
    got = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    apart = {(g.doc_id, g.component_id) for g in got}
    pairs_of_two = [r for r in _components(rows, 2)]
    # a bucket of two is the pivot's alone; families here are larger
    assert sum((d, c) in apart for d, _, c, _ in pairs_of_two) >= 0.97 * len(rows)


def test_dedup_edge_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other words stand here now ok"), (2, "")]
    got = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    assert sorted((g.doc_id or -1, g.component_id, g.kept) for g in got) == [(-1, 4, False), (2, 2, True), (4, 4, True), (4, 4, True), (4, 4, True)]
    assert bbit_minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similarity_from_bits(spark):
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 2 ** 63, 500).astype(np.uint64)) for _ in range(2)]
    for share in (0.5, 0.8, 0.95):
        k = round(2 * 500 * share / (1 + share))
        both = np.unique(np.concatenate([sets[0][:k], sets[1][k:]]))
        rows = [(bbit_minhash.packed(bbit_minhash.minima(sets[0])).tolist(), bbit_minhash.packed(bbit_minhash.minima(both)).tolist())]
        est = spark.createDataFrame(rows, "a array<long>, b array<long>").select(bbit_minhash.estimate(F.col("a"), F.col("b"))).first()[0]
        true = len(np.intersect1d(sets[0], both)) / len(np.union1d(sets[0], both))
        assert abs(est - true) < bbit_minhash.SLACK


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(6)
    vocabulary = {"en": "the of and to in water stone house river green".split(), "de": "der die und das ist wasser stein haus fluss grün".split()}
    rows, labels = [], []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        words = [rnd.choice(vocabulary[lang]) + rnd.choice(["", "s", "en", "er"]) for _ in range(rnd.randint(20, 60))]
        toxic = i % 6 == 0
        if toxic:
            words[3:3] = ["zorbel", "zorbel"]
        rows.append((i, " ".join(words), lang, f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    near = rows[1][1].split()
    rows += [(500, rows[1][1], "en", "s1", 0), (501, rows[3][1] + " end", "en", "s2", 0), (502, None, "en", "s1", 0), (503, "123 456", "en", None, 0),
             (None, " ".join(near[::-1]), None, None, None), (7, rows[7][1], "en", "s3", 0)]
    spark.createDataFrame(rows, DOC).withColumn("copies", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.keep_languages(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in rows} - {502, 503}
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).select("doc_id").collect()
    assert {r[0] for r in clean} == {r[0] for r in rows if "zorbel" not in (r[1] or "")}
    once = [r[0] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect()]
    assert sorted(-1 if x is None else x for x in once) == sorted({-1 if r[0] is None else r[0] for r in rows} - {500, 501})
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    copies = {(r.doc_id, r["size"]): r.copies for r in mixing.mix(docs).collect()}
    times = {}
    for r in mixed.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect():
        times[r.doc_id, r.n] = times.get((r.doc_id, r.n), 0) + 1
    assert mixed.columns == docs.columns and {k: v for k, v in times.items() if k[0] not in (7, None)} == {k: v for k, v in copies.items() if v and k[0] not in (7, None)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and not {g.doc_id for g in out} & {500, 501, 502, 503} and not {g.doc_id for g in out if g.doc_id is not None and g.doc_id % 6 == 0}
    assert corpus_pipeline.run.__module__ == "corpus_pipeline" and len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    texts = ["a b c a b", "", "x " * 500, "w" * 300 + " y z", " lead é ü\n", "one"]
    whole = bbit_minhash.shingle_sets(texts, 2)
    bbit_minhash._kept_table.cache_clear()
    monkeypatch.setattr(bbit_minhash, "PART", 16)
    parts = bbit_minhash.shingle_sets(texts, 2)
    bbit_minhash._kept_table.cache_clear()
    assert [a.tolist() for a in whole] == [b.tolist() for b in parts]
