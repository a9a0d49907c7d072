"""Page text, languages and toxicity: brute-force versions and held-out accuracy."""

import html
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import language_id, tag_paths, toxic_segments
from tidewell.llm.batches import text_batches
from tidewell.llm.queries import op4_tag_paths, op6_language_id, op10_toxic_segments

SF = "/root/testdata/sf0.01"


def _article(page):
    body = page.split("<article>", 1)[1].split("</article>", 1)[0]
    body = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", body)).split())


def test_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op4_tag_paths(spark, SF).collect()
    assert len(got) == len(pages) and all(g.text == _article(pages[g.page_id]) and g.n_chars == len(g.text) for g in got)


def test_other_markup():
    sentence = "Water rises in the lock, and the boat goes up with it. "
    page = ("<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><ul class='main-menu'><li>Home</li></ul>"
            "<div id=content><h2>Locks &amp; boats</h2><p>" + sentence * 3 + "</p><p>Short<b>ened</b> line&nbsp;here.</p>"
            "<div class='share-bar'>Share this</div><form><p>Your mail</p></form><p>" + sentence * 2 + "<script>var a='<p>x</p>'</script></p></div>"
            "<aside><p>See also, the canal. It is long, and old.</p></aside><section class=comments><p>" + sentence * 4 + "</p></section>"
            "<footer>Legal</footer></body></html>")
    assert tag_paths.main_text(page) == f"Locks & boats {(sentence * 3).strip()} Shortened line here. {(sentence * 2).strip()}"
    assert [tag_paths.main_text(x) for x in ("", "<p>", "plain &lt;text&gt;", "<div><!-- <p>no</p>")] == ["", "", "plain <text>", ""]
    assert len(tag_paths.main_text("<article>" + "<p>a b</p>" * 20_000 + "</article>")) == 4 * 20_000 - 1


def test_marked_wrappers_and_headers():
    sentence = "Water rises in the lock, and the boat goes up with it. "
    menu, end = "<nav><ul><li><a href=x>Home</a></li></ul></nav>", "<div class=sidebar><p>Weather and tides.</p></div><footer>Legal</footer>"
    body = f"<h1>Locks and boats</h1><p>{sentence * 3}</p><p>A <b>short</b> line.</p><p>{sentence * 2}</p>"
    text = f"Locks and boats {(sentence * 3).strip()} A short line. {(sentence * 2).strip()}"
    for wrapper in ("div class='has-sidebar'", "div class='page no-sidebar'", "div class='post share-enabled'", "div class='newsletter-layout'", "form", "div class=widget"):
        close = f"</{wrapper.split()[0]}>"
        assert tag_paths.main_text(f"<body><{wrapper}>{menu}<div>{body}</div>{end}{close}</body>") == text, wrapper
        assert tag_paths.main_text(f"<body>{menu}<{wrapper}>{body}{close}{end}</body>") == text, wrapper
    headed = body.replace("<h1>", "<div class='article-header'><h1>").replace("</h1>", "</h1></div>")
    assert tag_paths.main_text(f"<body>{menu}<article>{headed}</article>{end}</body>") == text
    assert tag_paths.main_text(f"<body><div class=ad>{sentence * 9}</div><article><p>Short.</p></article></body>") == "Short."


def test_split_articles_and_headlines_outside_the_body():
    sentence = "Water rises in the lock, and the boat goes up with it. "
    menu, end = "<nav><ul><li><a href=x>Home</a></li></ul></nav>", "<footer>Legal</footer>"

    def part(n):
        return f"<p>{sentence * n}</p><p>{sentence * n}</p>"

    def text(n):
        return " ".join([(sentence * n).strip()] * 2)

    page = f"<body>{menu}<div id=content><h1>Headline</h1><div class=body>{part(4)}</div><div class=part2>A short end.</div></div>{end}</body>"
    assert tag_paths.main_text(page) == f"Headline {text(4)} A short end."
    assert tag_paths.main_text(f"<body>{menu}<h1>Headline</h1><div>{part(9)}</div>{end}</body>") == f"Headline {text(9)}"
    assert tag_paths.main_text(f"<body>{menu}<main><article>{part(4)}</article><section>{part(3)}</section></main>{end}</body>") == f"{text(4)} {text(3)}"
    assert tag_paths.main_text(f"<body>{menu}<article>{part(4)}</article><article>{part(3)}</article>{end}</body>") == f"{text(4)} {text(3)}"


def test_page_edge_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>hello</p>", "x"), (1, "u", None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((g.page_id or 0, g.text, g.n_chars) for g in tag_paths.extract_pages(pages).collect()) == [(0, "hello", 5), (1, "", 0), (1, "", 0)]
    assert tag_paths.extract_pages(pages.limit(0)).count() == 0


def test_languages_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [g for g in op6_language_id(spark, SF).collect() if g.held_out]
    assert len(held) > 100 and np.mean([langs[g.doc_id] == g.lang_pred for g in held]) > 0.97
    assert all(0 <= g.score <= 1 for g in held)


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * k + i, " ".join([letters[k % 26] * 2 + letters[k // 26] + letters[k % 7]] * (3 + i % 3)), f"l{k:02d}") for k in range(70) for i in range(12 if k < 66 else 6)]
    rows += [(10_000 + i, "123", f"l{i % 3 + 67}") for i in range(3_000)]  # rows without a letter take no place of usable ones
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert sorted(lang for family in model.families for lang in family) == [f"l{k:02d}" for k in range(70)]
    few = [r for r in rows if r[2] >= "l64" and r[0] < 10_000]
    assert np.mean([got == r[2] for got, r in zip(model.predict([r[1] for r in few])[0], few)]) > 0.9


def test_language_edge_rows(spark):
    rows = [(i, t, lang, 1) for i in range(60) for t, lang in ((f"der hund und die katze {i}", "de"), (f"the dog and the cat {i}", "en"), (f"le chien et la chatte {i}", "fr"))]
    rows += [(900, None, "de", 1), (901, "123 !!", "en", 1), (None, "the cat and the dog", "en", 1), (902, "the dog and", None, 1), (903, "the dog " * 50_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {g.doc_id: g for g in language_id.identify(docs).filter("doc_id is null or doc_id >= 900").collect()}
    assert {k: v.lang_pred for k, v in got.items()} == {900: "und", 901: "und", None: "en", 902: "en", 903: "en"}
    assert got[900].score == 0 and got[None].held_out is False
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.select("lang_pred").distinct().collect()} == {"und"}
    assert language_id.learn_families({"a": np.array([1.0, 0]), "b": np.array([1, 0.1]), "c": np.array([0, 1.0])}, 2) == [["a", "b"], ["c"]]


def _best_run(scores):
    """Maximal segments by definition: the best run, then the same left and right of it."""
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best[0] + 1e-12 or abs(s - best[0]) <= 1e-12 and best[0] > 0 and j - i < best[2] - best[1]:
                best = (s, i, j)
    if best[0] <= 1e-12:
        return []
    s, i, j = best
    return _best_run(scores[:i]) + [(i, j, s)] + [(a + j, b + j, c) for a, b, c in _best_run(scores[j:])]


def test_segments_by_definition():
    rnd = random.Random(5)
    for _ in range(150):
        scores = [rnd.choice([-3.25, -1.5, -0.75, 1.0, 2.5, 4.125]) + rnd.random() / 97 for _ in range(rnd.randint(0, 14))]
        got, want = toxic_segments.segments(np.array(scores)), _best_run(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([s for *_, s in got], [s for *_, s in want])
    assert toxic_segments.segments(np.zeros(0)) == []


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [g for g in op10_toxic_segments(spark, "/root/testdata/sf0.1").collect() if g.held_out and g.doc_id in labels]
    toxic = [g.predicted for g in held if labels[g.doc_id] == 1]
    clean = [g.predicted for g in held if labels[g.doc_id] == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02


def test_toxicity_edge_rows(spark):
    rows = [(i, ("you zorb fool here" if i % 4 == 0 else "a calm plain note") + f" number {i}", 3) for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None, 3), (901, "", 3), (None, "zorb zorb", 3), (902, "word " * 50_000 + "zorb fool", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (900, None), (0, 0)], "doc_id long, toxic int")
    got = {g.doc_id: g for g in toxic_segments.score_toxicity(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400)) and got[None].predicted == 1
    assert got[900].score == got[901].score == min(g.score for g in got.values()) and got[902].score >= got[901].score
    model = toxic_segments.fit(docs, labels)
    spans = toxic_segments.toxic_passages(docs.filter("doc_id = 4"), model).first().passages
    assert spans and spans[0].first_word <= 1 < spans[0].stop_word
    assert toxic_segments.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in toxic_segments.score_toxicity(docs, labels.limit(0)).select("score").distinct().collect()} == {toxic_segments.ToxicModel({}).score(0)}


def test_signs_beyond_ascii_part_words():
    words = ["dreck", "für", "señor", "का", "vieil"]
    plain = [w.encode() for w in words]
    for text in ("¡Dreck! für «señor» — का “vieil”", "¿Dreck? für\u00a0señor\u2014का…‘vieil’", "dre\u00adck für\u3000señor\u200bका\u2009·vieil\u2019"):
        assert toxic_segments.words_of(text) == plain
    model = toxic_segments.ToxicModel({"dreck": (3.0, 9.0)})
    assert model.token_scores(toxic_segments.words_of("«¡Dreck!»\u00a0ist"), {}).tolist() == model.token_scores([b"dreck", b"ist"], {}).tolist()


def test_broken_pages_take_linear_time():
    size = 1_000_000
    pages = {"<p ": "<p " * (size // 3), "<a": "<a href=\"" * (size // 9), "quotes": "<a '\"<b \"'" * (size // 11), "deep": "<div>x" * (size // 6),
             "marks": "<div class=ad>x" * (size // 15), "inline": "<b class=ad>x" * (size // 13), "articles": "<article><nav>x." * (size // 16),
             "ends": "<b><div>" + "<span>" * (size // 10) + "</b>x" * (size // 10), "bang": "<! " * (size // 3), "raw": "</style " * (size // 8) + "<style>"}
    for name, page in pages.items():
        began = time.process_time()
        tag_paths.main_text(page)
        assert time.process_time() - began < 20, name
    assert tag_paths.main_text("<p>a &#" + "9" * 6000 + "; b &#0000065;") == "a \ufffd b A"


def test_path_scores_by_a_plain_count():
    page = "<div><p>One, two. Three!</p><p>Four.</p><ul><li><a href=x>Five</a> six</li></ul><p>Seven, eight.</p></div><p>Nine</p>"
    blocks, elements = tag_paths.blocks_of(page)

    def path(e):
        return () if e < 0 else (*path(elements.frames[e]), elements.tags[e])

    assert [path(b.element) for b in blocks] == [("div", "p"), ("div", "p"), ("div", "ul", "li"), ("div", "p"), ("p",)]
    raw = []
    for b in blocks:
        alike = [o for o in blocks if path(o.element) == path(b.element)]
        text = sum(len(o.text) - o.linked for o in alike) / len(alike)
        stops = sum(sum(o.text.count(c) for c in ".,!") for o in alike) / len(alike)
        raw.append((text * (1 + stops)) ** 0.5)
    plain = []
    for i in range(len(raw)):
        near = [(math.exp(-d * d / 2), raw[min(max(i + d, 0), len(raw) - 1)]) for d in range(-3, 4)]
        plain.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    assert tag_paths.fused_scores(blocks) == pytest.approx(plain)


def test_language_features_by_a_plain_count():
    texts = ["Ein Satz!", "", "äö 12", "a", "Une phrase, ici", "a"]
    got = language_id.features(texts)
    for text, row in zip(texts, got):
        data = b" " + b" ".join(text.lower().encode().translate(language_id._PLAIN).split()) + b" "
        counts = [0] * language_id.SLOTS
        padded = data + b"  "
        for i in range(len(data)):
            for a, b, c in language_id._WEIGHTS:
                mixed = padded[i] * a ^ ((padded[i + 1] + 1) * b if b else 0) ^ ((padded[i + 2] + 1) * c if c else 0)
                mixed &= 0xFFFFFFFF
                mixed = (mixed ^ mixed >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                counts[mixed >> 21] += 1
        total = sum(counts)
        plain = [(n / total) ** 0.5 if len(data) > 2 else 0.0 for n in counts]
        assert row == pytest.approx(plain), text
    assert language_id.features(texts[3:4])[0] == pytest.approx(got[5])  # neighbours in a batch do not matter
    assert [len(b) for b in text_batches(pa.array(["a b"] * 1200), 1 << 19, language_id.BATCH_ROWS)] == [512, 512, 176]


def test_toxic_model_by_plain_counts(spark):
    rnd = random.Random(6)
    plain = ["river", "stone", "garden", "window", "paper", "bright", "table", "morning"]
    rows = []
    for i in range(400):
        words = rnd.choices(plain, k=rnd.randint(0, 40))
        if i % 4 == 0:
            words[3:3] = rnd.choices(["vilest", "scumbag", "vileness"], k=6)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id int, toxic int")
    model = toxic_segments.fit(docs, labels)
    used = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    held = {0: {}, 1: {}}
    for text, y in used:
        for w in set(text.split()):
            held[y][w] = held[y].get(w, 0) + 1
    total = {y: sum(held[y].values()) for y in held}
    assert {"vilest", "scumbag", "vileness"} <= set(model.terms)
    for term, (odds, z) in model.terms.items():
        inside = [w for w in {**held[0], **held[1]} if (w == term if not term.endswith("*") else w.startswith(term[:-1]) and len(w) >= len(term))]
        n = {y: sum(held[y].get(w, 0) for w in inside) for y in held}
        prior, every = 0.02 * (n[0] + n[1]), 0.02 * (total[0] + total[1])
        side = {y: math.log((n[y] + prior) / max(total[y] + every - n[y] - prior, 1)) for y in held}
        assert odds == pytest.approx(min(max(side[1] - side[0], -6), 8)), term
        assert z == pytest.approx((side[1] - side[0]) / math.sqrt(1 / (n[1] + prior) + 1 / (n[0] + prior)))
    scores = {}
    for text, y in used:
        scores.setdefault(y, []).append(model.token_scores(toxic_segments.words_of(text), {}))
    tokens = [round(float(s), 2) for text in scores[0] for s in text] + [8 - model.drift, -model.drift]
    assert sum(math.exp(model.decay * s) for s in tokens) / len(tokens) == pytest.approx(1, abs=1e-6)
    tops = [(len(s), max((x for _, _, x in toxic_segments.segments(s)), default=0.0)) for s in scores[0] if len(s)]
    assert model.constant == pytest.approx(len(tops) / sum(n * math.exp(-model.decay * x) for n, x in tops))
    found = [(model.evidence([x for _, _, x in toxic_segments.segments(s)], len(s)), y) for y in (0, 1) for s in scores[y]]
    assert min(model.score(e) for e, y in found if y) > 0.5 > max(model.score(e) for e, y in found if not y)
