"""Toxic passages by maximum-scoring segments.

Words and their beginnings get log-odds between toxic and clean texts, with a Dirichlet
prior in proportion to their overall frequency.  A linear-time scan (Ruzzo and
Tompa) finds all maximal segments of a text's token scores.  Segment scores
follow an extreme-value law: with its decay and its constant, taken from clean
texts, a score becomes the expected number of equally good segments by chance.
A text's significant segments are added up and a logistic curve turns the sum
into a score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from ..session import cut_lineage
from .batches import fold, held_out, text_batches, text_or_empty

_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
STEMS = (3, 4, 5, 6)
"""Beginnings of so many letters count as evidence besides the whole word."""
WORDS_KEPT = 200_000


def _in_words(sign: str) -> str:
    """What a sign beyond ASCII is in a word: letters and the marks on them stay, joiners and soft hyphens vanish, all else parts words."""
    kind = unicodedata.category(sign)
    return sign if kind[0] in "LM" else "" if kind == "Cf" and sign != "\u200b" else " "


def words_of(text: str) -> list[bytes]:
    """Lower-case runs of letters, as UTF-8."""
    if not text.isascii():
        odd = {ord(c): to for c in set(text) if c > "\x7f" and (to := _in_words(c)) != c}
        text = text.translate(odd) if odd else text
    return text.lower().encode("utf-8").translate(_PLAIN).split()


def terms_of(word: bytes) -> list[str]:
    """A word and, marked as such, its beginnings."""
    letters = word.decode("utf-8", "replace")
    return [letters, *[f"{letters[:n]}*" for n in STEMS if len(letters) > n]]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), left to right, in linear time (Ruzzo and Tompa 1999)."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    ends = np.cumsum(scores)
    kept: list[tuple[int, int, float, float, int]] = []  # start, stop, sum before, sum at the end, last kept one with a lower sum before
    for i, high, own in zip(at.tolist(), ends[at].tolist(), scores[at].tolist()):
        start, low, j = i, high - own, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                break
            start, low, j = kept[j][0], kept[j][2], kept[j][4]
            while kept and kept[-1][0] >= start:
                kept.pop()
        kept.append((start, i + 1, low, high, j))
    return [(a, b, h - l) for a, b, l, h, _ in kept]


@dataclass
class ToxicModel:
    """``terms``: term -> (log-odds, z); decay and constant of the extreme-value law; the logistic curve."""

    terms: dict[str, tuple[float, float]]
    drift: float = 0.25
    decay: float = 1.0
    constant: float = 1.0
    bias: float = -3.0
    slope: float = 0.0

    def word_score(self, word: bytes) -> float:
        """Log-odds of the word's most certain term, less the drift that keeps ordinary text negative."""
        found = [self.terms[t] for t in terms_of(word) if t in self.terms]
        return (max(found, key=lambda t: abs(t[1]))[0] if found else 0.0) - self.drift

    def token_scores(self, words: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        values = list(map(known.get, words))
        if None in values:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in {w for w, v in zip(words, values) if v is None}:
                known[w] = self.word_score(w)
            values = [known[w] if v is None else v for w, v in zip(words, values)]
        return np.array(values)

    def evidence(self, found: list[float], n_words: int) -> float:
        """Sum over the significant segments of how far below 1 the expected number of such segments is, in logarithms."""
        base = np.log(max(self.constant * n_words, 1e-300))
        return float(sum(max(self.decay * s - base, 0.0) for s in found))

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.slope * np.log1p(evidence), -30, 30))))

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant segments of a text: first word, word after the last, score."""
        words = words_of(text)
        base = np.log(max(self.constant * len(words), 1e-300))
        return [s for s in segments(self.token_scores(words, {})) if self.decay * s[2] > base]


def _specific(found: list[tuple[str, int, float, float]]) -> dict[str, tuple[float, float]]:
    """Terms without the toxic beginnings that only a longer, more toxic one of theirs has made so."""
    bad = {t: (n, odds) for t, n, odds, _ in found}
    blurred: set[str] = set()
    for term, (n, odds) in bad.items():
        letters = term.rstrip("*")
        for size in STEMS:
            short = letters[:size] + "*"
            if size < len(letters) and short in bad and n >= 0.75 * bad[short][0] and 0 < bad[short][1] < odds - 0.3:
                blurred.add(short)
    return {t: (odds, z) for t, _, odds, z in found if t not in blurred}


def _decay(counts: dict[float, int]) -> float:
    """The positive root of sum p(s) e^(decay s) = 1 for token scores s of clean texts (negative on average).

    One more token of the highest log-odds is added, so that a root exists even if clean texts hold no toxic word.
    """
    s, n = np.array(list(counts)), np.array(list(counts.values()), float)
    p = n / n.sum()
    low, high = 1e-3, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float((p * np.exp(np.clip(mid * s, -700, 700))).sum()) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    beta = np.zeros(2)
    z = np.column_stack([np.ones(len(x)), x])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - ridge * beta
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows_per_class: int = 8000, prior_share: float = 0.02, least_z: float = 2.5, least_odds: float = 1.5, most_terms: int = 20_000) -> ToxicModel:
    """Learn from labelled rows whose fold is not 0.

    At most about ``rows_per_class`` rows of each label are used, chosen by a
    hash of the id.  The Dirichlet prior is ``prior_share`` of a term's overall
    count.  Only terms whose log-odds are ``least_z`` standard errors
    from 0 and at least ``least_odds`` enter the model, the ``most_terms`` most certain ones.  Without both
    labels the model has no terms and gives every text the same low score.
    """
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    rows = docs.filter(fold(id_col) != 0).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    sizes = {r["_toxic"]: r["n"] for r in marks.filter(fold("_id") != 0).groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return ToxicModel({})
    draw = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("_toxic") == 1, rows_per_class / sizes[1]).otherwise(rows_per_class / sizes[0])
    picked = marks.filter((fold("_id") != 0) & (draw < share))
    # at most three times rows_per_class small rows, so the texts need not be shuffled to meet them
    sample = cut_lineage(rows.join(F.broadcast(picked.select("_id", "_toxic").limit(3 * rows_per_class)), "_id").select("_toxic", "_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = iter(batch.column(0).to_pylist())
            for texts in text_batches(batch.column(1), 1 << 22):
                counts: dict[bytes, list[int]] = {}
                for text in texts:
                    label = next(toxic)
                    for w in set(words_of(text)):
                        counts.setdefault(w, [0, 0])[label] += 1
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()),
                                                  pa.array([c[1] for c in counts.values()], pa.int64()),
                                                  pa.array([c[0] for c in counts.values()], pa.int64())], names=["word", "bad", "good"])

    words = sample.mapInArrow(counted, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    term = F.explode(F.array_compact(F.array(F.col("word"), *[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEMS])))
    terms = words.select(term.alias("term"), "bad", "good").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    terms = cut_lineage(terms)
    whole = terms.filter(~F.col("term").endswith("*")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    n_bad, n_good = float(whole["bad"] or 0), float(whole["good"] or 0)
    prior = prior_share * (F.col("bad") + F.col("good"))
    all_prior = prior_share * (n_bad + n_good)

    def odds(y: str, n: float) -> Column:
        return F.log((F.col(y) + prior) / F.greatest(n + all_prior - F.col(y) - prior, F.lit(1.0)))

    log_odds = odds("bad", n_bad) - odds("good", n_good)
    z = log_odds / F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    chosen = terms.select("term", "bad", log_odds.alias("odds"), z.alias("z")).filter((F.abs("z") >= least_z) & (F.abs("odds") >= least_odds)).orderBy(F.desc(F.abs("z")), "term").limit(most_terms)
    model = ToxicModel(_specific([(r["term"], r["bad"], float(np.clip(r["odds"], -6, 8)), r["z"]) for r in chosen.collect()]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            toxic = iter(batch.column(0).to_pylist())
            for texts in text_batches(batch.column(1), 1 << 22):
                out = []
                for text in texts:
                    scores = model.token_scores(words_of(text), known)
                    values, n = np.unique(np.round(scores, 2), return_counts=True)
                    out.append((next(toxic), len(scores), [s for _, _, s in segments(scores)], values.tolist(), n.tolist()))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.float64()),
                                                  pa.list_(pa.float64()), pa.list_(pa.int64())))], names=["toxic", "n", "found", "values", "times"])

    # what a text's segments come to stays on the cluster: the driver gets the counts of distinct rounded scores and two numbers a text
    looked = cut_lineage(sample.mapInArrow(measured, "toxic int, n long, found array<double>, values array<double>, times array<long>"))
    clean = looked.filter("toxic = 0")
    seen = clean.select(F.explode(F.arrays_zip("values", "times")).alias("_s")).groupBy("_s.values").agg(F.sum("_s.times").alias("times")).collect()
    counts: dict[float, int] = {8.0 - model.drift: 1, -model.drift: 1}
    for value, times in sorted((r["values"], r["times"]) for r in seen):
        counts[value] = counts.get(value, 0) + times
    model.decay = _decay(counts)
    tops = clean.filter("n > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n") * F.exp(-model.decay * F.coalesce(F.array_max("found"), F.lit(0.0)))).alias("weight")).first()
    model.constant = tops["texts"] / max(tops["weight"], 1e-9) if tops["texts"] else 1.0
    base = F.log(F.greatest(model.constant * F.col("n"), F.lit(1e-300)))
    evidence = F.aggregate("found", F.lit(0.0), lambda total, found: total + F.greatest(model.decay * found - base, F.lit(0.0)))
    got = sorted((r["toxic"], r["evidence"]) for r in looked.select("toxic", evidence.alias("evidence")).collect())
    y = np.array([toxic for toxic, _ in got], float)
    if not len(y) or y.min() == y.max():
        return model
    x = np.log1p([found for _, found in got])
    weight = np.where(y == 1, sizes[1] / max(y.sum(), 1), sizes[0] / max((1 - y).sum(), 1))
    model.bias, model.slope = _logistic(x, y, weight / weight.mean())
    return model


def toxicity(text: Column, model: ToxicModel, batch_bytes: int = 1 << 20) -> Column:
    """Score of a text, 0 to 1; the model is bounded and goes along with the function."""
    @arrow_udf("double")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, float] = {}
        for column in columns:
            out = []
            for texts in text_batches(column, batch_bytes):
                for text in texts:
                    scores = model.token_scores(words_of(text), known)
                    out.append(model.score(model.evidence([s for _, _, s in segments(scores)], len(scores))))
            yield pa.array(out, pa.float64())

    return predict.asNondeterministic()(text)


def toxic_passages(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passages): the significant segments of every row as array<struct<first_word, stop_word, score>>."""
    @arrow_udf("array<struct<first_word: int, stop_word: int, score: double>>")
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("stop_word", pa.int32()), ("score", pa.float64())]))
        for column in columns:
            yield pa.array([[{"first_word": a, "stop_word": b, "score": s} for a, b, s in model.passages(t)]
                            for texts in text_batches(column) for t in texts], kind)

    return docs.select(id_col, find(text_or_empty(text_col)).alias("passages"))


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row; the model is fitted on the labelled rows unless given.

    Null and empty texts have no segments and get the lowest score.  Null ids
    are never learned from and not held out; repeated rows score alike; a doubly
    labelled id counts as toxic if one label says so; other columns are not read.
    """
    model = model or fit(docs, labels, id_col, text_col)
    found = docs.select(id_col, held_out(id_col).alias("held_out"), toxicity(text_or_empty(text_col), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
