"""Language identification by hierarchical discrimination.

Features are hashed byte n-grams (1 to 3) of the letters of a whole text.  One
linear classifier per language family decides the family first; inside a family
one linear support vector machine for each pair of its languages votes.  The
families are learned: languages whose mean features are close are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .batches import fold, held_out, text_batches, text_or_empty

UNDETERMINED = "und"
SLOTS = 2048
BATCH_ROWS = 512
"""Texts whose features are held at once, however short they are: 8 MB of them."""
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = r"[a-zA-Z]|[^\x00-\x7f]"
"""What is left of a text as features: the letters of ``_PLAIN`` before lower-casing."""
_WEIGHTS = ((0x9E3779B1, 0, 0), (0x85EBCA77, 0xC2B2AE3D, 0), (0x27D4EB2F, 0x165667B1, 0x9E3779B1))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(texts: list[str]) -> np.ndarray:
    """One unit row per text: square roots of the shares of its hashed n-grams.

    Texts are lower-cased, everything but letters is one space; a text without
    letters is a row of zeros.
    """
    raw = [b" " + b" ".join(t.lower().encode("utf-8").translate(_PLAIN).split()) + b" " for t in texts]
    data = np.frombuffer(b"".join(r + b"  " for r in raw), np.uint8).astype(np.uint32)  # two blanks of its own end every text
    sizes = np.array([len(r) for r in raw], np.int64)
    owner = np.repeat(np.arange(len(raw), dtype=np.int64) * SLOTS, sizes)
    n = max(len(data) - 2, 0)
    own = np.ones(n, bool)
    ends = (np.cumsum(sizes + 2) - 2)[:-1]
    own[ends] = own[ends + 1] = False
    counts = np.zeros(len(raw) * SLOTS)
    for a, b, c in _WEIGHTS:
        mixed = data[:n] * np.uint32(a)
        if b:
            mixed ^= (data[1:n + 1] + np.uint32(1)) * np.uint32(b)
        if c:
            mixed ^= (data[2:n + 2] + np.uint32(1)) * np.uint32(c)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(owner + (mixed[own] >> np.uint32(21)), minlength=len(counts))
    rows = np.sqrt(counts.reshape(len(raw), SLOTS))
    rows[[len(r) <= 2 for r in raw]] = 0
    norm = np.sqrt((rows ** 2).sum(axis=1, keepdims=True))
    return rows / np.maximum(norm, 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (last one the bias) of a linear machine with squared hinge loss, by dual coordinate descent.

    ``y`` is +1 or -1; classes weigh alike whatever their numbers of rows.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) * 2.0 / len(y)
    slack = 1.0 / (2 * cost * np.maximum(weight, 1e-9))
    norm = (x ** 2).sum(axis=1) + slack
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + slack[i] * alpha[i]) / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    """``families``: lists of languages; ``family``: one row of weights per family; ``pairs``: (language, language, weights)."""

    families: list[list[str]]
    family: np.ndarray
    pairs: list[tuple[str, str, np.ndarray]]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1: how clear the narrower of the two decisions is) of each text."""
        x = features(texts)
        x = np.hstack([x, np.ones((len(x), 1))])
        langs, sure = np.full(len(x), UNDETERMINED, dtype=object), np.zeros(len(x))
        if self.families:
            side = x @ self.family.T
            first = side.argmax(axis=1)
            gap = np.sort(side, axis=1)
            sure = gap[:, -1] - gap[:, -2] if len(self.families) > 1 else np.full(len(x), 2.0)
            weights = {(a, b): w for a, b, w in self.pairs}
            for f, members in enumerate(self.families):
                own = np.flatnonzero(first == f)
                if not len(own):
                    continue
                rows = x[own]
                votes, margins = np.zeros((len(own), len(members))), np.zeros((len(own), len(members)))
                for i, a in enumerate(members):
                    for j in range(i + 1, len(members)):
                        m = rows @ weights[a, members[j]]
                        votes[:, i] += m >= 0
                        votes[:, j] += m < 0
                        margins[:, i] += m
                        margins[:, j] -= m
                rank = votes * 1e6 + np.clip(margins, -1e5, 1e5)
                best = rank.argmax(axis=1)
                langs[own] = np.array(members, dtype=object)[best]
                if len(members) > 1:
                    sure[own] = np.minimum(sure[own], np.abs(margins[np.arange(len(own)), best]))
        lettered = np.array([has_letter(t) for t in texts], bool)
        langs[~lettered] = UNDETERMINED
        score = np.where(lettered & bool(self.families), 1 / (1 + np.exp(-2 * np.maximum(sure, 0))), 0.0)
        return langs.tolist(), score


def learn_families(means: dict[str, np.ndarray], n_families: int) -> list[list[str]]:
    """Average-linkage merging of languages down to ``n_families``."""
    groups = [[lang] for lang in sorted(means)]
    if not groups:
        return []
    x = np.array([means[g[0]] for g in groups])
    norm = (x ** 2).sum(axis=1)
    near = x @ x.T / np.sqrt(np.outer(norm, norm) + 1e-12)
    np.fill_diagonal(near, -np.inf)
    while len(groups) > max(n_families, 1):
        i, j = sorted(np.unravel_index(near.argmax(), near.shape))
        a, b = len(groups[i]), len(groups[j])
        near[i] = near[:, i] = (a * near[i] + b * near[j]) / (a + b)  # the mean over all pairs of the two
        near[i, i] = -np.inf
        near = np.delete(np.delete(near, j, 0), j, 1)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 400,
        rows_in_all: int = 25_600, least_rows: int = 40, n_families: int | None = None) -> LanguageModel:
    """Learn from rows with a language whose fold is not 0.

    Every language with a row that has a letter is learned.  Of each about
    ``rows_per_language`` such rows are used, or an even share of ``rows_in_all``
    but ``least_rows`` if there are many languages, chosen by a hash of the id;
    only their features come to the driver.  ``n_families`` defaults to the square root of
    the number of languages.  Without labelled rows the model knows no language.
    """
    own = F.col(lang_col).cast("string")
    rows = docs.filter((fold(id_col) != 0) & own.isNotNull()).select(F.col(id_col).alias("_id"), own.alias("_lang"), text_or_empty(text_col).alias("_text"))
    rows = rows.filter(F.col("_text").rlike(_LETTER))
    found = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).toArrow()
    if not len(found):
        return LanguageModel([], np.zeros((0, SLOTS + 1)), [])
    bound = min(rows_per_language, max(least_rows, rows_in_all // len(found)))
    draw = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    many = found.filter(pc.greater(found.column("_n"), bound))
    picked = rows
    if len(many):
        share = docs.sparkSession.createDataFrame(many).withColumnRenamed("_lang", "_of")
        picked = rows.join(F.broadcast(share), F.col("_lang") == F.col("_of"), "left").filter(
            F.col("_n").isNull() | (draw < F.lit(float(bound)) / F.col("_n")))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = iter(batch.column(0).to_pylist())
            for texts in text_batches(batch.column(1), 1 << 19, BATCH_ROWS):
                own_langs = [next(langs) for _ in texts]
                x = features(texts)
                keep = [i for i in range(len(x)) if x[i].any()]
                yield pa.RecordBatch.from_arrays([pa.array([own_langs[i] for i in keep], pa.string()),
                                                  pa.array([x[i].astype(np.float32).tobytes() for i in keep], pa.binary())], names=["lang", "x"])

    got = picked.select("_lang", "_text").mapInArrow(measured, "lang string, x binary").toArrow()
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    if not len(langs):
        return LanguageModel([], np.zeros((0, SLOTS + 1)), [])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(langs), SLOTS).astype(np.float64)
    order = np.lexsort((*x[:, :4].T, langs.astype(str)))  # the order rows arrive in does not matter
    langs, x = langs[order], x[order]
    means = {lang: x[langs == lang].mean(axis=0) for lang in sorted(set(langs))}
    families = learn_families(means, n_families or max(1, round(len(means) ** 0.5)))
    inside = [np.isin(langs, members) for members in families]
    weights = [fit_svm(x, np.where(own, 1.0, -1.0)) for own in inside] if len(families) > 1 else [np.zeros(SLOTS + 1)]
    pairs = []
    for members in families:
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                both = (langs == a) | (langs == b)
                pairs.append((a, b, fit_svm(x[both], np.where(langs[both] == a, 1.0, -1.0))))
    return LanguageModel(families, np.array(weights), pairs)


def language(text: Column, model: LanguageModel, batch_bytes: int = 1 << 19) -> Column:
    """struct<lang_pred, score> of a text; the model is a few weights per n-gram slot and goes along with the function."""
    @arrow_udf("lang_pred string, score double")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs: list[str] = []
            scores: list[float] = []
            for texts in text_batches(column, batch_bytes, BATCH_ROWS):
                found, sure = model.predict(texts)
                langs += found
                scores += sure.tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict.asNondeterministic()(text)


def identify(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; the model is fitted on the same table unless given.

    A null text or one without a letter is ``und`` with score 0.  Null ids are
    never learned from and not held out; repeated rows are predicted alike;
    other columns are not read.
    """
    model = model or fit(docs, id_col, text_col)
    found = docs.select(id_col, held_out(id_col).alias("held_out"), language(text_or_empty(text_col), model).alias("_found"))
    return found.select(id_col, "held_out", "_found.lang_pred", "_found.score")
