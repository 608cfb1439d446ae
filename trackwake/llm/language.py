"""Hierarchical language identification.

Linear support vector machines over hashed byte trigrams of whole texts decide
the language family first, one family against each other, and then, within the
family, one language against each other.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

UNDETERMINED = "und"
FEATURES = 4096
#: At most so many labelled documents, shared evenly by the languages, are fitted.
SAMPLE = 2000
#: Where a machine between two names stands just at the border it gives one half, and
#: a score is a family's confidence times a language's within it.
MIN_SCORE = 0.25
BLOCK = 256

# Common codes by family; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz tt".split(),
    "semitic": "ar he am mt".split(),
    "indic": "hi bn ur mr gu pa ne si".split(),
    "iranian": "fa ps ku tg".split(),
    "austronesian": "id ms tl jv".split(),
    "dravidian": "ta te kn ml".split(),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

# Letters a-z and bytes of longer characters keep a code, all else is a border.
_CODES = np.zeros(256, np.int32)
_CODES[97:123] = np.arange(1, 27)
_CODES[128:] = np.arange(27, 155)


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.split("-")[0].lower(), language)


def trigram_features(text: str) -> np.ndarray:
    """Square roots of hashed trigram counts of the whole text, of length one."""
    codes = _CODES[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    codes = np.concatenate([[0], codes, [0]]).astype(np.int32)
    counts = np.zeros(FEATURES)
    if len(codes) >= 3:
        hashed = (codes[:-2] * 6151 + codes[1:-1] * 389 + codes[2:] * 25) & (FEATURES - 1)
        counts = np.bincount(hashed, minlength=FEATURES).astype(float)
        counts[0] = 0  # three borders
    norm = np.sqrt(counts.sum())
    return (np.sqrt(counts) / norm if norm else counts).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Machine(NamedTuple):
    """`first` where weights · features + bias is positive, else `second`."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


class Model(NamedTuple):
    families: list[str]
    between: list[Machine]
    languages: dict[str, list[str]]
    within: dict[str, list[Machine]]


def fit_machine(
    features: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 30
) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent, squared hinge."""
    x = np.hstack([features, np.ones((len(features), 1), np.float32)]).astype(np.float64)
    y = np.where(positive, 1.0, -1.0)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    curve = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    turns = np.random.default_rng(4)
    for _ in range(rounds):
        for i in turns.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + 0.5 * alpha[i] / cost
            moved = max(0.0, alpha[i] - gradient / curve[i])
            if moved != alpha[i]:
                w += (moved - alpha[i]) * y[i] * x[i]
                alpha[i] = moved
    return w[:-1].astype(np.float32), float(w[-1])


def _machines(features: np.ndarray, labels: np.ndarray, names: list[str]) -> list[Machine]:
    machines = []
    for first, second in combinations(names, 2):
        own = (labels == first) | (labels == second)
        machines.append(Machine(first, second, *fit_machine(features[own], labels[own] == first)))
    return machines


def fit(features: np.ndarray, languages: np.ndarray) -> Model:
    families = np.array([family_of(code) for code in languages])
    names = sorted(set(families))
    members = {f: sorted(set(languages[families == f])) for f in names}
    within = {
        f: _machines(features[families == f], languages[families == f], codes)
        for f, codes in members.items()
    }
    return Model(names, _machines(features, families, names), members, within)


def _decide(
    machines: list[Machine], names: list[str], features: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each row the name with most votes, then largest sum of margins, and its confidence."""
    if len(names) == 1:
        return np.zeros(len(features), int), np.ones(len(features))
    votes = np.zeros((len(features), len(names)))
    lowest = np.full(votes.shape, np.inf)
    for machine in machines:
        margin = features @ machine.weights + machine.bias
        for name, side in ((machine.first, margin), (machine.second, -margin)):
            k = names.index(name)
            votes[:, k] += (side > 0) + 1e-3 * np.tanh(side)
            lowest[:, k] = np.minimum(lowest[:, k], side)
    best = votes.argmax(axis=1)
    margin = lowest[np.arange(len(best)), best]
    return best, 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and a score from 0 to 1 for each text, und and 0 without a letter."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not model.families:
        return names, scores
    read = [i for i, text in enumerate(texts) if has_letter(text)]
    for at in range(0, len(read), BLOCK):
        block = np.array(read[at : at + BLOCK])
        features = np.stack([trigram_features(texts[i]) for i in block])
        families, sure = _decide(model.between, model.families, features)
        for k, family in enumerate(model.families):
            own = np.flatnonzero(families == k)
            if len(own):
                codes = model.languages[family]
                best, surer = _decide(model.within[family], codes, features[own])
                for i, code, score in zip(block[own], best, sure[own] * surer, strict=True):
                    names[i], scores[i] = codes[code], float(score)
    return names, scores


def held_out(id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(5)) == 0


def train(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", language: str = "lang", sample: int = SAMPLE
) -> Model:
    """Fit the machines on at most `sample` labelled rows that are not held out.

    Each language gets an even share, of the rows first in the order of a hash of
    the id. Only labels and feature vectors of the sample reach the driver.
    """
    labelled = docs.where(
        ~held_out(F.col(id)) & F.col(language).isNotNull() & F.col(text).isNotNull()
    ).select(
        F.col(id).alias("_id"),
        F.col(language).alias("_lang"),
        F.col(text).alias("_text"),
        F.pmod(F.xxhash64(F.lit("fit"), id), F.lit(1 << 30)).alias("_draw"),
    )
    counts = {r[0]: r[1] for r in labelled.groupBy("_lang").count().collect()}
    if not counts:
        return Model([], [], {}, {})
    share = max(1, sample // len(counts))
    odds = F.create_map(
        *(F.lit(x) for code, n in counts.items() for x in (code, min(1.0, 1.5 * share / n + 20 / n)))
    )
    drawn = labelled.where(F.col("_draw") < F.element_at(odds, F.col("_lang")) * (1 << 30))
    turn = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", "_id"))
    chosen = drawn.withColumn("_turn", turn).where(F.col("_turn") <= share)

    @F.pandas_udf("binary")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: trigram_features(t).astype(np.float16).tobytes())

    rows = chosen.select("_lang", "_draw", "_id", vectors("_text").alias("_x")).collect()
    rows.sort(key=lambda r: (r["_lang"], r["_draw"], r["_id"] is None, r["_id"]))
    features = np.stack([np.frombuffer(r["_x"], np.float16) for r in rows]).astype(np.float32)
    return fit(features, np.array([r["_lang"] for r in rows], dtype=object))


def predictor(model: Model):
    """A column function from texts to (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def language_of(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict(model, [None if pd.isna(t) else t for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return language_of


def identify(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """`docs` with doc_id, held_out, lang_pred and score for every row.

    The model is fitted on `docs` itself. Predictions read the text alone: a null
    text, or one without a letter, is `und` with score 0. Without a labelled row
    all texts are `und`.
    """
    language_of = predictor(train(docs, text=text, **options))
    return docs.select(
        F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), language_of(text).alias("_p")
    ).select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """`docs` without the rows whose language cannot be told.

    These have no text, no letter, or a score below MIN_SCORE: the machines found
    next to nothing that speaks for one language rather than another. Where no row
    is labelled there is no model, and every text with a letter stays.
    """
    model = train(docs)
    language_of = predictor(model)
    nested = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    if model.families:
        judged = nested.withColumn("_p", language_of("_doc.text"))
        told = (F.col("_p.lang_pred") != UNDETERMINED) & (F.col("_p.score") >= MIN_SCORE)
    else:
        judged, told = nested, F.col("_doc.text").rlike(r"\p{L}")
    return judged.where(told).select(*(F.col("_doc")[c].alias(c) for c in docs.columns))
