"""Quality scores from pairwise preferences (Bradley-Terry).

A document's worth is a weighted sum of features of its whole text. The weights come from preference pairs, a document
labelled good against one labelled bad, by logistic loss on the difference of their features. The cut between keep
and reject is a quantile of the scores of the labelled documents: the level at which the fewest labels are on the
wrong side (of several, that in the widest gap), in the middle between the scores on both sides. A score is the logistic function of the worth's distance from the cut, so 0.5 is the cut.

Defined cases: a null text is empty, and a text without words has the score 0; repeated rows are scored each; labels that
are null are not used, and of several labels of one document the largest counts; with no labelled pair every text
with words scores 1 (nothing is rejected without evidence); empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import json
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold, logistic, map_rows, settle, text_of

#: At most about so many labelled documents are used for the fit, chosen by a hash of their ids.
MAX_LABELLED = 20_000
#: Preference pairs drawn from them.
PAIRS = 60_000
SYMBOLS = "#$%&*^~=<>{}[]\\_"
FEATURES = ["upper", "shouts", "symbols", "bars", "repeated", "same_words", "short", "word_length", "stops", "same_lines"]


def features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if n == 0:
        return [0.0] * len(FEATURES)
    per_word = lambda count: min(1.0, count / n)
    lines = text.split("\n")
    return [
        sum(map(str.isupper, words)) / n,
        per_word(text.count("!")),
        per_word(sum(map(text.count, SYMBOLS))),
        per_word(text.count("|")),
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 / (1 + n),
        min(1.0, (len(text) - n) / n / 20),
        per_word(text.count(".")),
        1 - len(set(lines)) / len(lines),
    ]


def featured(documents: DataFrame) -> DataFrame:
    """doc_id, has_words and one column per feature."""
    def make():
        def rows(ids, texts):
            for i, t in zip(ids, texts):
                yield i, bool(t.strip()), *features(t)
        return rows

    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_rows(columns, make, "doc_id long, has_words boolean, " + ", ".join(f"{f} double" for f in FEATURES))


def labelled(labels: DataFrame, column: str, parts: int, held_out: int) -> DataFrame:
    """doc_id and y (0 or 1) of the rows that may be learned from; one row per document."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold("doc_id", parts) != held_out))
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y")))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """About `most` of the rows, or all if they are fewer: those with the least hash of their id."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30)))


class Model:
    def __init__(self, weights: np.ndarray, cut: float, scale: float):
        self.weights, self.cut, self.scale = weights, cut, scale

    def score(self, x: np.ndarray, has_words: np.ndarray) -> np.ndarray:
        return np.where(has_words, 1 / (1 + np.exp(-np.clip((x @ self.weights - self.cut) * self.scale, -30, 30))), 0.0)

    def column(self) -> Column:
        """The score as a column expression over `featured`."""
        worth = sum((F.col(f) * float(w) for f, w in zip(FEATURES, self.weights)), F.lit(0.0))
        bounded_ = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (worth - float(self.cut)) * float(self.scale)))
        return F.when(F.col("has_words"), 1 / (1 + F.exp(-bounded_))).otherwise(0.0)

    def __repr__(self) -> str:
        return json.dumps({"weights": dict(zip(FEATURES, self.weights.round(3))), "cut": self.cut, "scale": self.scale})


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Weights from pairs (good, bad) by logistic loss on feature differences, and the cut."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(x.shape[1]), -1.0, 30.0)
    draw = np.random.default_rng(seed)
    spread = x.std(axis=0) + 1e-3
    difference = (x[draw.choice(good, PAIRS)] - x[draw.choice(bad, PAIRS)]) / spread
    weights = logistic(difference, np.ones(PAIRS), ridge=PAIRS * 1e-4) / spread
    order = np.argsort(x @ weights, kind="stable")
    scores, bad_below = (x @ weights)[order], np.append(0, np.cumsum(y[order] == 0))
    errors = (len(bad) - bad_below) + (np.arange(len(y) + 1) - bad_below)
    gaps = np.r_[0.0, np.diff(scores), 0.0]
    errors = np.where(gaps > 0, errors, len(y) + 1)  # a quantile lies between two scores
    level = max(np.flatnonzero(errors == errors.min()), key=lambda k: gaps[k])
    cut = (scores[max(level - 1, 0)] + scores[min(level, len(scores) - 1)]) / 2
    steep = logistic(np.c_[x @ weights - cut], y.astype(float), ridge=1e-2)[0]
    return Model(weights, float(cut), float(max(steep, 1e-3)))


def one_each(examples: DataFrame, features: list[str]) -> DataFrame:
    """doc_id, y and features, one row for each id, however many rows have it: all of them count in the mean of its features."""
    mean = lambda f: F.when(F.min(f) == F.max(f), F.min(f)).otherwise(F.avg(f)).alias(f)
    return examples.groupBy("doc_id", "y").agg(*map(mean, features))


def learn(featured_labelled: DataFrame) -> Model:
    """The model from labelled rows (`featured` with y), whose ids were bounded by MAX_LABELLED when they were chosen."""
    got = one_each(featured_labelled.where("has_words"), FEATURES).toPandas().sort_values(["doc_id", *FEATURES])
    return fit(got[FEATURES].to_numpy(float).reshape(len(got), len(FEATURES)), got["y"].to_numpy())


def score(documents: DataFrame, labels: DataFrame, column: str = "quality", parts: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted. The text of each document is read once, for its features."""
    seen = settle(featured(documents))
    chosen = bounded(labelled(labels, column, parts, held_out), MAX_LABELLED)
    model = learn(seen.join(F.broadcast(chosen), "doc_id"))
    return seen.select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), model.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def scorer(documents: DataFrame, labels: DataFrame, column: str = "quality", parts: int = 3, held_out: int = 1) -> Column:
    """The score as a function of the column `text`, for use as a filter that keeps all other columns."""
    chosen = bounded(labelled(labels, column, parts, held_out), MAX_LABELLED)
    model = learn(featured(documents.join(F.broadcast(chosen.select(F.col("doc_id"))), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id"))

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(model.score(x, np.array([bool(t.strip()) for t in texts], bool)))

    return scores(text_of())
