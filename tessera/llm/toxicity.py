"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Learning: at most ``per_class`` distinct labelled texts of each class (lowest hashes) go to the
driver, where log-count ratios and a logistic regression over the scaled features are fitted; the
classes weigh as all training labels have them. Scoring: a pandas UDF over whole texts with the
broadcast weights; no shuffle.

Edge cases: a null text scores like an empty one; an empty text scores the intercept alone; rows
with a null id or label are not learned from; without rows of both classes every text scores 0.
Repeated rows score alike; an id that repeats adds its distinct texts to the sample's candidates,
never more rows to the sample; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import code_points, give_back, hashed_ngrams, hashed_sample

ORDERS = (3, 4, 5)
BITS = 19
#: Texts of each class that the classifier is fitted on, at most.
PER_CLASS = 2000


@dataclass(frozen=True)
class ToxicityModel:
    """weights: one per hashed n-gram, log-count ratio included; bias: the intercept."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:
            return 0.0
        z = self.bias
        codes = code_points(text or "")
        for n in ORDERS:
            found = hashed_ngrams(codes, n, BITS)
            found = found[self.weights.take(found) != 0]
            z += float(self.weights[np.unique(found)].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-min(max(z, -60.0), 60.0))))


def features(text: str | None) -> np.ndarray:
    """Distinct hashed character n-grams of a whole text, for each order in turn."""
    codes = code_points(text or "")
    return np.concatenate([np.unique(hashed_ngrams(codes, n, BITS)) for n in ORDERS])


def sample_labelled(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of at most per_class labelled documents of each class, and the share of label 1 among all labels; learn: a condition on doc_id."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn)
    held = {r[0]: r[1] for r in known.groupBy("label").count().collect() if r[0] in (0, 1)}
    sample = []
    for v in sorted(held):
        # Both steps leave at most per_class rows, so the broadcast and what comes to the driver are bounded.
        ids = hashed_sample(known.filter(F.col("label") == v).select("doc_id"), per_class)
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("text")
        sample += [(r[0], v) for r in hashed_sample(texts, per_class).collect()]
    return sample, held.get(1, 0) / max(1, sum(held.values()))


def fit(sample: list[tuple[str | None, int]], prior: float = 0.5, ridge: float = 1e-3, steps: int = 60) -> ToxicityModel:
    """Log-count ratios, then logistic regression on the scaled binary features by accelerated gradient steps; prior: the weight of class 1."""
    y = np.array([int(v) for _, v in sample], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(1 << BITS), -np.inf)
    rows = [features(t) for t, _ in sample]
    size = 1 << BITS
    pos, neg = np.zeros(size), np.zeros(size)
    for f, v in zip(rows, y, strict=True):
        have = pos if v else neg
        have += np.bincount(f, minlength=size) if len(f) > size // 8 else 0
        if len(f) <= size // 8:
            np.add.at(have, f, 1)
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    # Presence rates rather than shares of all n-grams: a document counts once whatever its length.
    ratio = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    ratio[(pos + neg < 5) | (np.abs(ratio) < 0.7)] = 0  # too rare, or too even, to tell the classes apart
    kept = np.flatnonzero(ratio)
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    cols = [c[c >= 0] for c in (place[f] for f in rows)]
    col = np.concatenate(cols) if cols else np.empty(0, dtype=np.int64)
    row = np.repeat(np.arange(len(y)), [len(c) for c in cols])
    value = ratio[kept][col]
    weight = np.where(y == 1, prior / n_pos, (1 - prior) / n_neg)
    square = np.bincount(row, value**2, len(y)).max(initial=0.0)
    step = 1.0 / (0.25 * max(square, 1.0) * 0.05 + ridge)
    w, b = np.zeros(len(kept)), 0.0
    vw, vb = w.copy(), b
    last = np.inf
    for k in range(steps):
        z = np.bincount(row, value * vw[col], len(y)) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        loss = -(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum() + 0.5 * ridge * (vw**2).sum()
        if loss > last:
            step *= 0.5
            vw, vb = w.copy(), b
            last = np.inf
            continue
        last = loss
        g = weight * (p - y)
        nw = vw - step * (np.bincount(col, value * g[row], len(kept)) + ridge * vw)
        nb = vb - step * g.sum()
        m = k / (k + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    weights = np.zeros(size)
    weights[kept] = w * ratio[kept]
    return ToxicityModel(weights.astype(np.float32), float(b))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> ToxicityModel:
    sample, share = sample_labelled(docs, labels, learn, per_class=per_class)
    # The order in which rows come back must not matter.
    model = fit(sorted(sample, key=lambda r: (r[1], r[0])), share)
    del sample
    give_back()
    return model


def score_column(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """Probability that a whole text is toxic, as a column over docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return scored(F.coalesce(F.col(text), F.lit("")))
