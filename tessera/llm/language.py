"""Language identification by mixture inference over character n-grams.

Learning: hashed trigram counts per language over at most about ``per_language`` labelled texts of
each language (a hash of the id decides, so no group is ever gathered). Inference: for each whole
text, expectation-maximisation estimates the proportion of each language from the trigrams'
likelihoods; the set of languages then grows by the next most frequent one while a penalised
likelihood (BIC over independent trigrams) improves. The largest proportion of the set gives the
language and its score.

Edge cases: a null text, or one without letters, is ``und`` with score 0, and so is every text when
nothing could be learned. Ties go to the language that sorts first. Repeated rows get equal answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import code_points, hashed_ngrams

BITS = 14
#: Labelled texts of each language that the model is fitted on, about.
PER_LANGUAGE = 1500
SMOOTHING = 0.5
ROUNDS = 10
#: Neighbouring trigrams share letters, so only every third counts as evidence in the penalty.
OVERLAP = 3.0
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """names: languages in order; table: likelihood of each hashed trigram, one row for each language."""

    names: tuple[str, ...]
    table: np.ndarray

    def infer(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        h = trigrams(text)
        if not len(h) or not self.names:
            return UNKNOWN, 0.0, [], []
        full = np.bincount(h, minlength=1 << BITS)
        idx = np.flatnonzero(full)
        count, p = full[idx].astype(np.float32), self.table[:, idx]
        total = float(count.sum(dtype=np.float64))
        every = len(self.names)
        full_share, _ = mixture(p, count, np.full(every, 1 / every))
        ranked = sorted(range(every), key=lambda i: (-full_share[i], i))
        chosen: list[int] = []
        share, best = np.ones(0), -np.inf
        for k in range(1, every + 1):  # sets grow by the next most frequent language while the penalised likelihood does
            some = sorted(ranked[:k])
            s, like = mixture(p[some], count, full_share[some] / full_share[some].sum())
            value = like / OVERLAP - 0.5 * k * np.log(max(total, 2.0))
            if value <= best:
                break
            chosen, share, best = some, s, value
        top = int(np.argmax(share))
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], i))
        return self.names[chosen[top]], float(min(share[top], 1.0)), [self.names[chosen[i]] for i in order], [float(share[i]) for i in order]


def mixture(p: np.ndarray, count: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions after expectation-maximisation, and the log-likelihood they give."""
    total = float(count.sum(dtype=np.float64))
    share = share.astype(p.dtype)
    if len(share) > 1:
        for _ in range(ROUNDS):
            share = share * (p @ (count / (share @ p))) / total
    return share, float((np.log(share @ p) * count).sum(dtype=np.float64))


#: For each code point of the basic plane, whether it is a letter.
LETTER = np.array([chr(k).isalpha() for k in range(1 << 16)])


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the letters of a whole text, each run of other characters read as one space; empty without letters."""
    codes = code_points(text or "")
    letter = LETTER[np.minimum(codes, (1 << 16) - 1)]
    for k in np.flatnonzero(codes >= 1 << 16):
        letter[k] = chr(int(codes[k])).isalpha()
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stays
    space = np.array([32], dtype=np.uint32)
    return hashed_ngrams(np.concatenate([space, codes[keep], space]), 3, BITS)


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Counts of hashed trigrams by language over a hash-chosen share of the labelled texts, summed by Spark."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & learn)
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row for each language
    if not sizes:
        return LanguageModel((), np.zeros((0, 1 << BITS)))
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) / 1_000_000
    chosen = known.filter(draw < rate[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, t in zip(pdf["lang"], pdf["text"], strict=True):
                have = sums.setdefault(name, np.zeros(1 << BITS, dtype=np.int64))
                have += np.bincount(trigrams(t), minlength=1 << BITS)
        for name, have in sums.items():
            at = np.flatnonzero(have)
            yield pd.DataFrame({"lang": name, "gram": at, "n": have[at]})

    counted = chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # At most 2**BITS rows for each language.
    packed = counted.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams")).collect()
    names = tuple(sorted(r["lang"] for r in packed))
    table = np.full((len(names), 1 << BITS), SMOOTHING)
    for r in packed:
        grams = np.array([(g["gram"], g["n"]) for g in r["grams"]])
        table[names.index(r["lang"]), grams[:, 0]] += grams[:, 1]
    return LanguageModel(names, (table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def predict_column(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """struct(lang, score, langs, shares) for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, langs array<string>, shares array<double>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.infer(t) for t in texts], columns=["lang", "score", "langs", "shares"])

    return predicted(F.coalesce(F.col(text), F.lit("")))
