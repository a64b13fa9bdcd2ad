"""Language-model scores by subword lattice likelihood.

The pieces of an existing subword vocabulary span a lattice over each word: every way to cut the word
into pieces is a path, its probability the product of the pieces' unigram probabilities, and a
log-space forward recursion sums all paths. Cuts never cross white space, so the marginal of a text is
the product over its words, each with the probability that the text goes on, and of its end.

``score`` weighs the pieces by one round of expectation-maximisation over all training words
(forward-backward, counts summed by Spark), started from the vocabulary's scores; they are ranks, read as
a Zipf law. ``vocabulary_score`` is the same marginal by the vocabulary's scores alone. ``mixed_score``
gives each training word an arc of its own and weighs as Witten and Bell do, for N training tokens
of V kinds:

    P(word) = (count(word) + V * lattice(word)) / (N + V)

Plan: one pass counts words for each task and a shuffle sums them (``word_table``); the words' lattice
marginals are computed once for each distinct word; the ``COMMON`` words that occur most often, held-out
rows included, go to the tasks as a bounded broadcast, so that no word that is shuffled to the table is a
hot key. Rows are told apart by id and a hash of the text, so a retried task repeats the same keys.

Edge cases: a null text is an empty one (its end token alone); repeated rows each keep a row; words
that training has not seen have count 0; without training rows N = 0, the vocabulary's scores stay and
a text ends with probability 1/2; a word of any length is scored whole; ids keep their type.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, most_frequent

#: Words whose scores are sent to every task, at most.
COMMON = 1 << 17
#: Distinct words that a task holds before it hands their counts on.
HELD = 150_000
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Cells of the arrays of one lattice batch, about.
CELLS = 1_000_000
#: Unseen share of each piece in the estimate.
FLOOR = 0.05


@dataclass(frozen=True)
class Pieces:
    """keys: for each length, sorted hashes and piece numbers; logp: natural-log probability of each piece; byte: number of each byte's piece."""

    keys: dict[int, tuple[np.ndarray, np.ndarray]]
    logp: np.ndarray
    byte: np.ndarray

    def with_logp(self, logp: np.ndarray) -> Pieces:
        return Pieces(self.keys, logp, self.byte)


def hash_codes(codes: np.ndarray) -> np.uint64:
    h = np.zeros(codes.shape[:-1], dtype=np.uint64)
    for k in range(codes.shape[-1]):
        h = h * BASE + codes[..., k]
    return h


def load_pieces(path: str) -> Pieces:
    """Pieces of a sentencepiece file, with Zipf probabilities by the rank that their scores state."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte, by_length = np.zeros(256, dtype=np.int64), {}
    rank = np.zeros(n)
    for i in range(n):
        piece = sp.id_to_piece(i)
        rank[i] = -sp.get_score(i)
        if sp.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            rank[i] = n
        elif sp.is_control(i) or sp.is_unknown(i):
            rank[i] = n
        else:
            by_length.setdefault(len(piece), []).append((i, piece))
    keys = {}
    for length, some in sorted(by_length.items()):
        h = hash_codes(np.array([[ord(c) for c in p] for _, p in some], dtype=np.uint64))
        order = np.argsort(h)
        keys[length] = (h[order], np.array([i for i, _ in some])[order])
    p = 1 / (rank + 20)
    return Pieces(keys, np.log(p / p.sum()), byte)


def arcs(words: list[str], m: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length n: log probability and piece number (-1: none) of the arc that ends at j and is k-th in length, as (words, n + 1, lengths)."""
    codes = np.array([[ord(c) for c in MARK + w] for w in words], dtype=np.uint64)
    count, n = codes.shape
    lengths = [k for k in m.keys if k <= n]
    h = np.zeros((count, n + 1), dtype=np.uint64)
    for j in range(n):
        h[:, j + 1] = h[:, j] * BASE + codes[:, j]
    piece = np.full((count, n + 1, len(lengths)), -1, dtype=np.int32)
    power, last = np.ones(1, dtype=np.uint64), 0  # an array, so that it wraps around
    for at, k in enumerate(lengths):
        for _ in range(k - last):
            power = power * BASE
        last = k
        want = h[:, k:] - h[:, : n + 1 - k] * power
        keys, ids = m.keys[k]
        place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        piece[:, k:, at] = np.where(keys[place] == want, ids[place], -1)
    lengths = np.array(lengths)
    return weighted(words, piece, lengths, m.logp, m.byte), piece, lengths


def weighted(words: list[str], piece: np.ndarray, lengths: np.ndarray, logp: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Log probability of each arc, by the weights of the pieces."""
    score = np.where(piece >= 0, logp[piece], -np.inf)
    if len(lengths) and lengths[0] == 1:  # characters without a piece are spelled in bytes
        for w, j in zip(*np.nonzero(piece[:, 1:, 0] < 0), strict=True):
            score[w, j + 1, 0] = logp[byte[list((MARK + words[w])[j].encode("utf-8", "surrogatepass"))]].sum()
    return score


def log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over the last axis; -inf where all are."""
    top = x.max(axis=-1)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe[..., None]).sum(axis=-1))


def forward(score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    alpha = np.full(score.shape[:2], -np.inf)
    alpha[:, 0] = 0
    for j in range(1, score.shape[1]):
        some = int(np.searchsorted(lengths, j, side="right"))
        alpha[:, j] = log_sum(score[:, j, :some] + alpha[:, j - lengths[:some]])
    return alpha


def backward(score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n = score.shape[1] - 1
    beta = np.full(score.shape[:2], -np.inf)
    beta[:, n] = 0
    for j in range(n - 1, -1, -1):
        some = int(np.searchsorted(lengths, n - j, side="right"))
        ends = j + lengths[:some]
        beta[:, j] = log_sum(score[:, ends, np.arange(some)] + beta[:, ends])
    return beta


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of equal length, a bounded number at a time."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        step = max(1, CELLS // (16 * (int(n) + 2)))
        for k in range(0, len(at), step):
            yield at[k : k + step]


def marginals(words: list[str], m: Pieces, *others: np.ndarray) -> list[np.ndarray]:
    """log10 probability of each word, summed over all its segmentations; by the weights of m, and by other weights of its pieces."""
    out = [np.zeros(len(words)) for _ in (m.logp, *others)]
    for at in by_length(words):
        own = [words[i] for i in at]
        score, piece, lengths = arcs(own, m)
        out[0][at] = forward(score, lengths)[:, -1] / math.log(10)
        for more, logp in zip(out[1:], others, strict=True):
            more[at] = forward(weighted(own, piece, lengths, logp, m.byte), lengths)[:, -1] / math.log(10)
    return out


def expected(words: list[str], weight: np.ndarray, m: Pieces) -> np.ndarray:
    """Expected number of uses of each piece, over all segmentations of the weighted words."""
    out = np.zeros(len(m.logp))
    for at in by_length(words):
        score, piece, lengths = arcs([words[i] for i in at], m)
        alpha, beta = forward(score, lengths), backward(score, lengths)
        total = alpha[:, -1]
        for k, n in enumerate(lengths):
            use = np.exp(alpha[:, : alpha.shape[1] - n] + score[:, n:, k] + beta[:, n:] - total[:, None]) * weight[at][:, None]
            p = piece[:, n:, k]
            hit = (p >= 0) & (use > 0)
            out += np.bincount(p[hit], use[hit], len(out))
    return out


def split(text: str | None) -> list[bytes]:
    """Words of a text: ASCII letters in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_table(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """(word, count, seen): every word of docs, with its number in the rows that learning may see, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, others = Counter(), Counter()

        def rows():
            words = own_words | others
            columns = [[w.decode("utf-8", "replace") for w in words], [own_words[w] for w in words], [own_words[w] + others[w] for w in words]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["word", "n", "k"])

        for b in batches:
            for t, own in zip(b.column(0), b.column(1), strict=True):
                (own_words if own.as_py() else others).update(split(t.as_py()))
                if len(own_words) + len(others) > HELD:
                    yield rows()
                    own_words.clear()
                    others.clear()
        yield rows()

    rows = docs.select(F.col(text), F.coalesce(learn, F.lit(False)).alias("own"))
    return rows.mapInArrow(count, "word string, n long, k long").groupBy("word").agg(F.sum("n").alias("count"), F.sum("k").alias("seen"))


def fit(words: DataFrame, pieces: Pieces) -> Pieces:
    """One round of expectation-maximisation over a word table."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.logp))
        for b in batches:
            total += expected(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64), shared.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int32()), "uses": pa.array(total[at], pa.float64())})

    uses = words.filter("count > 0").select("word", "count").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    new = np.full(len(pieces.logp), FLOOR)
    for r in uses.collect():  # a row for each piece of the vocabulary at most
        new[r["piece"]] += r["uses"]
    return pieces.with_logp(np.log(new / new.sum())) if new.sum() > FLOOR * len(new) else pieces


def with_lattice(words: DataFrame, pieces: Pieces, given: Pieces) -> DataFrame:
    """Add to a word table the log10 of each word's lattice marginal, by the learned pieces and by those that were given."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, given.logp))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logp = shared.value
        for b in batches:
            both = marginals(b.column(0).to_pylist(), own, logp)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x) for x in both]], names=["word", "count", "seen", "lattice", "given"])

    return words.select("word", "count", "seen").mapInArrow(add, "word string, count long, seen long, lattice double, given double")


def score(docs: DataFrame, learn: Column, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", common: int = COMMON) -> DataFrame:
    """One row for each row of docs: (doc_id, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score, mixed_score)."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("own"))
    counted = checkpoint(word_table(rows, F.col("own")))
    given = load_pieces(vocabulary_path)
    words = checkpoint(with_lattice(counted, fit(counted, given), given))
    ends = rows.filter("own").count()
    r = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.when(F.col("count") > 0, 1)).alias("v")).first()
    total, kinds = r["n"] + ends, r["v"] + (ends > 0)
    spread = max(kinds, 1)
    stop = min(max(ends / total, 1e-6), 1 - 1e-6) if ends else 0.5  # never certain, whatever the training rows are
    end, on = math.log10(stop), math.log10(1 - stop)

    def mixture(count, lattice, power, log10):
        return log10(count + spread * power(10.0, lattice)) - math.log10(total + spread)

    def values(count: int, lattice: float, given: float) -> tuple[float, float, float, float, int]:
        mixed = mixture(count, lattice, math.pow, math.log10) if count else math.log10(spread) + lattice - math.log10(total + spread)
        return math.log10((count + 1) / (total + kinds + 1)), on + lattice, on + given, mixed, int(count > 0)

    frequent = most_frequent(words, "seen", common).select("word", "count", "lattice", "given").toArrow()  # at most `common` rows
    table = {w.encode(): values(*v) for w, *v in zip(*(frequent.column(k).to_pylist() for k in range(4)), strict=True)}
    shared = sc.broadcast((table, (math.log10((ends + 1) / (total + kinds + 1)), end, end, mixture(ends, end, math.pow, math.log10), int(ends > 0))))
    sums = ("base_score", "score", "vocabulary_score", "mixed_score")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                place, word, times, copies, whole = [], [], [], [], []
                for i, (h, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    n, own = 1, [*end]
                    for w, k in Counter(split(t)).items():
                        n += k
                        v = known.get(w)
                        if v is None:
                            place.append(i)
                            word.append(w.decode("utf-8", "replace"))
                            times.append(k)
                            copies.append(0)
                            whole.append((0, 0, 0.0, 0.0, 0.0, 0.0))
                        else:
                            own = [x + k * y for x, y in zip(own, v, strict=True)]
                    # No word holds a space, so this key meets no word of the table and does not make one hot task.
                    place.append(i)
                    word.append(f" {h}")
                    times.append(0)
                    copies.append(1)
                    whole.append((n, own[4], *own[:4]))
                to = pa.array(place, pa.int32())
                numbers = [pa.array(c, pa.int64() if j < 2 else pa.float64()) for j, c in enumerate(zip(*whole, strict=True))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(to), b.column(1).take(to), pa.array(word, pa.string()), pa.array(times, pa.int64()), pa.array(copies, pa.int64()), *numbers], names=names)

    names = ["doc_id", "h", "word", "k", "copies", "n_tokens", "n_known", *sums]
    parts = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(part, f"doc_id {kind}, h long, word string, k long, copies long, n_tokens long, n_known long, " + ", ".join(f"{x} double" for x in sums))
    c, lat = F.coalesce(F.col("count"), F.lit(0)), F.col("lattice")
    rare = {
        "base_score": F.log10((c + 1) / F.lit(float(total + kinds + 1))),
        "score": on + lat,
        "vocabulary_score": on + F.col("given"),
        "mixed_score": F.when(c > 0, mixture(c, lat, lambda x, y: F.pow(F.lit(x), y), F.log10)).otherwise(math.log10(spread) + lat - math.log10(total + spread)),
    }
    one = F.col("k") > 0
    joined = parts.join(words, "word", "left").select(
        "doc_id", "h", "copies", "n_tokens",
        (F.col("n_known") + F.when(one & (c > 0), F.col("k")).otherwise(0)).alias("n_known"),
        *[(F.col(x) + F.when(one, F.col("k") * v).otherwise(0.0)).alias(x) for x, v in rare.items()],
    )
    by_row = joined.groupBy("doc_id", "h").agg(*[F.sum(x).alias(x) for x in ("copies", "n_tokens", "n_known", *sums)])
    each = [F.expr("n_tokens div copies").alias("n_tokens"), F.expr("n_known div copies").alias("n_known"), F.lit(total).cast("long").alias("train_tokens")]
    return by_row.select("doc_id", *each, *[(F.col(x) / F.col("copies")).alias(x) for x in sums], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
