"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has one bit for each of the 64 places in which over half of the hashes of its word
shingles (repeats included) are set. Two fingerprints within an even radius r have a value in common
that lies within r/2 of both, and a value within r/2 of two fingerprints puts them within r of each
other. So every distinct fingerprint emits all values within half the radius, the values are shuffled,
and the fingerprints that meet at a value are linked; each such pair is taken once and verified.

Hot keys: equal fingerprints are taken together first, so a group of copies of any size is one row; at
one value at most ``len(masks(radius))`` distinct fingerprints can meet (65 for a radius of 2), whatever
the table holds. Links are wanted up to connectivity, so at each value all are linked to the least of
them. The way back from fingerprints to documents is a join that adaptive execution can split.

Edge cases: a null text, or one without words, has the fingerprint zero, linked like any other; a text of
fewer words than a shingle is one shingle, its whole sequence; texts are read whole, in pieces of
``PIECE`` bytes; repeated rows and ids each stay; a component's id is its smallest document id, nulls
apart (null where all are); ids keep their type; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint
from tessera.llm.jaccard import components

SEED = 42
#: Bytes of a text whose words are held at a time, about.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, a run of them at a time; no word is cut."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes, n: int, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of a text in UTF-8; ASCII letters count in lower case, words end at ASCII white space."""
    digest, total, votes, last = xxhash.xxh64_digest, 0, np.zeros(64, dtype=np.int64), []

    def vote(hashes: list[bytes]) -> None:
        nonlocal total, votes
        total += len(hashes)
        votes += np.unpackbits(np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)

    for words in pieces(data.lower()):
        words = last + words
        if len(words) >= n:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate([[0], ends[: len(words) - n]]).tolist()
            line = b" ".join(words)
            vote([digest(line[a:z], seed) for a, z in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)])
        last = words[-(n - 1) :] if n > 1 else []
    if not total and last:
        vote([digest(b" ".join(last), seed)])
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", n) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(radius: int) -> list[int]:
    """All signed 64-bit values with at most half the radius of bits set."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius must be 0, 2 or 4")
    made = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints ``fp`` that link them as all pairs within the radius would."""
    ball = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius)]))
    met = distinct.select("fp", ball.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    least = met.withColumn("a", F.min("fp").over(Window.partitionBy("value"))).filter("a <> fp")
    pairs = least.select("a", F.col("fp").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs."""
    rows = checkpoint(fingerprints(docs, n, doc_id, text))
    kinds = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    joined = components(links(kinds.select("fp"), radius))
    named = kinds.join(joined, kinds["fp"] == joined["node"], "left").select("fp", "doc_id", F.coalesce("comp", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named.select("fp", "comp").join(least, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
