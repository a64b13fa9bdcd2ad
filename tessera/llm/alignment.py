"""Alignment of two tokenizers' tokens, and how often their tokens stand over each other.

A text with a space before it is encoded by a byte-level tokenizer (A) and by a piece tokenizer (B), which
adds that space itself. Every byte gets a label: none, A-end, B-end, or both. A regular expression scans the
label string for spans up to each both-label; a span is a group, and the numbers of its labels are its
numbers of tokens. Each labelled byte ends a stretch that one A and one B token share, so the labelled
bytes are the links between tokens.

Texts are cut where neither tokenizer joins what stands on both sides: before a space that follows
something other than a space and precedes something other than white space. (A's splitting rule binds that
space to the word behind it; no piece of B may hold a space behind another character, which is tested when
the vocabulary is read, else texts stay whole.) A worker labels each distinct chunk once while it is
remembered, so the ids are those of the whole texts.

Every text is labelled once: its sums, groups and linked ids (four bytes a link) are written to the shared
folder, and what follows reads them. Links are counted per pair of ids over all rows by tasks, then by pair. Ids of the pairs found most often,
at most ``TOLD`` of them, are sent to every task with their counts; the other pairs of a document are joined with
their counts by a shuffle, so nothing that grows with the data is broadcast and no pair is left out.

Edge cases: texts that are null or empty, or whose tokens do not spell the text with its space, have no
tokens: zeros, no groups, and no part in the counts; strings of special tokens are plain text; repeated rows
each count and stay; ids of documents keep their type; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import trim
from tessera.llm.common import checkpoint, most_frequent

#: Pairs of ids whose counts are sent to every task, at most (17 bytes each).
TOLD = 1_000_000
#: Chunks that a worker remembers, and how many stay when there are more; chunks of more characters are not remembered.
CACHE, KEPT, SHORT = 350_000, 250_000, 64
#: Texts worked on at a time, pairs that are counted before they are handed on.
TEXTS, HELD = 128, 1_000_000
#: What a row's tokens and links come to.
SUMS = ["n_a", "n_b", "n_groups", "n_links"]
#: A pair of ids is one number: A's id times this, and B's id.
B_IDS = 1 << 20
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
LOOSE = re.compile(r"\A | (?=\s|\Z)")
#: Labels: none, A-end, B-end, both.
LABELS = np.frombuffer(b".ab|", dtype=np.uint8)
SPAN = re.compile(rb"[^|]*\|")


def byte_values() -> dict[str, int]:
    """Character of byte-level vocabularies to byte: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the chunks met so far.

    Of a chunk is known (A tokens, B tokens, groups, groups as text, linked pairs as ``packed``), or None
    where its tokens spell something else.
    """

    def __init__(self, a_spec: str, b_model: bytes):
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        spec, value = json.loads(a_spec), byte_values()
        spelt = {i: bytes(value[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in value for c in t)}
        spelt |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.a_bytes = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Ids with what follows them: within a group, and at the end of its A or B side.
        self.names = [f"{i}{mark}" for t, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(t))]
        pre = spec["pre_tokenizer"]
        self.encode_a = self.ranked(spec, spelt) or self.library(a_spec)
        self.width = 4 if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else 8
        self.whole = spec["normalizer"] is not None or pre["type"] != "ByteLevel" or not pre["use_regex"] or any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, tuple | None] = {}
        #: Known chunks without tokens.
        self.none: set[str] = set()
        self.long: list[str] = []

    def packed(self, a: np.ndarray, b: np.ndarray) -> bytes:
        """Linked ids, ``width`` bytes a link: two 16-bit ids if all ids are so small, else the pair's number."""
        return (a << 16 | b).astype(np.uint32).tobytes() if self.width == 4 else (a * B_IDS + b).tobytes()

    @staticmethod
    def library(a_spec: str) -> Callable[[list[str]], list[list[int]]]:
        """Encoding by the file itself."""
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(a_spec)
        tok.encode_special_tokens = True
        return lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def ranked(spec: dict, spelt: dict[int, bytes]) -> Callable[[list[str]], list[list[int]]] | None:
        """The same by ranks, some times as fast, where ids are ranks: bytes first, then the results of the merges in their order."""
        model, pre = spec["model"], spec["pre_tokenizer"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if model["type"] != "BPE" or spec["normalizer"] is not None or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or model.get("ignore_merges") or [model["vocab"].get(a + b) for a, b in pairs] != [*range(256, 256 + len(pairs))]:
            return None
        import public_tokenizers
        import tiktoken

        ranks = {spelt[i]: i for i in range(256 + len(pairs))}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [enc.encode_ordinary(t) for t in texts]

    def cut(self, text: str) -> list[str]:
        """The chunks of a text, each without the space that it starts with."""
        if self.whole:
            return [text]
        return CUT.split(text) if LOOSE.search(text) else text.split(" ")

    def chunks(self, texts: list[str | None]) -> list[list[str]]:
        """The chunks of each text, all of them known afterwards; none of a text without tokens."""
        trim(self.known, CACHE, KEPT)
        cut = [self.cut(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.known))
        found = self.labelled(new)
        self.known.update(zip(new, found, strict=True))
        self.none = {c for c in self.none if c in self.known} | {c for c, x in zip(new, found, strict=True) if x is None}
        self.long = [c for c in new if len(c) > SHORT]
        return [[] if self.none and not self.none.isdisjoint(c) else c for c in cut]

    def forget_long(self) -> None:
        for c in self.long:
            del self.known[c]
        self.long = []

    def labelled(self, chunks: list[str]) -> list[tuple | None]:
        """Label and scan chunks, all in one string."""
        if not chunks:
            return []
        ids = self.encode_a([" " + c for c in chunks]), self.b.encode(chunks, num_threads=1)
        counts = [np.fromiter(map(len, x), dtype=np.int64, count=len(chunks)) for x in ids]
        a, b = (np.fromiter(chain.from_iterable(x), dtype=np.int64, count=int(n.sum())) for x, n in zip(ids, counts, strict=True))
        data = [b" " + c.encode("utf-8", "surrogatepass") for c in chunks]
        size, whole = np.fromiter(map(len, data), dtype=np.int64, count=len(data)), b"".join(data)

        def spelt(own: np.ndarray, count: np.ndarray, sizes: np.ndarray, table: list[bytes]) -> bool:
            ends = np.concatenate([[0], np.cumsum(sizes[own])])[np.cumsum(count)]
            return bool((count > 0).all()) and np.array_equal(ends, np.cumsum(size)) and b"".join(map(table.__getitem__, own.tolist())) == whole

        if not (spelt(a, counts[0], self.a_sizes, self.a_bytes) and spelt(b, counts[1], self.b_sizes, self.b_bytes)):
            if len(chunks) == 1:
                return [None]
            half = len(chunks) // 2
            return self.labelled(chunks[:half]) + self.labelled(chunks[half:])
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.zeros(len(whole), dtype=np.uint8)
        ends[a_end - 1] |= 1
        ends[b_end - 1] |= 2
        marks = ends[ends > 0]
        is_a, is_b = marks & 1, marks >> 1
        pairs = self.packed(a[np.cumsum(is_a) - is_a], b[np.cumsum(is_b) - is_b])
        spans = SPAN.findall(LABELS[ends].tobytes())
        # Labels of each side in a span, by prefix sums at the spans' ends; the both-label counts for either.
        last = np.cumsum(np.fromiter(map(len, spans), dtype=np.int64, count=len(spans))) - 1
        in_a, in_b = (np.diff(np.cumsum(side, dtype=np.int64)[last], prepend=0) for side in (ends & 1, ends >> 1))
        # Written group by group, its A ids before its B ids.
        order = np.empty(len(a) + len(b), dtype=np.int64)
        start, base = np.cumsum(in_a + in_b) - in_a - in_b, 0
        for own, count, at, table in ((a, in_a, start, self.a_bytes), (b, in_b, start + in_a, self.b_bytes)):
            last = np.cumsum(count)
            place = np.arange(len(own)) + np.repeat(at - last + count, count)
            order[place] = own + base
            order[place[last - 1]] += len(table)
            base += 2 * len(table)
        words = list(map(self.names.__getitem__, order.tolist()))
        end = np.cumsum(counts[0] + counts[1])
        groups = np.diff(np.searchsorted(start, end), prepend=0)
        links = np.cumsum(counts[0] + counts[1] - groups) * self.width
        out, w, p = [], 0, 0
        for n_a, n_b, n, w_end, p_end in zip(counts[0].tolist(), counts[1].tolist(), groups.tolist(), end.tolist(), links.tolist(), strict=True):
            out.append((n_a, n_b, n, "".join(words[w:w_end])[:-1], pairs[p:p_end]))
            w, p = w_end, p_end
        return out


_ALIGNERS: dict[tuple[int, int], Aligner] = {}


def aligner(a_spec: str, b_model: bytes) -> Aligner:
    """One for each worker and pair of vocabularies; what it remembers outlives a task."""
    key = hash(a_spec), hash(b_model)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_spec, b_model)
    return _ALIGNERS[key]


class Told:
    """Counts of the most frequent pairs of ids, and which of them are the highest of their B id."""

    def __init__(self, pair: np.ndarray, count: np.ndarray, best: np.ndarray):
        by = np.argsort(pair)
        self.pair, self.count, self.best = pair[by], count[by], best[by]

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(told or not, best, count) of each pair; of one that is not told, zeros."""
        if not len(self.pair):
            return np.zeros(len(pairs), dtype=bool), *[np.zeros(len(pairs), dtype=np.int64)] * 2
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        known = self.pair[at] == pairs
        return known, known & self.best[at], np.where(known, self.count[at], 0)


def read_vocabularies(a_path: str, b_path: str) -> tuple[str, bytes]:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def links(b: pa.RecordBatch, column: int, counts: np.ndarray) -> np.ndarray:
    """The pairs of ids of all rows of a batch, one after another, from ``packed``; counts: links of each row."""
    data = b"".join(x for x in b.column(column).to_pylist())
    if len(data) == 4 * int(counts.sum()):
        ids = np.frombuffer(data, dtype=np.uint32).astype(np.int64)
        return (ids >> 16) * B_IDS + (ids & 0xFFFF)
    return np.frombuffer(data, dtype=np.int64)


def labelled_rows(docs: DataFrame, vocabularies, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, n_a, n_b, n_groups, n_links, groups, links), a row for each row of docs; vocabularies: what ``read_vocabularies`` gives, broadcast.

    h: xxhash64 of the text; links: the pairs of ids in text order, ``packed``.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(*vocabularies.value)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                sums, groups, packed = [], [], []
                for chunks in al.chunks(b.column(2).to_pylist()):
                    n_a, n_b, n, texts, pairs = zip(*map(al.known.__getitem__, chunks)) if chunks else ((),) * 5
                    found = b"".join(pairs)
                    sums.append((sum(n_a), sum(n_b), sum(n), len(found) // al.width))
                    groups.append(";".join(texts))
                    packed.append(found)
                al.forget_long()
                columns = [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array(groups, pa.string()), pa.array(packed, pa.binary())], names=["doc_id", "h", *SUMS, "groups", "links"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return rows.mapInArrow(label, f"doc_id {kind}, h long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups string, links binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): links of each pair of ids over all labelled rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            kinds, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(kinds)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_pydict({"pair": pa.array(kinds), "n": pa.array(n)})

        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                held.append(np.unique(links(b, 1, b.column(0).to_numpy()), return_counts=True))
                if sum(len(p) for p, _ in held) > HELD:
                    yield out()
        if held:
            yield out()

    return rows.select("n_links", "links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, keep: Callable[[Column], Column] | None = None, doc_id: str = "doc_id", text: str = "text", told: int = TOLD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), a row for each row of docs.

    groups: ``a1,a2|b1;a3|b2,b3`` in ids, or what ``keep`` makes of it (an aggregate needs less room for a digest).
    n_best: links whose pair is linked as often as any pair of its B id; count_sum: the sum of the links' counts.
    """
    sc = docs.sparkSession.sparkContext
    labelled = labelled_rows(docs, sc.broadcast(read_vocabularies(a_path, b_path)), doc_id, text)
    rows = checkpoint(labelled.withColumn("groups", keep(F.col("groups"))) if keep else labelled)
    counts = checkpoint(pair_counts(rows))
    tops = counts.groupBy((F.col("pair") % B_IDS).alias("b")).agg(F.max("n").alias("top"))
    # As many rows as B has ids at most.
    counts = checkpoint(counts.withColumn("b", F.col("pair") % B_IDS).join(F.broadcast(tops), "b").select("pair", F.col("n").alias("count"), (F.col("n") == F.col("top")).alias("best")))
    most = most_frequent(counts, "count", told).toArrow()  # at most `told` rows
    known = sc.broadcast(Told(*(most.column(k).to_numpy() for k in range(3))))
    names = ["doc_id", "h", "pair", "k", "copies", *SUMS, "n_best", "count_sum", "groups"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                n, size = b.column(5).to_numpy(), b.num_rows
                pairs = links(b, 7, n)
                told_, best, count = table.look_up(pairs)
                end = np.cumsum(n)
                sums = [np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[end], prepend=0) for x in (best, count)]
                # Pairs that are not told, once for each row with the number of their links in it.
                row, other = np.repeat(np.arange(size), n)[~told_], pairs[~told_]
                by = np.lexsort((other, row))
                row, other = row[by], other[by]
                first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(other, prepend=-1))
                times = np.diff(first, append=len(row))
                # No pair is below zero, so a row's own key meets none and does not make one hot task.
                to = np.concatenate([np.arange(size), row[first]])
                zeros = np.zeros(len(first), dtype=np.int64)
                own = [np.concatenate([x, zeros]) for x in (np.ones(size, dtype=np.int64), *(b.column(i).to_numpy() for i in range(2, 6)), *sums)]
                groups = pa.concat_arrays([b.column(6), pa.nulls(len(first), b.column(6).type)])
                columns = [pa.array(c, pa.int64()) for c in (np.concatenate([-1 - np.arange(at, at + size), other[first]]), np.concatenate([np.zeros(size, dtype=np.int64), times]), *own)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(to)), b.column(1).take(pa.array(to)), *columns, groups], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(measure, f"doc_id {kind}, h long, " + ", ".join(f"{c} long" for c in names[2:-1]) + ", groups string")
    joined = parts.join(counts, "pair", "left").withColumns({"n_best": F.col("n_best") + F.when(F.col("best"), F.col("k")).otherwise(0), "count_sum": F.col("count_sum") + F.col("k") * F.coalesce("count", F.lit(0))})
    by_row = joined.groupBy("doc_id", "h").agg(*[F.sum(c).alias(c) for c in names[4:-1]], F.max("groups").alias("groups"))
    each = [F.expr(f"{c} div copies").alias(c) for c in names[5:-1]]
    return by_row.select("doc_id", *each, "groups", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
