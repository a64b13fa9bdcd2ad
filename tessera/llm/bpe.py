"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can end its encoding. An automaton over the
vocabulary yields, for each prefix, the tokens that are its suffixes, longest first; the first one
that is compatible with the last token of the prefix before it is stored. Following these
back-pointers from the end gives the ids that merging in rank order would give.

Two tokens are compatible when no merge across their border happens before the merges that build
them: along the right edge of the first and the left edge of the second, each part lives from its
own merge until the merge that absorbs it, and a border merge takes place if both parts still live
at its rank (between equal ranks the left place goes first).

Edge cases: a null text is an empty one and has no ids; special tokens written in a text become
their ids; a run of any length is encoded whole, in linear time.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back

#: Distinct white-space-free chunks, and distinct pieces, whose ids a worker remembers at most, and how many stay when there are more.
CACHE, KEPT = 120_000, 80_000
NEVER = 1 << 40
#: Texts whose results are held at a time.
TEXTS = 256
#: White space as the tokenizer's rule has it; characters that Python alone also takes for white space.
WHITE = regex.compile(r"\s+")
CONTROL = regex.compile(r"[\x1c-\x1f]")
#: Marks the last symbol of a piece; byte symbols lie below it.
END = 0x1000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}


def trim(cache: dict, most: int, kept: int) -> None:
    """Forget the newest entries of a full cache: frequent ones have come early."""
    if len(cache) > most:
        for k in list(islice(reversed(cache), len(cache) - kept)):
            del cache[k]


class DecodeTable:
    """The token of each id of a tokenizer file; all that decoding needs."""

    def __init__(self, spec: dict):
        token = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        size = max(token) + 1
        self.words = pa.array([token.get(i, "") for i in range(size)], pa.string())
        self.has = np.array([i in token for i in range(size)])

    def decode_all(self, arrays: pa.ListArray) -> pa.Array:
        """For each array its tokens joined by a space, as a tokenizer file without a decoder has it; unknown ids are left out; null for null."""
        parts = [self._decode(arrays.slice(k, 500)) for k in range(0, len(arrays), 500)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def _decode(self, arrays: pa.ListArray) -> pa.Array:
        ids = arrays.flatten().to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < len(self.words)) & self.has[np.clip(ids, 0, len(self.words) - 1)] if len(ids) else np.empty(0, bool)
        sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.concatenate([[0], np.cumsum(known)])[ends]
        words = self.words.take(pa.array(ids[known]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), words), " ")
        return pc.if_else(arrays.is_valid(), joined, pa.scalar(None, pa.string()))


class PrefixEncoder:
    """Encodes and decodes with the vocabulary, merges and text rules of a tokenizer file (word ends, lower case)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.table = DecodeTable(j)
        self.piece = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.bytes = [byte_symbols()[b] for b in range(256)]
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        made = self._edges(model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]])
        self.automaton = ahocorasick.Automaton()
        for i, t in made.items():
            s = self.symbols(t)
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()

    def symbols(self, token: str) -> str:
        """One character for each symbol; the one that ends a word is moved up by END."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            t = token[: -len(self.suffix)]
            return t[:-1] + chr(ord(t[-1]) + END)
        return token

    def _edges(self, vocab: dict[str, int], merges: list[list[str]]) -> dict[int, str]:
        """The tokens that merging can make, by id; sets of each its first and last part and the rank of its merge.

        The parts on an edge are a chain: the token, its part on that edge, that part's part, and so on, each
        absorbed at the rank of the token before it.
        """
        size = max(vocab.values(), default=-1) + 1
        self.first, self.last, self.built = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(merges) if a in vocab and b in vocab}
        made = {vocab[t + e]: t + e for t in self.bytes for e in ("", self.suffix) if t + e in vocab}
        for r, (a, b) in enumerate(merges):
            whole = a[: -len(self.suffix)] + b if self.suffix and a.endswith(self.suffix) else a + b
            i, x, y = vocab.get(whole, -1), vocab.get(a, -1), vocab.get(b, -1)
            # Parts come before wholes; a second way to write a token never takes place.
            if i < 0 or self.built[i] >= 0 or x not in made or y not in made or whole != a + b:
                continue
            if self._meet(x, y) != r:
                continue
            self.first[i], self.last[i], self.built[i] = x, y, r
            made[i] = whole
        return made

    def _meet(self, a: int, b: int) -> int | None:
        """Rank of the first merge across the border of two tokens, None where there is none."""
        best, gone_a = None, NEVER
        while a >= 0:
            c, gone_c = b, NEVER
            while c >= 0:
                r = self.rank.get(a << 20 | c)
                if r is not None and r < gone_a and r <= gone_c and (best is None or r < best):
                    best = r
                c, gone_c = self.first[c], self.built[c]
            a, gone_a = self.last[a], self.built[a]
        return best

    def _fit(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * CACHE:
                self.fits.clear()
            known = self.fits[key] = self._meet(a, b) is None
        return known

    def encode_symbols(self, s: str) -> list[int]:
        """Ids of one piece, written as symbols."""
        n, fits = len(s), self.fits
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for at, (token, k) in self.automaton.iter(s):
            end = at + 1
            if size[end]:
                continue
            if k < end:
                before = last[end - k]
                if before < 0:
                    continue
                fit = fits.get(before << 20 | token)
                if fit is None:
                    fit = self._fit(before, token)
                if not fit:
                    continue
            last[end], size[end] = token, k
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode_piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            s = piece if piece.isascii() and piece.isprintable() else "".join([self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")])
            ids = array("i", self.encode_symbols(s[:-1] + chr(ord(s[-1]) + END) if self.suffix else s)).tobytes()
            if len(piece) < 64:
                trim(self.pieces, CACHE, KEPT)
                self.pieces[piece] = ids
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        if chunk.isascii():
            text = chunk.lower()
            if text.isalpha():
                return self.encode_piece(text)
        else:
            text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return b"".join(map(self.encode_piece, self.piece.findall(text)))

    def _plain(self, text: str) -> bytes:
        chunks = WHITE.split(text) if CONTROL.search(text) else text.split()
        cache = self.cache
        trim(cache, CACHE, KEPT)
        new = set(chunks).difference(cache)
        for c in new:
            cache[c] = self.encode_chunk(c)
        out = b"".join(map(cache.__getitem__, chunks))
        for c in new:
            if len(c) > 64:
                del cache[c]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as native 32-bit integers."""
        if self.split_special is None or "<" not in text:
            return self._plain(text)
        return b"".join([array("i", [self.special[part]]).tobytes() if part in self.special else self._plain(part) for part in self.split_special.split(text)])

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        ends, flat = [0], []
        for t in texts:
            ids = self.encode_bytes(t.as_py())
            flat.append(ids)
            ends.append(ends[-1] + len(ids) // 4)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), dtype=np.int32)))

    def decode(self, ids: list[int]) -> str:
        return self.table.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


_KEPT: dict[tuple, PrefixEncoder | DecodeTable] = {}


def _kept(kind: type, shared):
    """One encoder or table for each worker and vocabulary; an encoder's cache outlives a task."""
    key = kind, hash(shared.value)
    if key not in _KEPT:
        give_back()  # what the worker's stages before have freed
        _KEPT[key] = kind(shared.value) if kind is PrefixEncoder else kind(json.loads(shared.value))
        give_back()  # what reading the file took
    return _KEPT[key]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast of a tokenizer file, a few MB whatever the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(vocab, text: Column) -> Column:
    """array<int> of the ids of a whole text; vocab: from vocabulary()."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return _kept(PrefixEncoder, vocab).encode_all(texts)

    # Not folded into the expressions over it, which would encode once for each of them.
    return encoded.asNondeterministic()(F.coalesce(text, F.lit("")))


def decode_column(vocab, ids: Column) -> Column:
    """Decoded text of an array of ids; null for a null array."""

    @F.arrow_udf("string")
    def decoded(arrays: pa.Array) -> pa.Array:
        return _kept(DecodeTable, vocab).decode_all(arrays)

    return decoded(ids)


def round_trip_column(vocab, text: Column) -> Column:
    """struct(ids array<int>, decoded string) of a whole text: both directions in one Python evaluation, so one worker and one vocabulary for each core."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        enc = _kept(PrefixEncoder, vocab)
        ids = enc.encode_all(texts)
        return pa.StructArray.from_arrays([ids, enc.table.decode_all(ids)], names=["ids", "decoded"])

    return both.asNondeterministic()(F.coalesce(text, F.lit("")))


def round_trips(enc: PrefixEncoder, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches with a number of ids, the ids and the decoded text in place of the text, at most TEXTS rows at a time.

    Workers wait for later tasks and stages: what a batch took is given back before the next one.
    """
    for whole in batches:
        others = [c for c in whole.schema.names if c != text]
        for at in range(0, whole.num_rows, TEXTS):
            b = whole.slice(at, TEXTS)
            ids = enc.encode_all(b.column(text))
            made = [pc.list_value_length(ids).cast(pa.int64()), ids, enc.table.decode_all(ids)]
            yield pa.RecordBatch.from_arrays([*map(b.column, others), *made], [*others, "n_tokens", "ids", "decoded"])
            del b, ids, made
        del whole
        give_back()


def round_trip(docs: DataFrame, vocab, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids and decoded: both directions in one pass, whose results leave a worker in small batches.

    As a column the results of a whole Arrow batch (10,000 rows by default) would be held at once, in the worker and in the executor.
    """
    rows = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInArrow(lambda batches: round_trips(_kept(PrefixEncoder, vocab), batches, text), f"{kept}, n_tokens long, ids array<int>, decoded string")
