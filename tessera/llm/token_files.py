"""Token-ID files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

Documents are range-partitioned and sorted by id; each task encodes its documents and writes one
shard of three files into the shared folder: ``.ids`` (all token ids, unsigned little-endian, two
bytes each where the vocabulary fits in 65,536 ids, else four), ``.off`` (documents + 1 offsets into
it, unsigned 64-bit) and ``.doc`` (document ids, signed 64-bit; the least value stands for null). The
manifest has a row for each shard; prefix sums over its counts give each shard's base, so every
document's global start is base + offset. Shard names are unique for each attempt and only the
attempts that succeed are in the manifest, so a lost executor or a retried task leaves no trace.

Edge cases: a null text is an empty one and gets the end id alone; null document ids come first;
equal ids are ordered by a hash of the text and then the text, so repeated rows each keep an entry;
an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import trim
from tessera.llm.common import fresh_dir

NULL_ID = -(1 << 63)
#: Documents encoded at a time.
BATCH = 256
MANIFEST = "shard int, path string, width int, docs long, tokens long, base long, first_doc long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(fs: pafs.FileSystem, path: str, arrays: list[np.ndarray]) -> None:
    with fs.open_output_stream(path) as out:
        for a in arrays:
            out.write(a.tobytes())


def map_file(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, read where it is not."""
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if fs.get_file_info(path).size else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


#: Chunks whose ids a worker remembers at most, and how many stay when there are more.
CACHE, KEPT = 600_000, 400_000
#: New chunks that the library encodes as one text.
JOINED = 2000
#: A space that does not stand right before a character other than white space.
LOOSE = re.compile(r" (?=\s|\Z)")


class ChunkEncoder:
    """The ids of whole texts from a byte-level tokenizer of the tokenizers library, chunk by chunk.

    Its splitting rule binds a space to the word after it, so a text can be cut before every space that a
    character other than white space follows; the ids of the chunks, joined, are those of the text. The
    library encodes each distinct chunk once. Texts that hold a special token go to the library whole.
    """

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer

        j = json.loads(spec)
        self.tok = Tokenizer.from_str(spec)
        self.whole = j["normalizer"] is not None or j["pre_tokenizer"]["type"] != "ByteLevel" or not j["pre_tokenizer"]["use_regex"] or j["pre_tokenizer"]["add_prefix_space"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in j["added_tokens"]) or r"(?!)")
        self.width = 2 if max(self.tok.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        self.end = end_id.to_bytes(self.width, "little")
        self.known: dict[str, bytes] = {}
        #: Bytes of each id's token, which has a character for each byte.
        vocab = j["model"]["vocab"]
        self.sizes = np.zeros(max(self.tok.get_vocab_size(with_added_tokens=True), max(vocab.values(), default=0) + 1), np.int64)
        for t, i in vocab.items():
            self.sizes[i] = len(t)

    def _library(self, texts: list[str]) -> list[bytes]:
        kind = {2: "H", 4: "I"}[self.width]
        return [array(kind, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, each behind a space: many as one text, cut where the bytes of its tokens come to the chunks' ends."""
        out: list[bytes] = []
        for at in range(0, len(chunks), JOINED):
            some = chunks[at : at + JOINED]
            line = " " + " ".join(some)
            ids = np.array([] if self.special.search(line) else self.tok.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
            ends = np.cumsum(np.fromiter((len(c) + 1 if c.isascii() else len(c.encode()) + 1 for c in some), np.int64, len(some)))
            reached = np.cumsum(self.sizes[ids])
            last = np.searchsorted(reached, ends) + 1
            if not len(ids) or reached[-1] != ends[-1] or not np.array_equal(reached[last - 1], ends):
                out += self._library([" " + c for c in some])
                continue
            data, stops = ids.tobytes(), (last * self.width).tolist()
            out += [data[a:z] for a, z in zip([0, *stops], stops, strict=False)]
        return out

    def _cut(self, text: str) -> tuple[str, list[str]]:
        """The first chunk, and the others without the space that each starts with."""
        if self.whole or self.special.search(text):
            return text, []
        first, *rest = text.split(" ")
        if not LOOSE.search(text):
            return first, rest
        out = [first]
        for p in rest:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out[0], out[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as bytes."""
        cut = [self._cut(t) for t in texts]
        known = self.known
        trim(known, CACHE, KEPT)
        new = list(set().union(*[rest for _, rest in cut]).difference(known))
        known.update(zip(new, self._chunks(new), strict=True))
        of = known.__getitem__
        out = [first + b"".join(map(of, rest)) + self.end for first, (_, rest) in zip(self._library([f for f, _ in cut]), cut, strict=True)]
        for c in new:
            if len(c) > 64:
                del known[c]
        return out


_CHUNKERS: dict[tuple[int, int], ChunkEncoder] = {}


def chunk_encoder(spec: str, end_id: int) -> ChunkEncoder:
    """One encoder for each worker, vocabulary and end id; what it remembers outlives a task."""
    key = hash(spec), end_id
    if key not in _CHUNKERS:
        _CHUNKERS[key] = ChunkEncoder(spec, end_id)
    return _CHUNKERS[key]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, where: str | None = None, shards: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents; the manifest, one row for each shard, with bases, in document order."""
    spark = docs.sparkSession
    where = where or fresh_dir(spark, "tokens")
    fs, root = open_fs(where)
    fs.create_dir(root, recursive=True)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocab = spark.sparkContext.broadcast(f.read())
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(shards, *keys[:2]).sortWithinPartitions(*keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder = chunk_encoder(vocab.value, end_id)
        width = encoder.width
        shard = TaskContext.get().partitionId()
        name = f"{where}/part-{shard:06d}-{uuid.uuid4().hex}"
        fs, path = open_fs(name)
        out, sizes, ids = None, [], []
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                if out is None:
                    out = fs.open_output_stream(path + ".ids")
                some = b.slice(at, BATCH)
                got = encoder.encode(some.column(1).to_pylist())
                sizes += [len(g) // width for g in got]
                out.write(b"".join(got))
                ids.append(some.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        off = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        _put(fs, path + ".off", [off])
        _put(fs, path + ".doc", [np.concatenate(ids).astype("<i8")])
        row = {"shard": [shard], "path": [name], "width": [width], "docs": [len(sizes)], "tokens": [int(off[-1])], "first_doc": [int(ids[0][0])]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first_doc", pa.int64())]))

    done = ordered.mapInArrow(encode, "shard int, path string, width int, docs long, tokens long, first_doc long").collect()  # a row for each shard
    base, manifest = 0, []
    for r in sorted(done, key=lambda r: r["shard"]):
        manifest.append((r["shard"], r["path"], r["width"], r["docs"], r["tokens"], base, r["first_doc"]))
        base += r["tokens"]
    return spark.createDataFrame(manifest, MANIFEST)


def read(manifest: DataFrame) -> Iterator:
    """For tasks: (row, document ids, offsets, token ids) of each row of a pandas batch of the manifest, as memory-mapped arrays."""
    for r in manifest.itertuples():
        yield r, map_file(r.path + ".doc", "<i8"), map_file(r.path + ".off", "<u8"), map_file(r.path + ".ids", f"<u{r.width}")


def documents(spark: SparkSession, manifest: DataFrame, fold, schema: str) -> DataFrame:
    """Apply fold(doc_id or None, global start, ids as a memory-mapped array) -> tuple to every document of the files, a task for each shard."""

    def scan(batches):
        import pandas as pd

        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for pdf in batches:
            for r, doc, off, ids in read(pdf):
                rows = []
                for k in range(r.docs):
                    a, z = int(off[k]), int(off[k + 1])
                    rows.append(fold(None if doc[k] == NULL_ID else int(doc[k]), r.base + a, ids[a:z]))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    shards = max(1, manifest.count())
    return manifest.repartition(shards).mapInPandas(scan, schema)
