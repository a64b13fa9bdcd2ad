"""Divergence of sources by two-dimensional group-block tiling.

Within each language, every source is compared with every other over the language's kept terms. A
source's counts are packed, a row for each chunk of the vocabulary; the sources are dealt into
blocks, and each row is sent to the tiles (block by block) in which its block takes part. A tile's task
takes the chunks one after another, turns the counts of its two blocks into integer probabilities and
adds up the differences of all its pairs in a submatrix. Tiles are also cut by spans of chunks, so a
language with few sources still uses many tasks; the partial submatrices are then added.

Tasks count terms before the first shuffle. A term that a source lacks has a probability too, so every
group has a row for every chunk. Memory of a tile: 2 * BLOCK groups by SPAN chunks of packed counts, one
chunk of them unpacked. All arithmetic is on integers: products by 10^9 are divided in steps of a thousand.

Edge cases: null texts, languages and sources are empty ones; a group without terms, or in a language
without kept terms, is there with sums of zero; repeated rows count again (a row is a document); a source
alone in its language has no pairs; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint

#: Terms of a chunk, groups of a block, chunks of a tile's span.
CHUNK, BLOCK, SPAN = 4096, 16, 8
#: Distinct terms that a task counts before it hands them on.
HELD = 400_000
#: Languages or groups up to which a table of them is sent to every task; beyond, it is joined by a shuffle.
FEW = 100_000
SCALE_STEPS, STEP = 3, 1000
#: Bytes of UTF-8 to themselves where they belong to terms (capitals to small letters), all others to a space.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GROUP = ["lang", "source"]


def terms(data: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased."""
    return data.translate(TERMS).split()


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs), partial counts: occurrences in a source (docs 0), and documents in the language (source null, n 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
        seen: dict[tuple, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (a, b), c in seen.items():
                k, words = len(c), pa.array([*c], pa.binary()).cast(pa.string())
                counts, none = pa.array(c.values(), pa.int64()), pa.array(np.zeros(k, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.repeat(a, k), pa.repeat(pa.scalar(b, pa.string()), k), words, *((none, counts) if b is None else (counts, none))], schema=schema)
            seen.clear()

        for batch in batches:
            for t, a, b in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = terms(t.as_buffer().to_pybytes())
                seen[a, b].update(found)
                seen[a, None].update(set(found))
            if sum(map(len, seen.values())) > HELD:
                yield from out()
        yield from out()

    given = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    rows = given.select(F.col("text").cast("binary").alias("text"), "lang", "source")
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def probability(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * counts / total) without products beyond 64 bits."""
    whole, rest = np.divmod(counts, total)
    for _ in range(SCALE_STEPS):
        more, rest = np.divmod(rest * STEP, total)
        whole = whole * STEP + more
    return whole + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile_sums(table: pa.Table) -> pa.Table:
    """Sums over the chunks of one tile: (lang, a, b, value) for the pairs of a group of the first block and one of the second.

    table: (lang, source, block, one, two, chunk, width, total, place, n); total: the divisor of the group's probabilities.
    """
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    block, chunk = table.column("block").to_numpy(), table.column("chunk").to_numpy()
    names, totals = table.column("source").to_pylist(), table.column("total").to_pylist()
    groups = {b: sorted({names[i] for i in np.flatnonzero(block == b)}) for b in {one, two}}
    sums = np.zeros((len(groups[one]), len(groups[two])), dtype=np.int64)
    for c in np.unique(chunk):
        dense = {}
        for b in groups:
            at = {names[i]: i for i in np.flatnonzero((block == b) & (chunk == c)).tolist()}
            dense[b] = np.empty((len(groups[b]), table.column("width")[at[groups[b][0]]].as_py()), dtype=np.int64)
            for row, name in enumerate(groups[b]):
                i = at[name]
                counts = np.full(dense[b].shape[1], 2, dtype=np.int64)
                counts[table.column("place")[i].values.to_numpy()] += table.column("n")[i].values.to_numpy()
                dense[b][row] = probability(counts, max(totals[i], 1))
        for row in range(len(groups[one])):
            sums[row] += difference(dense[one][row], dense[two]).sum(axis=1)
    a, b = np.triu_indices(len(groups[one]), 1) if one == two else map(np.ravel, np.indices(sums.shape))
    left, right = ([groups[g][i] for i in at] for g, at in ((one, a), (two, b)))
    lang = pa.repeat(table.column("lang")[0], len(left))
    return pa.table({"lang": lang, "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "value": pa.array(sums[a, b], pa.int64())})


def few(df: DataFrame) -> DataFrame:
    """A table of languages or groups, marked to be sent to every task if its counted rows are few."""
    return F.broadcast(df) if df.count() <= FEW else df


class Counts:
    """What the texts of a table say of its groups; every table written once."""

    def __init__(self, docs: DataFrame, least_docs: int, text: str, lang: str, source: str):
        counted = checkpoint(term_counts(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
        kept = checkpoint(kept.select("lang", "term", "in_lang"))
        every = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
        langs = every.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n")), "lang", "left")
        langs = langs.fillna(0).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("v") / CHUNK)).cast("long"))
        #: (lang, v, lang_n, chunks): kept terms, their occurrences, chunks of the vocabulary.
        self.langs = checkpoint(langs)
        dealt = kept.join(few(self.langs.select("lang", "chunks")), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
        #: (lang, term, in_lang, chunk, place): kept terms and their places.
        self.kept = checkpoint(dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).drop("chunks"))
        own = counted.filter("source is not null").select("lang", "source", "term", "n")
        #: (lang, source, term, n, in_lang, chunk, place): kept terms that occur in a group.
        self.cells = checkpoint(own.join(self.kept, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang", "chunk", "place"))
        sums = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        groups = every.join(sums, GROUP, "left").fillna(0, ["n"]).join(self.langs, "lang")
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        #: (lang, source, total, lang_total, block): divisors of the probabilities; a group's pairs are as many as these rows of its language.
        self.groups = checkpoint(groups.select("lang", "source", (F.col("n") + 2 * F.col("v")).alias("total"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_total"), F.floor(place / BLOCK).cast("int").alias("block")))


def pair_divergence(c: Counts) -> DataFrame:
    """(lang, a, b, value): every two sources of a language, once."""
    width = c.kept.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
    chunks = c.langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).join(width, ["lang", "chunk"], "left").fillna(0, ["width"])
    cell = F.collect_list(F.struct("place", "n"))
    packed = c.cells.groupBy("lang", "source", "chunk").agg(cell.alias("cells"))
    blocks = c.groups.groupBy("lang").agg(F.max("block").alias("last"))
    rows = c.groups.join(chunks, "lang").join(packed, ["lang", "source", "chunk"], "left").join(blocks, "lang")
    none = F.array().cast("array<struct<place:int,n:long>>")
    rows = rows.withColumn("cells", F.coalesce("cells", none)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select(
        "lang", "source", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "chunk", F.floor(F.col("chunk") / SPAN).alias("span"),
        "width", "total", F.col("cells.place").alias("place"), F.col("cells.n").alias("n"),
    )
    tiles = rows.groupBy("lang", "one", "two", "span").applyInArrow(tile_sums, "lang string, a string, b string, value long")
    return tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def term_divergence(c: Counts, most: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source has more of than its language, the most different first."""
    p, q = (F.expr(f"1 + cast((cast({n} as decimal(20, 0)) + 2) * 1000000000 div {t} as long)") for n, t in (("n", "total"), ("in_lang", "lang_total")))
    cells = c.cells.filter("n > 0").join(few(c.groups.drop("block")), GROUP).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    found = cells.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def audit(docs: DataFrame, least_docs: int = 10, most_terms: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): 'pair' compares a source with each other one, 'term' lists its own terms."""
    c = Counts(docs, least_docs, text, lang, source)
    once = pair_divergence(c)
    pairs = once.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(once.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(term_divergence(c, most_terms).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
