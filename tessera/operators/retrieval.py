"""Chunks, embeddings, exact search and context packing for retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import token_estimate

#: Largest chunk in characters, and paragraphs that the next chunk repeats.
CHUNK, OVERLAP = 1200, 1
# Characters that neighbouring chunks share, at least and at most, to be joined without a repeat.
SHARED = (32, 240)
#: What a context holds at most: items, characters, tokens, characters of an item; and the least characters of an item.
ITEMS, CHARACTERS, TOKENS, PER_ITEM, LEAST = 5, 4000, 800, 1200, 32


def paragraphs(text: Column) -> Column:
    unified = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return F.filter(F.transform(F.split(unified, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """array<struct<first, last>> of paragraph ranges: packed up to size characters, each starting with the last ``overlap`` paragraphs of the one before (all of them, if it has fewer).

    An ordered fold in one expression; its state holds the open range and the closed ones.
    """
    ranges = "array<struct<first:int,last:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("length"), F.array().cast(ranges).alias("out"))

    def fold(lengths):
        def step(s, n):
            held = s["at"] - s["first"]
            grown = s["length"] + F.when(held > 0, 2).otherwise(0) + n
            closes = (held > 0) & (grown > size)
            again = F.greatest(s["first"], s["at"] - overlap)
            repeated = F.aggregate(F.slice(lengths, again + 1, s["at"] - again), F.lit(0), lambda total, x: total + x + 2)
            closed = F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last"))))
            return F.struct((s["at"] + 1).alias("at"), F.when(closes, again).otherwise(s["first"]).alias("first"), F.when(closes, repeated + n).otherwise(grown).alias("length"), F.when(closes, closed).otherwise(s["out"]).alias("out"))

        def finish(s):
            return F.when(s["at"] == 0, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last")))))

        return F.aggregate(lengths, start, step, finish)

    return bound(F.transform(paragraphs(text), lambda p: F.length(p)), fold)


def chunk_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_index, first, last, content, tokens) of every text."""
    cut = docs.select(key, paragraphs(F.col(text)).alias("_p"), F.posexplode(chunks(F.col(text))).alias("chunk_index", "_r"))
    content = F.array_join(F.slice("_p", F.col("_r.first") + 1, F.col("_r.last") - F.col("_r.first") + 1), "\n\n")
    return cut.select(key, "chunk_index", F.col("_r.first").alias("first"), F.col("_r.last").alias("last"), content.alias("content")).withColumn("tokens", token_estimate(F.col("content")))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def embedding(text: Column, dimensions: int = 16) -> Column:
    """Deterministic unit vector from sha256 digests of counter and text; zeros for a blank text."""
    digests = F.concat(*[F.sha2(F.concat(F.lit(f"{k}:"), text), 256) for k in range(-(-dimensions // 8))])
    words = lambda hexes: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(hexes, 8 * i + 1, F.lit(8)), 16, 10).cast("double") / 4294967295.0 * 2.0 - 1.0)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = bound(bound(digests, words), lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / n))))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(blank, F.array_repeat(F.lit(0.0), dimensions)).otherwise(unit)


def cosine(a: Column, b: Column) -> Column:
    """0 when a vector has no length; null when their sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    ratio = lambda v: F.when(v["n"] == 0, 0.0).otherwise(v["d"] / v["n"])
    of = lambda p: bound(F.struct(dot(p["a"], p["b"]).alias("d"), (F.sqrt(dot(p["a"], p["a"])) * F.sqrt(dot(p["b"], p["b"]))).alias("n")), ratio)
    return F.when(F.size(a) == F.size(b), bound(F.struct(a.alias("a"), b.alias("b")), of))


def search(items: DataFrame, query: Column, vector: str, key: str, k: int, least: float | None = None) -> DataFrame:
    """The k items most similar to one query vector, ties to the smaller key; k is the feature."""
    scored = items.withColumn("similarity", cosine(F.col(vector), query))
    # What the conditions leave is the beginning of the order, so they come last: before, they would be pushed below and compute every vector twice.
    best = scored.orderBy(F.desc_nulls_last("similarity"), key).limit(k)
    return best.filter(F.col("similarity").isNotNull() if least is None else F.col("similarity") >= least)


def filtered_search(items: DataFrame, query: Column, vector: str, key: str, k: int, least: float, where: Column) -> DataFrame:
    """The k items most similar to a query vector among those that meet a condition, with the number of such items before the least similarity counts."""
    candidates = items.filter(where)
    total = candidates.count()
    return search(candidates, query, vector, key, k, least).withColumn("total_candidates", F.lit(total).cast("long"))


def adjacent(hits: DataFrame, document: str, index: str, window: int = 1) -> DataFrame:
    """Hits with the number of their run: neighbours in a document at most window apart belong together."""
    order = Window.partitionBy(document).orderBy(index)
    gap = F.col(index) - F.lag(index).over(order)
    return hits.withColumn("run", F.sum(F.when(gap <= window, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def merged(hits: DataFrame, document: str, index: str, content: str, window: int = 1) -> DataFrame:
    """One row for each run: best and mean similarity, its chunks, contents joined in order."""
    runs = adjacent(hits, document, index, window)
    parts = F.array_sort(F.collect_list(F.struct(index, content)))
    grouped = runs.groupBy(document, "run").agg(F.max("similarity").alias("best"), F.avg("similarity").alias("mean"), F.count("*").alias("chunks"), F.min(index).alias("first"), parts.alias("_parts"))
    return grouped.withColumn("content", F.aggregate("_parts", F.lit(""), lambda s, p: joined_text(s, F.coalesce(p[content], F.lit(""))))).drop("_parts")


def signature(content: Column) -> Column:
    """A content without case and spacing."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(content, F.lit(""))), r"\s+", " "))


def joined_text(left: Column, right: Column) -> Column:
    """Two texts as one: what the first ends and the second begins with stands once, the longest such part of SHARED; else a blank line between them."""
    pair = F.struct(F.regexp_replace(left, r"\s+$", "").alias("a"), F.regexp_replace(right, r"^\s+", "").alias("b"))

    def join(p):
        a, b = p["a"], p["b"]
        both = F.filter(F.sequence(F.lit(SHARED[1]), F.lit(SHARED[0]), F.lit(-1)), lambda n: (n <= F.length(a)) & (n <= F.length(b)) & (F.right(a, n) == F.left(b, n)))
        rest = F.substr(b, F.coalesce(F.get(both, F.lit(0)), F.lit(0)) + 1)
        return F.when(a == "", b).when((b == "") | (signature(a) == signature(b)), a).when(F.size(both) > 0, F.concat(a, rest)).otherwise(F.concat(a, F.lit("\n\n"), b))

    return bound(pair, join)


def without_repeats(items: DataFrame, content: str, order: Sequence[Column]) -> DataFrame:
    """The first item in order of each content, compared without case and spacing."""
    same = signature(F.col(content))
    placed = items.withColumn("_k", F.row_number().over(Window.partitionBy(same).orderBy(*order))).filter(same != "")
    return placed.filter("_k = 1").drop("_k")


def packed(items: DataFrame, query: str, order: Sequence[str], content: str) -> DataFrame:
    """(query, place, content, cut): items in order, cut to fit, as long as the budgets of a context last.

    The items of one query are few (they come from a top-k search), so they are folded in one array.
    """
    every = items.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(*order, content))).alias("_all"))
    out = "array<struct<content:string,cut:boolean>>"
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("tokens"), F.array().cast(out).alias("out"))

    def step(s, item):
        text = F.trim(item[content])
        room = F.least(F.lit(PER_ITEM).cast("long"), CHARACTERS - s["chars"])
        by_tokens = F.floor(F.length(text) * ((TOKENS - s["tokens"]) / F.greatest(token_estimate(text), F.lit(1)))).cast("long")
        most = F.when(token_estimate(text) > TOKENS - s["tokens"], F.least(room, by_tokens)).otherwise(room)
        short = F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), (most - 1).cast("int"))), F.lit("…")))
        fits = (F.size(s["out"]) < ITEMS) & (most >= LEAST)
        return F.struct(
            F.when(fits, s["chars"] + F.length(short)).otherwise(s["chars"]).alias("chars"),
            F.when(fits, s["tokens"] + token_estimate(short)).otherwise(s["tokens"]).alias("tokens"),
            F.when(fits, F.concat(s["out"], F.array(F.struct(short.alias("content"), (short != text).alias("cut"))))).otherwise(s["out"]).alias("out"),
        )

    return every.select(query, F.posexplode(F.aggregate("_all", start, step)["out"]).alias("place", "_i")).select(query, "place", "_i.content", "_i.cut")


def ingest_plan(new: DataFrame, stored: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, action, version): skip empty texts, nothing for equal checksums, else replace with the next version."""
    joined = new.join(stored.select(key, F.col(checksum).alias("_old"), F.col("version").alias("_v")), key, "left")
    action = F.when(F.col(checksum).isNull(), "skipped").when(F.col("_old") == F.col(checksum), "noop").when(F.col("_old").isNull(), "created").otherwise("replaced")
    return joined.withColumn("action", action).select(key, "action", F.when(F.col("action") == "replaced", F.col("_v") + 1).otherwise(F.coalesce("_v", F.lit(1))).alias("version"))
