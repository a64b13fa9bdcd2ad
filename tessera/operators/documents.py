"""Document identity and quality: fingerprints, near-duplicate versions, language, redaction, retention."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize

BITS = 64
#: Bytes of a text whose words are held at a time, about; hashes of words that a task remembers at most; hashes that meet a block at a time.
PIECE, KNOWN, ROWS = 1 << 20, 200_000, 32
#: Similarities from which two documents are the same, a new version of a person's document, or related.
SAME, UPDATED, RELATED = 0.995, 0.82, 0.72
# Days for which each kind of artifact is kept; others are kept like parsed output.
RETENTION_DAYS = {"raw_document": 30, "parsed_output": 180, "audit_log": 365, "redacted_artifact": 365, "cache_entry": 14}
# What the redaction of contact data looks for.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
URL = r"(?i)https?://[^\s]+"
PHONE = r"(?:(?:\+|00)\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?){2,4}\d{2,4}"


def content_text(text: Column) -> Column:
    """Normalised text in lower case, letter by letter: a sigma at a word's end is one like any other, a dotted capital i is an i."""
    return F.lower(F.replace(F.replace(normalize(text), F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def has_words(text: Column) -> Column:
    """Whether a text holds anything but white space, told by its first such character; null for a null text."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def tokens(text: Column) -> Column:
    return F.filter(F.split(content_text(text), " "), lambda t: t != "")


def simhash(words: Column) -> Column:
    """64-bit SimHash as 16 hex digits: per bit, more ones than zeros (or as many) among the sha256 hashes of the words."""
    bits = F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 49, 16), 16, 2))
    padded = F.transform(bits, lambda b: F.lpad(b, BITS, "0"))
    at = lambda i: F.aggregate(padded, F.lit(0), lambda s, b: s + F.when(F.substring(b, i, 1) == "1", 1).otherwise(-1))
    return F.concat(*[_nibble([at(4 * k + j + 1) for j in range(4)]) for k in range(BITS // 4)])


def _nibble(sums: Sequence[Column]) -> Column:
    value = F.lit(0)
    for s in sums:
        value = value * 2 + F.when(s >= 0, 1).otherwise(0)
    return F.lower(F.hex(value.cast("long")))


def _ones(data: bytes, known: dict[bytes, bytes]) -> tuple[int, np.ndarray]:
    """Words of a folded text, and how many of their hashes have each bit, the highest first; known: hashes met so far."""
    n, ones, at = 0, np.zeros(BITS, np.int64), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = end if end > 0 else len(data)
        words = [w for w in data[at:end].split(b" ") if w]
        if len(known) > KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = sha256(w).digest()[24:]
        found = np.frombuffer(b"".join([known[w] for w in words]), np.uint8).reshape(-1, 8)
        n, ones, at = n + len(words), ones + np.unpackbits(found, axis=1).sum(axis=0, dtype=np.int64), end
    return n, ones


def word_votes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """SimHash of texts: (key, simhash); a row's votes are counted where it lies, a piece of its words at a time, and summed per key."""
    rows = docs.select(key, content_text(F.col(text)).cast("binary").alias("_text"))
    names = ["_n", *[f"_s{b}" for b in range(BITS // 2)]]

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for b in batches:
            counts, sums = np.zeros(b.num_rows, np.int64), np.zeros((BITS, b.num_rows), np.int64)
            for row, t in enumerate(b.column(1)):
                if t.is_valid:
                    counts[row], sums[:, row] = _ones(t.as_buffer().to_pybytes(), known)
            # Two counters of ones in each sum, 32 bits apart: those of bit b and of bit b + 32.
            both = sums[: BITS // 2 - 1 : -1] + (sums[BITS // 2 - 1 :: -1] << 32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), *map(pa.array, both)], [key, *names])

    found = rows.mapInArrow(votes, f"`{key}` {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))
    summed = found.groupBy(key).agg(*[F.sum(c).alias(c) for c in names])
    low = lambda b: F.col(f"_s{b}").bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda b: F.shiftrightunsigned(F.col(f"_s{b}"), 32)
    vote = lambda b: 2 * (low(b) if b < BITS // 2 else high(b - BITS // 2)) - F.col("_n")
    return summed.select(key, F.concat(*[_nibble([vote(b) for b in range(BITS - 1 - 4 * k, BITS - 5 - 4 * k, -1)]) for k in range(BITS // 4)]).alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return (F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))).cast("int")


def relation(similarity: Column, same_bytes: Column, same_person: Column) -> Column:
    return (
        F.when(same_bytes | (similarity >= SAME), "exact_duplicate")
        .when(same_person & (similarity >= UPDATED), "updated_version")
        .when(similarity >= RELATED, "related_variant")
        .otherwise("unrelated")
    )


def _block_pairs(left: DataFrame, right: DataFrame, group: str, once: bool) -> DataFrame:
    """Every block of a group beside every block, each pair in a task of its own key: left.* and right.* with prefixes own_ and all_.

    left, right: (group, block, blocks, arrays). once: of two blocks only the pair in which the left one is not the later.
    """
    spark = left.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = F.col("blocks") - 1
    named = lambda df, prefix: [F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in (group, "block", "blocks")]
    own = left.select(group, F.col("block").alias("_i"), F.explode(F.sequence(F.col("block") if once else F.lit(0).cast("long"), last)).alias("_j"), *named(left, "own_"))
    every = right.select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") if once else last)).alias("_i"), F.col("block").alias("_j"), *named(right, "all_"))
    # A number of partitions of its own: the blocks are few bytes for what they cost, so they must not be taken together by size.
    return own.repartition(parts, group, "_i", "_j").join(every.repartition(parts, group, "_i", "_j"), [group, "_i", "_j"])


def _blocks(hashed: DataFrame, group: str, block: int) -> DataFrame:
    """hashed with block and blocks: its rows of a group dealt to blocks of about so many by their hash h."""
    large = hashed.groupBy(group).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")).filter("blocks > 1")  # a row for a block at most
    return hashed.join(F.broadcast(large), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")))


def nearest_hashes(hashed: DataFrame, group: str, key: str, block: int = 8192) -> DataFrame:
    """(group, h, distance, nearest) of the rows with own = true: the closest other hash h of the group, the lowest key of equals.

    hashed: (group, h, key, own), each h once in a group. Every row meets all others of its group, block
    against block, and a block gives one row for each hash: no pair is ever a row.
    """
    dealt = _blocks(hashed, group, block)
    packed = lambda df: df.groupBy(group, "block", "blocks").agg(F.array_sort(F.collect_list(F.struct(key, "h"))).alias("_all")).select(group, "block", "blocks", F.col(f"_all.{key}").alias("keys"), F.col("_all.h").alias("h"))
    pairs = _block_pairs(packed(dealt.filter("own")).drop("keys"), packed(dealt), group, False).select(group, "own_h", "all_keys", "all_h")

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                own, keys, every = (np.asarray(b.column(c)[row].values) for c in ("own_h", "all_keys", "all_h"))
                distance, nearest = np.empty(len(own), np.int32), np.empty(len(own), np.int64)
                for at in range(0, len(own), ROWS):
                    bits = np.bitwise_count(own[at : at + ROWS, None].view(np.uint64) ^ every[None, :].view(np.uint64))
                    bits -= np.uint8(1)  # the hash itself becomes the farthest
                    first = bits.argmin(axis=1)
                    distance[at : at + ROWS], nearest[at : at + ROWS] = bits[np.arange(len(first)), first].astype(np.int32) + 1, keys[first]
                kept = distance <= BITS
                yield pa.RecordBatch.from_arrays([pa.array([b.column(group)[row].as_py()] * int(kept.sum()), b.schema.field(group).type), pa.array(own[kept]), pa.array(distance[kept]), pa.array(nearest[kept])], [group, "h", "distance", "nearest"])

    kind = dict(hashed.dtypes)[group]
    found = pairs.mapInArrow(closest, f"{group} {kind}, h long, distance int, nearest long")
    best = found.groupBy(group, "h").agg(F.min(F.struct("distance", "nearest")).alias("_b"))
    return best.select(group, "h", "_b.distance", "_b.nearest")


def near_pairs(hashed: DataFrame, group: str, key: str, radius: int, block: int = 8192) -> DataFrame:
    """(group, left_hash, right_hash, left_<doc>, right_<doc>, document_pairs, distance): all pairs of different hashes of a group within the radius.

    hashed: (group, key, simhash as 16 hex digits). Equal hashes are one row, with their number and least key, so a
    group of copies of any size adds nothing. Hashes of texts crowd on few values of any of their bits, so equal joins on
    bands of bits would make far more rows than there are pairs; instead blocks of hashes meet, each two of
    them once, a task holds two blocks at a time, and only pairs within the radius become rows.
    """
    name = key.removesuffix("_id")
    rows = hashed.filter(F.col(group).isNotNull()).groupBy(group, "simhash").agg(F.count("*").alias("documents"), F.min(key).alias("first"))
    dealt = _blocks(rows.withColumn("h", F.expr("cast(conv(simhash, 16, -10) as long)")), group, block)
    fields = ("simhash", "h", "documents", "first")
    packed = dealt.groupBy(group, "block", "blocks").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_all")).select(group, "block", "blocks", *[F.col(f"_all.{c}").alias(c) for c in fields])
    kinds = dict(rows.dtypes)
    names = [group, "left_hash", "right_hash", f"left_{name}", f"right_{name}", "document_pairs", "distance"]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(names, (kinds[group], "string", "string", kinds["first"], kinds["first"], "long", "int"), strict=True))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                of = {f"{side}_{c}": b.column(f"{side}_{c}")[row].values for side in ("own", "all") for c in fields}
                own, every = (np.asarray(of[f"{side}_h"]).view(np.uint64) for side in ("own", "all"))
                same = b.column("_i")[row].as_py() == b.column("_j")[row].as_py()
                for at in range(0, len(own), ROWS):
                    bits = np.bitwise_count(own[at : at + ROWS, None] ^ every[None, :])
                    i, j = np.divmod(np.flatnonzero(bits <= radius), len(every))
                    distance, i = bits[i, j].astype(np.int32), i + at
                    # Within one block both orders come, and each hash with itself: the ascending order counts.
                    if same:
                        up = own[i] < every[j]
                        i, j, distance = i[up], j[up], distance[up]
                    swapped = own[i] > every[j]
                    sides = {side: {c: of[f"{side}_{c}"].take(pa.array(k)) for c in ("simhash", "documents", "first")} for side, k in (("own", i), ("all", j))}
                    turned = pa.array(swapped)
                    pick = lambda c, a, z: pc.if_else(turned, sides[z][c], sides[a][c])  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(b.column(group)[row], len(i)), pick("simhash", "own", "all"), pick("simhash", "all", "own"), pick("first", "own", "all"), pick("first", "all", "own"),
                         pc.multiply(sides["own"]["documents"], sides["all"]["documents"]), pa.array(distance)], names,
                    )

    return _block_pairs(packed, packed, group, True).mapInArrow(meet, schema)


def best_versions(docs: DataFrame, key: str, person: str) -> DataFrame:
    """(key, previous, similarity): the most similar of all other documents of the same person, the lowest key of equals.

    docs: (key, person, simhash); null where a person has no other document. The relation grows with
    the similarity, so that the most similar is also the best by relation, then similarity; equal bytes
    have equal hashes.
    """
    docs = docs.select(key, person, F.expr("cast(conv(simhash, 16, -10) as long)").alias("h"))
    two = docs.withColumn("_place", F.row_number().over(Window.partitionBy(person, "h").orderBy(key))).filter("_place <= 2")
    groups = two.groupBy(person, "h").agg(F.min(key).alias("_first"), F.max(key).alias("_second"))
    alone = F.col("_first") == F.col("_second")
    near = nearest_hashes(groups.select(person, "h", F.col("_first").alias(key), alone.alias("own")), person, key)
    known = groups.join(near, [person, "h"], "left")
    previous = F.when(alone, F.col("nearest")).when(F.col(key) == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    similarity = F.when(alone, 1 - F.col("distance") / BITS).otherwise(1.0)
    return docs.join(known, [person, "h"], "left").select(key, previous.alias("previous"), similarity.alias("similarity")).withColumn("similarity", F.when(F.col("previous").isNotNull(), F.col("similarity")))


def person_fingerprint(name: Column, email: Column, phone: Column) -> Column:
    """sha256 of what is known of a person; null when nothing is."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")
    parts = ((("name"), F.lower(normalize(name))), ("email", F.lower(F.trim(F.coalesce(email, F.lit(""))))), ("phone", F.right(digits, F.lit(10))))
    joined = F.concat_ws("|", *[F.when(v != "", F.concat(F.lit(f"{k}:"), v)) for k, v in parts])
    return F.when(joined != "", F.sha2(joined, 256))


def language(text: Column, markers: dict[str, Sequence[str]], fallback: str) -> Column:
    """The language with the most marker words in the text; the first of equals, fallback where none occurs."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:!?]+", "  "), F.lit(" "))
    count = lambda w: F.floor((F.length(words) - F.length(F.replace(words, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
    scores = []
    for name, some in markers.items():
        total = F.lit(0).cast("long")
        for w in some:
            total = total + count(w)
        scores.append((name, total))
    best = F.greatest(*[s for _, s in scores])
    found = F.lit(fallback)
    for name, s in reversed(scores):
        found = F.when((best > 0) & (s == best), name).otherwise(found)
    return found


def retention(kind: Column, created: Column, now: Column) -> Column:
    """struct(expires_at, disposition, remaining_days, reason)."""
    days = F.coalesce(F.create_map(*[F.lit(x) for kv in RETENTION_DAYS.items() for x in kv])[kind], F.lit(RETENTION_DAYS["parsed_output"]))
    expires = created + F.make_dt_interval(days)
    gone = now >= expires
    left = F.greatest(F.lit(0), F.floor((F.unix_timestamp(expires) - F.unix_timestamp(now)) / 86400))
    return F.struct(expires.alias("expires_at"), F.when(gone, "expire").otherwise("keep").alias("disposition"), left.cast("long").alias("remaining_days"), F.concat(kind, F.when(gone, "_retention_elapsed").otherwise("_retention_active")).alias("reason"))


def redact(text: Column) -> Column:
    """Links, e-mail addresses and runs of digits that look like phone numbers replaced by their kind, in that order."""
    out = F.regexp_replace(text, URL, "[REDACTED_URL]")
    out = F.regexp_replace(out, EMAIL, "[REDACTED_EMAIL]")
    return F.regexp_replace(out, PHONE, "[REDACTED_PHONE]")


def quality_metrics(text: Column) -> list[Column]:
    """Counts and ratios by which a text is judged."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))  # noqa: E731  without regular expressions
    share = lambda chars: F.round(count(chars) / n, 6)
    words = F.regexp_count(t, F.lit(r"[^ \t\n\r\x0b\x0c]+"))
    return [
        F.length(t).alias("characters"), words.cast("long").alias("words"), share(ascii_letters).alias("letters"), share(digits).alias("digits"), share(" \t\n\r").alias("spaces"),
        share("#$%&*@|<>{}~^").alias("symbols"), count("\n").cast("long").alias("breaks"), F.round((F.length(t) - count(" \t\n\r\x0b\x0c")) / F.greatest(words, F.lit(1)), 6).alias("word_length"),
    ]


def quality_band(words: Column, letters: Column, symbols: Column, word_length: Column) -> Column:
    good = (words >= 30).cast("int") + (letters >= 0.6).cast("int") + (symbols <= 0.05).cast("int") + word_length.between(2.5, 12).cast("int")
    return F.when(good >= 4, "high").when(good >= 2, "medium").otherwise("low")


def parse_plan(new: DataFrame, cached: DataFrame, key: str, section: str, digest: str) -> DataFrame:
    """(key, plan, reused, sections): EXACT_HIT when all section digests are cached, PARTIAL_REUSE when some are, else MISS."""
    hits = new.join(cached.select(key, section, digest).distinct().withColumn("hit", F.lit(1)), [key, section, digest], "left")
    summed = hits.groupBy(key).agg(F.count("hit").alias("reused"), F.count("*").alias("sections"))
    return summed.withColumn("plan", F.when(F.col("reused") == F.col("sections"), "EXACT_HIT").when(F.col("reused") > 0, "PARTIAL_REUSE").otherwise("MISS"))
