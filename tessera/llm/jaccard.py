"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Each whole text is the set of its distinct n-word shingles (64-bit hashes). Documents with equal sets
form a class. In one global order of shingles (the rare ones by hash, then those that a share of
the documents shows to be frequent, by frequency) the first ``size - ceil(t * size) + COMMON`` shingles
are a set's prefix. Two sets of similarity t must share so many shingles of their prefixes as they must
share at all, less those behind the prefix that ends first. Classes with identical prefix and size
collapse into one group. The prefixes of groups are exploded and shuffled by shingle; pairs of groups
are formed and filtered by size, number of prefix shingles that others have, and the places of a shingle in
both sets (the first that two similar sets share has enough of either set from it on); the pairs that remain
are expanded to the groups' members, and those are verified on the whole texts.

Links are wanted up to connectivity, so no pair inside a component is verified: rounds of stars (each
shingle's groups against one of them, the members of a group against its first) join what is alike,
linear in the prefixes; then every remaining pair of groups with members in different components
is expanded to all its members in different components, so no link between components is lost. Order
and sample steer the work only, never the result.

Hot keys: rows of a shingle that the sample shows to be held by many are salted, by group, into
``SALTS`` parts; what is found for a shingle is aggregated before the shuffle and sent back to each part;
pairs are met within bands of sizes; and a text that many pairs need goes to several tasks, once for each
``PAIRS`` of them.

Edge cases: a null text, or one without words, is an empty set and linked with nothing; a text of
fewer than n words is one shingle, its whole sequence; repeated rows and equal texts share a component;
a component's id is its smallest document id, nulls apart (null where all are); ids keep their type; an
empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, free_names, most_frequent

#: Share of the documents whose shingles are counted to order the frequent ones last.
SAMPLE_SHARE = 0.2
#: By how many shingles, less one, prefixes are longer than needed to meet once.
COMMON = 3
#: Classes up to which a table of them is sent to every task; beyond, it is joined by a shuffle.
FEW = 500_000
#: Sampled documents that hold a frequent shingle, at least, and how many such shingles are told to the tasks, at most.
FREQUENT, TOLD = 4, 500_000
STARS = 1
#: Sampled documents from which a shingle counts as hot, and parts that its rows are dealt into.
HOT, SALTS = 50, 64
#: Groups of a hot shingle that one part takes on its divided side, while there are fewer than SALTS parts.
MEET = 256
#: Pairs that one copy of a text serves, about.
PAIRS = 32
_MULTIPLY = 0xD6E8FEB86659FD93
_INVERSE = pow(_MULTIPLY, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_PLACE = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _MULTIPLY, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, ASCII letters in lower case, cut at ASCII white space."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = powers(1 << max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k * 0x51ED2701, dtype=np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _PLACE[i]
    return np.unique(mixed(h))


def needed(size: int, num: int, den: int) -> int:
    """Least common shingles with any partner, for a set of this size."""
    return -(-num * size // den)


def frequent_shingles(docs: DataFrame, n: int, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles in a hash-chosen sample, their places by rising frequency, and which of them are hot."""
    some = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(SAMPLE_SHARE * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = set(b.column(0).to_pylist())  # copies say nothing about order
            found = [shingles(t, n) for t in texts]
            h, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            more = c > 1
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[more].view(np.int64)), "n": pa.array(c[more])})

    counted = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = most_frequent(checkpoint(counted), "n", TOLD).toArrow()  # at most TOLD rows
    h = top.column("h").to_numpy().view(np.uint64) if top.num_rows else np.empty(0, np.uint64)
    seen = top.column("n").to_numpy() if top.num_rows else np.empty(0, np.int64)
    by_hash = np.argsort(h)
    place = np.empty(len(h), dtype=np.int64)
    place[np.lexsort((h, seen))] = np.arange(len(h))
    return h[by_hash], place[by_hash], (seen >= HOT)[by_hash]


def signed(docs: DataFrame, order, n: int, num: int, den: int, doc_id: str, text: str, prefixes: bool) -> DataFrame:
    """Of each row of docs, by an order of shingles that was sent to the tasks: (gid, n, prefix, hot), or else (doc_id, row, cid, n, gid).

    cid: hash of the set, null for an empty one; gid: hash of its prefix and size; row: hash of the text; hot:
    which shingles of the prefix are; place: how many shingles of the set come before it.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place, many = order.value
        short = lambda b: int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                cids, sizes, gids, found, hot = [], [], [], [], []
                for t in b.column(2).to_pylist():
                    s = shingles(t, n)
                    sizes.append(len(s))
                    found.append(s[:0])
                    hot.append(np.zeros(0, dtype=bool))
                    if not len(s):
                        cids.append(None)
                        gids.append(None)
                        continue
                    rising, crowd = s, np.zeros(len(s), dtype=bool)
                    if len(common):
                        i = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        often = common[i] == s
                        if often.any():
                            last = np.flatnonzero(often)[np.argsort(place[i[often]])]
                            rising = np.concatenate([s[~often], s[last]])
                            crowd[len(s) - len(last) :] = many[i[last]]
                    size = len(s) - needed(len(s), num, den) + COMMON
                    found[-1], hot[-1] = rising[:size], crowd[:size]
                    cids.append(short(s.tobytes()))
                    gids.append(short(found[-1].tobytes() + len(s).to_bytes(8, "little")))
                if prefixes:
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in found])]), pa.int32())
                    places = np.concatenate([np.arange(len(p), dtype=np.int32) for p in found])
                    flat = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(hot)), pa.array(places)], names=["shingle", "hot", "place"]))
                    yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), flat], names=["gid", "prefix"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gids, pa.int64())], names=["doc_id", "row", "cid", "n", "gid"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "gid long, prefix array<struct<shingle:long,hot:boolean,place:int>>" if prefixes else f"doc_id {kind}, row long, cid long, n long, gid long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) with comp the least node of each connected component, from (a, b); alternating large and small stars."""
    links = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        # Done when every component is a star: no node hangs on two others, or on one and has one below it.
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1 and below > 0").isEmpty():
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = checkpoint(small)
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def verified(pairs: DataFrame, texts: DataFrame, heavy: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of classes whose texts are similar enough.

    texts: (cid, text, parts); heavy: (cid, parts) of the classes of many pairs, whose texts are sent once for each
    part of their pairs, to different tasks.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(cid: int, column, i: int) -> np.ndarray:
            s = kept.get(cid)
            if s is None:
                if len(kept) >= 64:
                    kept.clear()
                s = kept[cid] = shingles(column[i].as_py(), n)
            return s

        for b in batches:
            a_id, b_id = b.column(0).to_pylist(), b.column(1).to_pylist()
            hit = np.zeros(b.num_rows, dtype=bool)
            for i, (a, c) in enumerate(zip(a_id, b_id, strict=True)):
                x, y = of(a, b.column(2), i), of(c, b.column(3), i)
                common = len(x) + len(y) - len(np.union1d(x, y))
                hit[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit)), b.column(1).filter(pa.array(hit))], names=["a", "b"])

    sent = texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = pairs
    for key, other in (("a", "b"), ("b", "a")):
        many = heavy.select(F.col("cid").alias(key), F.col("parts").alias(f"{key}_parts"))
        part = F.pmod(F.xxhash64(other), F.coalesce(f"{key}_parts", F.lit(1))).cast("int")
        rows = rows.join(many, key, "left").withColumn(f"{key}_part", part)
    for key in ("a", "b"):
        rows = rows.join(sent.select(F.col("cid").alias(key), F.col("part").alias(f"{key}_part"), F.col("text").alias(f"{key}_text")), [key, f"{key}_part"])
    return rows.select("a", "b", "a_text", "b_text").mapInArrow(test, "a long, b long")


def ceil_div(x: Column, y: int) -> Column:
    return F.floor((x + (y - 1)) / y)


class Filters:
    """What two groups must fulfil by sizes and shared prefix shingles so that members can link."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def fits(self, a: str, b: str) -> Column:
        """Sizes of two sets allow the similarity."""
        return self.den * F.least(a, b) >= self.num * F.greatest(a, b)

    def enough(self, a: str, b: str) -> Column:
        """Shingles that the prefixes of two similar sets share at least: what both must share, less what the set whose prefix ends first has behind it."""
        both = ceil_div(self.num * (F.col(a) + F.col(b)), self.num + self.den)
        behind = F.greatest(F.lit(0), ceil_div(self.num * F.greatest(a, b), self.den) - COMMON)
        return F.greatest(F.lit(1), both - behind)

    def reach(self, a: str, b: str, place_a: str, place_b: str) -> Column:
        """A shingle at these places can be the first that two similar sets share: all that they share lies from there on in both."""
        both = ceil_div(self.num * (F.col(a) + F.col(b)), self.num + self.den)
        return F.least(F.col(a) - F.col(place_a), F.col(b) - F.col(place_b)) >= both

    def band(self, size: Column) -> Column:
        """Sizes that fit each other lie in the same or in neighbouring bands (the width is rounded up, so that rounding loses none)."""
        return F.floor(F.log(size) / (math.log(self.den / self.num) + 1e-9)).cast("int")


def stars(live: DataFrame, turn: int, f: Filters) -> DataFrame:
    """Pairs (a, b) of first members: each shingle's groups against one of them, where both groups can link and are in different components."""
    # First the groups whose prefixes are the most common: of copies with different edits, the text they come from.
    first = (-F.col("common") / F.col("n")) if turn == 0 else F.lit(0.0)
    hub = F.min(F.struct(first.alias("o"), F.xxhash64("gid", F.lit(turn)).alias("t"), "gid", "n", "common", "rep", "comp")).alias("hub")
    hubs = live.groupBy("shingle").agg(hub, F.min("lo").alias("least"), F.max("hi").alias("most"), F.max("hot").alias("any_hot"))
    hubs = hubs.filter("least <> most").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("any_hot"), SALTS - 1).otherwise(0))))
    made = live.join(hubs.select("shingle", "salt", "hub"), ["shingle", "salt"]).select("rep", "n", "comp", "common", F.col("hub.rep").alias("rep2"), F.col("hub.n").alias("n2"), F.col("hub.comp").alias("comp2"), F.col("hub.common").alias("common2"))
    can = (F.col("comp") != F.col("comp2")) & f.fits("n", "n2") & (F.least("common", "common2") >= f.enough("n", "n2"))
    # A hub stands for some of the shingles that a pair shares; only the last turn counts them all.
    least = F.least(F.lit(COMMON), f.enough("n", "n2"))
    return made.filter(can).groupBy(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).agg(F.count("*").alias("k"), F.first(least).alias("least")).filter("k >= least").select("a", "b")


def group_pairs(live: DataFrame, f: Filters) -> DataFrame:
    """(g, g2, k, k2, rep, rep2): pairs of groups that can share enough shingles, have fitting sizes, and members in different components.

    A pair is formed only at shingles that can be the first that both share: a shingle that many copies of a text
    have, each behind edits of its own, would otherwise pair all copies that are not in one component.
    """
    several = live.groupBy("shingle").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.max("hot").alias("any_hot"), F.count("*").alias("m")).filter("least <> most")
    # A hot shingle's groups are met in as many parts as their number asks for; each part needs one side whole.
    parts = F.when(F.col("any_hot"), F.least(F.lit(SALTS), F.ceil(F.col("m") / MEET))).otherwise(1).cast("int")
    salts = several.withColumn("parts", parts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("any_hot"), SALTS - 1).otherwise(0)))).select("shingle", "salt", "parts")
    open_ = live.join(salts, ["shingle", "salt"]).withColumn("salt", F.pmod("salt", "parts"))
    columns = ("gid", "n", "common", "k", "rep", "lo", "hi", "place")
    big = open_.select("shingle", "salt", f.band(F.col("n")).alias("band"), *columns)
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    small = open_.withColumn("salt", every_part).withColumn("band", F.explode(F.array(f.band(F.col("n")), f.band(F.col("n")) + 1)))
    small = small.select("shingle", "salt", "band", *[F.col(c).alias(f"{c}2") for c in columns])
    apart = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("gid") > F.col("gid2")))
    same = (F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))
    can = apart & ~same & f.fits("n", "n2") & f.reach("n", "n2", "place", "place2") & (F.least("common", "common2") >= f.enough("n", "n2"))
    met = big.join(small, ["shingle", "salt", "band"]).filter(can)
    return met.groupBy("gid", "gid2").agg(*[F.first(c).alias(c) for c in ("k", "k2", "rep", "rep2")])


def expanded(pairs: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members in different components, of pairs of groups and of single groups; members: (gid, cid, comp) of groups with several."""
    one, two = (members.select(F.col("gid").alias(g), F.col("cid").alias(c), F.col("comp").alias(q)) for g, c, q in (("gid", "x", "p"), ("gid2", "y", "q")))
    single = pairs.filter("k = 1 and k2 = 1").select(F.col("rep").alias("x"), F.col("rep2").alias("y"))
    crowded = pairs.filter("k > 1 or k2 > 1").select("gid", "gid2", "rep", "rep2").join(one, "gid", "left").join(two, "gid2", "left")
    crowded = crowded.select(F.coalesce("x", "rep").alias("x"), F.coalesce("y", "rep2").alias("y"), "p", "q").filter("p is null or q is null or p <> q").select("x", "y")
    inner = groups.filter("k > 1 and lo <> hi").select("gid", F.col("gid").alias("gid2")).join(one, "gid").join(two, "gid2").filter("p <> q and x < y").select("x", "y")
    return single.unionByName(crowded).unionByName(inner).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, n_shingles, component_id, comp), a row for each row of docs.

    row: xxhash64 of the text; comp: a label of the component that needs no ids, null for an empty set.
    """
    f = Filters(num, den)
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n, text))
    # The texts are signed twice: keeping the prefixes of all documents would take more room than the texts.
    rows = checkpoint(signed(docs, order, n, num, den, doc_id, text, prefixes=False))
    classes = checkpoint(rows.filter("cid is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.first("n").alias("n"), F.first("gid").alias("gid")))
    held = signed(docs, order, n, num, den, doc_id, text, prefixes=True).select("gid", F.explode("prefix").alias("p")).select("gid", "p.shingle", "p.hot", "p.place")
    held = held.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("gid"), F.lit(SALTS)).cast("int")).otherwise(0))
    groups = held.repartition("shingle", "salt").dropDuplicates(["shingle", "salt", "gid"])  # copies count once; no further shuffle
    counted = groups.withColumn("holders", F.count("*").over(Window.partitionBy("shingle", "salt")))
    shared = checkpoint(counted.filter("holders > 1 or hot").select("shingle", "salt", "hot", "gid", "place"))
    # k: classes of a group; common: how many shingles of its prefix others have, so the most that a pair's prefixes can share.
    alive = classes.groupBy("gid").agg(F.count("*").alias("k")).join(shared.groupBy("gid").agg(F.count("*").alias("common")), "gid", "left").filter("common > 0 or k > 1")
    members = checkpoint(classes.join(alive, "gid").select("gid", "cid", "n", "k", "common"))
    source = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    label, tested = members.select("cid", F.col("cid").alias("comp")), None

    def join_up(label: DataFrame, pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
        wanted = checkpoint(used.join(classes.select("cid", "rep"), "cid").select("cid", "parts", "rep.doc_id", "rep.row"))
        sizes = wanted.agg(F.count("*"), F.count_if(F.col("parts") > 1)).first()
        small = lambda df, size: F.broadcast(df) if size <= FEW else df
        own = source["d"].eqNullSafe(wanted["doc_id"]) & (source["h"] == wanted["row"])
        texts = checkpoint(source.join(small(wanted, sizes[0]), own).select("cid", "parts", "text").dropDuplicates(["cid"]))  # one for each class
        links = verified(pairs, texts, small(wanted.filter("parts > 1").select("cid", "parts"), sizes[1]), n, num, den)
        own = links.join(label.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), "a").join(label.select(F.col("cid").alias("b"), F.col("comp").alias("cb")), "b")
        merged = components(own.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        return checkpoint(label.join(merged, label["comp"] == merged["node"], "left").select("cid", F.coalesce(merged["comp"], label["comp"]).alias("comp")))

    for turn in range(STARS + 1):
        named = members.join(label, "cid")
        state = named.groupBy("gid").agg(F.min(F.struct("cid", "comp")).alias("first"), *[F.first(c).alias(c) for c in ("n", "k", "common")], F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        state = checkpoint(state.select("gid", "n", "k", "common", "lo", "hi", F.col("first.cid").alias("rep"), F.col("first.comp").alias("comp")))
        live = shared.join(state, "gid")
        if turn < STARS:
            pairs = stars(live, turn, f)
            if turn == 0:  # the members of a group against its first
                inner = members.filter("k > 1").select("gid", "cid").join(state.select("gid", "rep"), "gid").filter("cid <> rep")
                pairs = pairs.unionByName(inner.select(F.least("cid", "rep").alias("a"), F.greatest("cid", "rep").alias("b"))).distinct()
        else:
            pairs = expanded(checkpoint(group_pairs(live, f)), state, members.filter("k > 1").select("gid", "cid").join(label, "cid"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = checkpoint(pairs)
        if pairs.isEmpty():
            continue
        label = join_up(label, pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)

    known = classes.select("cid").join(label, "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"))
    # A class's first id may be null beside others; its least one counts.
    ids = rows.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    least = known.join(ids, "cid").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = known.join(least, "comp").select("cid", "comp", "component_id")
    out = rows.join(named, "cid", "left")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "comp")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that deduplication keeps, with all their columns.

    Of each component stays the row with the least id (null first), then the least hash of its text, one of
    identical rows; rows without words all stay.
    """
    made = free_names(docs, "jaccard_null", "jaccard_id", "jaccard_row")
    found = jaccard_components(docs, n, num, den, doc_id, text)
    least = found.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "row")).alias("k"))
    # Keys without nulls, so that the join and the removal of identical rows share one shuffle.
    kept = least.select((~F.col("k.given")).alias(made[0]), F.coalesce(F.col("k.doc_id").cast("string"), F.lit("")).alias(made[1]), F.col("k.row").alias(made[2]))
    key = F.col(doc_id).cast("string")
    keyed = docs.withColumns({made[0]: key.isNull(), made[1]: F.coalesce(key, F.lit("")), made[2]: F.xxhash64(text)})
    empty = ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stay = keyed.filter(~empty).join(kept, made, "left_semi").dropDuplicates(made)
    return stay.unionByName(keyed.filter(empty)).drop(*made)
