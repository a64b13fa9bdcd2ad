"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document gets a rate (expected number of copies) r. Among all rates with 0 <= r <= CAP whose
words add up to the source's target, entropy balancing takes those nearest to 1 in relative entropy:
they are exponentially tilted, r = min(CAP, exp(lambda * size / scale)), one multiplier for each
source's token constraint. The dual is convex and its gradient in lambda is the constraint's error;
Newton steps, kept inside a bracket, solve it for all sources at once, each step one distributed sum.
A rate depends on source and size alone, so the steps run over the histogram (source, size, documents).
Rates are then rounded into whole copies: within a source and a block of ``WIDTH`` sizes, sizes in
falling order pass the words that rounding leaves over on to the next smaller size; what a block leaves
over goes to the source's block of smallest sizes, so that a source ends within about half of its
smallest document of its target where its small documents can take up what the others leave. A size's
copies go evenly to its documents, the remainder to those whose hashes are lowest.

Targets: sources by code point, null last, weigh ``WEIGHTS`` in turn, and share all words in
proportion; a target stops at CAP times its source's words and the excess is shared out again by
weight until none is above.

Edge cases: a null text has size 0, and size 0 takes 0 words (and one copy); a source without words has
target 0; ids may be null or repeat (ties are broken by a hash of the text; identical rows are
interchangeable); an empty table gives no rows; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 40
#: Largest error of a constraint, as a share of its target, at which the steps stop.
CLOSE = 1e-9
#: Parts into which the documents of one source and size are dealt for ranking.
SALTS = 64
#: Sizes that are rounded together; a fold's array is no longer than this.
WIDTH = 256
#: Sources up to which their multipliers are sent to every task; beyond, they are joined by a shuffle.
FEW = 100_000


def source_key(source: Column) -> Column:
    """A key without nulls that sorts like the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def few(rows: DataFrame) -> bool:
    """Whether a table of sources is small enough to be sent to every task."""
    return rows.limit(FEW + 1).count() <= FEW


def near(rows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rows) if small else rows


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add to each row the sums over the rows before it in order: inside ranges, moved on by the totals of the ranges before, so no task orders all rows."""
    dealt = checkpoint(rows.withColumns({f"{k}_own": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    totals = dealt.groupBy("range").agg(*[F.sum(f"{k}_own").alias(f"{k}_all") for k in sums])  # a row for each range
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("range", *[F.coalesce(F.sum(f"{k}_all").over(earlier), F.lit(0)).alias(f"{k}_base") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(base), "range")
    return joined.select(*rows.columns, *[(F.col(f"{k}_base") + F.coalesce(F.sum(f"{k}_own").over(inside), F.lit(0))).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (key, words), a row for each source: (key, words, target)."""
    placed = running(sizes.select("key", "words"), ["key"], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    # Sources reach their caps in the order of cap per weight: the share of a weight at which they do.
    level = F.when(F.col("words") > 0, cap * F.col("words") / weight).otherwise(0.0)
    levels = placed.select("key", "words", weight.alias("weight"), level.alias("level"))
    ordered = checkpoint(running(levels, ["level", "key"], {"capped": F.col("words") * cap, "weighed": F.col("weight")}))
    every = ordered.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    share = (F.lit(every["words"]) - F.col("capped")) / (F.lit(every["weight"]) - F.col("weighed"))
    # The first source whose cap lies above the share of what is left fixes the level of those after it.
    first = ordered.withColumn("share", share).filter("share <= level").agg(F.min(F.struct("level", "key", "share")).alias("f")).first()["f"]
    whole = (cap * F.col("words")).cast("double")
    if first is None:
        return ordered.select("key", "words", whole.alias("target"))
    at_cap = (F.col("level") < first["level"]) | ((F.col("level") == first["level"]) & (F.col("key") < first["key"]))
    return ordered.select("key", "words", F.when(at_cap, whole).otherwise(F.col("weight") * first["share"]).alias("target"))


def tilted(lam: Column, size: Column, scale: Column, cap: int) -> Column:
    """min(cap, exp(lam * size / scale)); cap for a null multiplier."""
    return F.coalesce(F.least(F.lit(float(cap)), F.exp(F.least(lam * size / scale, F.lit(50.0)))), F.lit(float(cap)))


def multipliers(hist: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """(key, scale, lam) from (key, size, docs) and (key, words, target): the dual's solution; lam is null where every rate is the cap."""
    size, docs = F.col("size").cast("double"), F.col("docs")
    scale = hist.groupBy("key").agg((F.sum(size * size * docs) / F.sum(size * docs)).alias("scale"))
    full = F.col("target") >= cap * F.col("words") * (1 - 1e-12)
    state = checkpoint(targets.filter("words > 0").join(scale, "key").select("key", "target", "scale", full.alias("full"), full.alias("done"), F.lit(0.0).alias("lam"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high")))
    small = few(state)
    lam, low, high = F.col("lam"), F.col("low"), F.col("high")
    for _ in range(steps):
        rate = tilted(lam, size, F.col("scale"), cap)
        sums = (
            hist.join(near(state.filter(~F.col("done")).select("key", "lam", "scale"), small), "key")
            .groupBy("key")
            .agg(F.sum(rate * size * docs).alias("got"), F.sum(F.when(rate < cap, rate * size * size / F.col("scale") * docs).otherwise(0.0)).alias("slope"))
        )
        error = F.col("got") - F.col("target")
        new_low, new_high = F.when(error > 0, low).otherwise(lam), F.when(error > 0, lam).otherwise(high)
        newton, reach = lam - error / F.col("slope"), 2 * F.abs(lam) + 4
        middle = (F.greatest(new_low, lam - reach) + F.least(new_high, lam + reach)) / 2
        step = F.when((F.col("slope") > 0) & (newton > new_low) & (newton < new_high), newton).otherwise(middle)
        go = ~F.col("done") & (F.abs(error) > CLOSE * F.col("target"))
        moved = state.join(near(sums, small), "key", "left").select("key", "target", "scale", "full", (~F.coalesce(go, F.lit(False))).alias("done"), F.when(go, step).otherwise(lam).alias("lam"), F.when(go, new_low).otherwise(low).alias("low"), F.when(go, new_high).otherwise(high).alias("high"))
        state = checkpoint(moved)
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("key", "scale", F.when(~F.col("full"), lam).alias("lam"))


def class_copies(hist: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """(key, size, docs, rate, copies): whole copies for all documents of a source and size together.

    A fold over a block's sizes, largest first, carries the words by which rounding has fallen short; the
    block of a source's smallest sizes is folded last and starts with what its other blocks leave over.
    """
    rate = tilted(F.col("lam"), F.col("size"), F.col("scale"), cap)
    rated = hist.join(near(solved, few(solved)), "key").select("key", F.floor(F.col("size") / WIDTH).alias("block"), (-F.col("size")).alias("order"), "docs", rate.alias("rate"))
    packed = checkpoint(rated.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("order", "docs", "rate"))).alias("sizes")))
    last = packed.groupBy("key").agg(F.min("block").alias("block")).withColumn("last", F.lit(True))
    marked = packed.join(last, ["key", "block"], "left")

    def folded(rows: DataFrame, carry: Column) -> DataFrame:
        start = F.struct(carry.cast("double").alias("carry"), F.array().cast("array<struct<size:bigint,docs:bigint,rate:double,copies:bigint>>").alias("out"))

        def pass_on(state, c):
            size = -c["order"]
            due = state["carry"] + c["rate"] * c["docs"] * size
            copies = F.greatest(F.lit(0).cast("long"), F.least(c["docs"] * cap, F.round(due / size).cast("long")))
            made = F.array(F.struct(size.alias("size"), c["docs"].alias("docs"), c["rate"].alias("rate"), copies.alias("copies")))
            return F.struct((due - copies * size).alias("carry"), F.concat(state["out"], made).alias("out"))

        return rows.select("key", F.aggregate("sizes", start, pass_on).alias("f"))

    large = checkpoint(folded(marked.filter("last is null"), F.lit(0.0)))
    over = large.groupBy("key").agg(F.sum("f.carry").alias("over"))
    small = folded(marked.filter("last").join(near(over, few(over)), "key", "left"), F.coalesce("over", F.lit(0.0)))
    return large.unionByName(small).select("key", F.explode("f.out").alias("c")).select("key", "c.size", "c.docs", "c.rate", "c.copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, keep: bool = False) -> DataFrame:
    """Rows of docs with mix_size, mix_source_size, mix_target, mix_rate and mix_copies.

    Beside them, keep: all columns of docs in a struct named row, which no name can clash with; else the id alone.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep else F.col(doc_id).alias("doc_id")
    own = "row" if keep else "doc_id"
    hashed = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.select(kept, source_key(F.col(source)).alias("mix_key"), word_count(F.col(text)).alias("mix_size"), hashed.alias("mix_hash")).withColumn("mix_salt", F.pmod(F.col("mix_hash"), F.lit(SALTS)))
    if not keep:
        rows = checkpoint(rows)  # narrow; all that follows reads it instead of the texts
    dealt = checkpoint(rows.groupBy("mix_key", "mix_size", "mix_salt").agg(F.count("*").alias("docs")))
    hist = checkpoint(dealt.groupBy(F.col("mix_key").alias("key"), F.col("mix_size").alias("size")).agg(F.sum("docs").alias("docs")))
    targets = checkpoint(source_targets(hist.groupBy("key").agg(F.sum(F.col("size") * F.col("docs")).alias("words")), weights, cap))
    some = hist.filter("size > 0")
    classes = class_copies(some, multipliers(some, targets, cap), cap)
    # Where the documents of each salt begin among those of their source and size.
    before = Window.partitionBy("mix_key", "mix_size").orderBy("mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    places = dealt.withColumn("mix_before", F.coalesce(F.sum("docs").over(before), F.lit(0))).drop("docs")
    info = classes.select(F.col("key").alias("mix_key"), F.col("size").alias("mix_size"), F.col("docs").alias("mix_docs"), F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_all"))
    salted = places.join(info, ["mix_key", "mix_size"], "left")
    goals = targets.select(F.col("key").alias("mix_key"), F.col("words").alias("mix_source_size"), F.col("target").alias("mix_target"))
    salted = checkpoint(salted.join(near(goals, few(goals)), "mix_key"))
    rank = F.row_number().over(Window.partitionBy("mix_key", "mix_size", "mix_salt").orderBy("mix_hash")) + F.col("mix_before")
    each = F.expr("mix_all div mix_docs")
    copies = F.coalesce(each + (rank <= F.col("mix_all") - each * F.col("mix_docs")).cast("long"), F.lit(1).cast("long"))
    ranked = rows.join(salted, ["mix_key", "mix_size", "mix_salt"]).withColumn("mix_copies", copies)
    return ranked.select(own, "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
