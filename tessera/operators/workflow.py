"""Review workflows: tags, notes and stages of candidates, runs, measures, sensitivity, profile checks and ranked look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes an audited event sensitive.
HIGH_PREFIXES = ("employer.auth.", "employer.team.", "employer.settings.", "employer.audit.")
MEDIUM_RESOURCES = ("candidate", "candidate_note", "candidate_tag", "candidate_stage", "send_queue", "send_queue_item", "outreach_campaign")
# Terms too general to be shown.
GENERIC_TERMS = (
    "engineer", "developer", "manager", "specialist", "lead", "intern", "analyst",
    "software", "platform", "cloud", "backend", "frontend", "fullstack", "full-stack",
    "senior", "junior", "mid", "staff", "principal", "associate", "consultant",
)
#: Terms shown at most.
SHOWN = 4


def rounded(value: Column, digits: int = 1) -> Column:
    """Half up, by the same arithmetic as floor(value * 10^digits + 0.5) / 10^digits."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def workflow(candidates: DataFrame, entries: DataFrame, key: str, kind: str, value: str, order: Sequence[str]) -> DataFrame:
    """Candidates with (tags, notes, last_note, stage): distinct tags in order, the number of notes, the last note and stage by order.

    entries: (key, kind, value, *order), kind one of tag, note, stage. One aggregation serves the three; only
    distinct tags are gathered, which a vocabulary bounds. Candidates without entries have no tags and no notes.
    """
    of = lambda k: F.when(F.col(kind) == k, F.col(value))
    last = lambda k: F.max_by(F.col(value), F.when(F.col(kind) == k, F.struct(*order)))
    found = entries.groupBy(key).agg(F.array_sort(F.collect_set(of("tag"))).alias("tags"), F.count_if(F.col(kind) == "note").alias("notes"), last("note").alias("last_note"), last("stage").alias("stage"))
    out = candidates.join(found, key, "left")
    return out.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "notes": F.coalesce("notes", F.lit(0))})


def status_counts(df: DataFrame, status: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows in all (total) and of each named status, in one row or one for each group; a null status counts in total alone."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == n).alias(n) for n in names])


def metrics(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name, n, total, mean) of each measure; nulls are no observations."""
    return df.groupBy(name).agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def mean_confidence(sure: Column, maybe: Column) -> Column:
    """Mean of all values of one array and the positive ones of another; null without any."""
    both = F.concat(F.filter(sure, lambda x: x.isNotNull()), F.filter(maybe, lambda x: x > 0))
    return F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.size(both))


def grouped_terms(df: DataFrame, category: str, terms: Column) -> DataFrame:
    """(category, terms): the distinct terms of each category, in order. Pairs are made distinct before they are gathered."""
    pairs = df.select(category, F.explode(terms).alias("term")).filter("term <> ''").distinct()
    return pairs.groupBy(category).agg(F.array_sort(F.collect_list("term")).alias("terms"))


def ready(statuses: Sequence[Column], vector: Column, within: Sequence[tuple[Column, Sequence]] = ()) -> Column:
    """All statuses are 'ready', the vector is there, and each column is one of its list, where the list is not empty."""
    out = vector.isNotNull()
    for s in statuses:
        out = out & (s == "ready")
    for c, values in within:
        if values:
            out = out & c.isin(list(values))
    return out


def sensitivity(event: Column, resource: Column) -> Column:
    """high by the event's prefix, medium by its resource, else low; nulls match nothing."""
    high = F.lit(False)
    for p in HIGH_PREFIXES:
        high = high | event.startswith(p)
    return F.when(high, "high").when(resource.isin(*MEDIUM_RESOURCES), "medium").otherwise("low")


def display_terms(terms: Column, limit: int = SHOWN) -> Column:
    """Terms without underscores and case, general and repeated ones left out, the first ones kept."""
    plain = F.transform(terms, lambda t: F.lower(F.trim(F.replace(t, F.lit("_"), F.lit(" ")))))
    return F.slice(F.array_distinct(F.filter(plain, lambda t: (t != "") & ~t.isin(*GENERIC_TERMS))), 1, limit)


def either_contains(left: Column, right: Column) -> Column:
    """Some text of one array contains one of the other, case-blind, either way round; false for empty arrays, nulls match nothing."""
    holds = lambda a, b: F.coalesce(F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)), F.lit(False))
    return F.coalesce(F.exists(left, lambda a: F.exists(right, lambda b: holds(a, b))), F.lit(False))


def checked(checks: dict[str, Column]) -> Column:
    """struct(score, missing): per cent of the checks that hold, and the names of the others in order; a null check does not hold."""
    held = {k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}
    score = F.lit(0)
    for c in held.values():
        score = score + c.cast("int")
    missing = F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in held.items()]))
    return F.struct(F.round(score * 100 / len(held)).cast("int").alias("score"), missing.alias("missing"))


def ranked_lookup(rows: DataFrame, key: str, candidates: Sequence[Column], catalog: DataFrame, on: str, value: str) -> DataFrame:
    """(key, rank, value): what the catalog holds for the first candidate that it knows, ranks from 1; keys without a match are absent.

    catalog: (on, value), each on once. Candidates are exploded and joined once, not once for each rank.
    """
    tried = F.array_distinct(F.array(*[F.struct(F.lit(i).alias("rank"), c.alias("on")) for i, c in enumerate(candidates, 1)]))
    asked = rows.select(key, F.inline(tried)).filter(F.col("on").isNotNull() & (F.col("on") != ""))
    known = asked.join(catalog.select(F.col(on).alias("on"), F.col(value).alias("value")), "on")
    return known.groupBy(key).agg(F.min(F.struct("rank", "value")).alias("first")).select(key, "first.rank", F.col("first.value").alias(value))
