"""Text, URL and rule functions on columns; none needs Python on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]

# The labels and key words of the rules, in the order in which they are tried.
EMPLOYMENT_RULES: Rules = (
    ("internship", ("intern", "internship", "staj")),
    ("contract", ("contract", "contractor", "freelance", "consultant")),
    ("part_time", ("part time", "part-time", "yarı zamanlı", "yari zamanli")),
    ("temporary", ("temporary", "temp", "fixed term", "fixed-term")),
    ("full_time", ("full time", "full-time", "tam zamanlı", "tam zamanli")),
)
SENIORITY_RULES: Rules = (
    ("executive", ("chief ", "chief-", "vp", "vice president", "cxo", "cto", "ceo", "cfo", "coo")),
    ("director", ("director", "head of", "head ")),
    ("principal", ("principal", "staff ")),
    ("lead", ("lead", "team lead", "manager")),
    ("senior", ("senior", "sr.", "sr ")),
    ("junior", ("junior", "jr.", "jr ", "entry level", "entry-level")),
    ("intern", ("intern", "internship", "staj")),
)
WORKPLACE_RULES: Rules = (
    ("hybrid", ("hybrid",)),
    ("remote", ("remote",)),
    ("onsite", ("on-site", "onsite", "office", "in person", "sahada", "yerinde")),
)
# Ranks of seniority, words that are no key words, and the shares that a description's length counts.
SENIORITY_RANK = {"intern": 1, "junior": 2, "mid": 3, "senior": 4, "lead": 5, "principal": 6, "director": 7, "executive": 8}
STOPWORDS = (
    "a", "an", "and", "at", "be", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with", "role", "position", "job", "team", "teams", "work", "working",
    "lead", "senior", "junior", "mid", "level", "full", "time", "part", "remote", "hybrid",
)
COMPLETENESS_STEPS = ((1200, 1.0), (700, 0.92), (350, 0.82), (180, 0.68), (80, 0.52), (1, 0.35))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize(text: Column) -> Column:
    """White space, separators of files, groups, records and units among it, collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def fold(text: Column) -> Column:
    """Normalised text without case."""
    return F.replace(F.lower(normalize(text)), F.lit("ß"), F.lit("ss"))


def strip_html(text: Column) -> Column:
    """Text without tags, normalised; null when nothing is left."""
    return bound(normalize(F.regexp_replace(normalize(text), "<[^>]+>", " ")), lambda out: F.when(out != "", out))


def any_of(haystack: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(haystack, F.lit(w))
    return found


def first_rule(haystack: Column, rules: Rules) -> Column:
    """Label of the first rule that has a key word in the text; null where none has."""
    label = F.lit(None).cast("string")
    for name, words in reversed(rules):
        label = F.when(any_of(haystack, words), name).otherwise(label)
    return label


def every_rule(haystack: Column, rules: Rules, limit: int | None = None) -> Column:
    """Labels of all rules that have a key word in the text, in the rules' order."""
    labels = F.array(*[F.when(any_of(haystack, words), F.lit(name)) for name, words in rules])
    found = F.array_compact(labels)
    return F.slice(found, 1, limit) if limit else found


def employment_type(title: Column, location: Column | None = None, description: Column | None = None) -> Column:
    parts = F.filter(F.array(*[fold(c) for c in (title, location, description) if c is not None]), lambda p: p != "")
    return bound(F.array_join(parts, " "), lambda t: first_rule(t, EMPLOYMENT_RULES))


def seniority(title: Column, description: Column) -> Column:
    """By the title, then by the description, else mid; null when both are empty."""
    level = lambda t, d: F.when((t != "") | (d != ""), F.coalesce(first_rule(t, SENIORITY_RULES), first_rule(d, SENIORITY_RULES), F.lit("mid")))
    return bound(F.struct(fold(title).alias("t"), fold(description).alias("d")), lambda x: level(x["t"], x["d"]))


def workplace_type(location: Column) -> Column:
    return bound(fold(location), lambda t: first_rule(t, WORKPLACE_RULES))


def rank_of(label: Column, ranks: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[label]


def normalize_url(url: Column) -> Column:
    """For comparing: scheme (https by default) and host in lower case, no doubled or trailing slashes, no query or fragment."""
    return bound(normalize(url), _normalized_url)


def _normalized_url(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)", k)
    scheme = F.when(part(1) != "", F.lower(part(1))).otherwise("https")
    path = F.regexp_replace(F.when(part(3) != "", part(3)).otherwise("/"), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    path = F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(text == "", "").otherwise(F.concat(scheme, F.lit("://"), F.lower(part(2)), path))


def location_city(location: Column) -> Column:
    text, low = normalize(location), fold(location)
    head = F.lit(None).cast("string")
    for sep in ("/", " - ", ","):
        first = normalize(F.split_part(text, F.lit(sep), F.lit(1)))
        head = F.when(F.contains(text, F.lit(sep)), F.when(first != "", first).otherwise(text)).otherwise(head)
    bare = ~F.contains(text, F.lit(",")) & ~F.contains(text, F.lit(" - "))
    return F.when(text == "", None).when(F.contains(low, F.lit("remote")), "Remote").when(F.contains(low, F.lit("hybrid")) & bare, "Hybrid").otherwise(F.coalesce(head, text))


def completeness(text: Column) -> Column:
    """Share of a full description, by steps of the length of the text without tags."""

    def score(n: Column) -> Column:
        found = F.lit(0.2)
        for least, value in reversed(COMPLETENESS_STEPS):
            found = F.when(n >= least, value).otherwise(found)
        return found

    return bound(F.length(F.coalesce(strip_html(text), F.lit(""))), score)


def keywords(*texts: Column, limit: int = 24) -> Column:
    """Distinct key words of the texts in order, without stop words and numbers."""
    every = F.flatten(F.array(*[F.regexp_extract_all(F.lower(F.coalesce(strip_html(t), normalize(t))), F.lit("([a-zA-Z0-9.+#-]{2,})"), F.lit(1)) for t in texts]))
    clean = F.transform(every, lambda w: F.regexp_replace(w, "^[.-]+|[.-]+$", ""))
    kept = F.filter(clean, lambda w: (w != "") & ~w.isin(*STOPWORDS) & ~w.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(kept), 1, limit)


def years_of_experience(text: Column) -> Column:
    """Least number of years that the text asks for; null if it names none."""
    low = F.lower(normalize(text))
    patterns = (r"(?:minimum of|at least|min\.?|minimum)\s+(\d{1,2})\+?\s+years?", r"(\d{1,2})\+\s+years?", r"(\d{1,2})\s*(?:-|to)\s*\d{1,2}\s+years?")
    every = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in patterns]))
    return F.array_min(F.transform(every, lambda x: x.cast("int")))


def fingerprint(*parts: Column) -> Column:
    """sha256 of normalised parts."""
    return F.sha2(F.concat_ws("||", *[fold(p) for p in parts]), 256)


def canonical_key(company: Column, title: Column, location: Column, url: Column, fallback: Column) -> Column:
    link = normalize_url(url)
    return F.concat_ws("|", fold(company), fold(title), fold(location), F.when(link != "", link).otherwise(fold(fallback)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(text: Column) -> Column:
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\s]+"))
    return F.when(words == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(words * 1.25))).cast("long")


def ellipsis(text: Column, limit: int) -> Column:
    """At most limit characters, the last of them an ellipsis when cut; empty when fewer than 31 could be shown."""
    if limit < 31:
        return F.when(F.length(text) <= limit, text).otherwise("")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def merge_terms(*arrays: Column, limit: int = 24) -> Column:
    """Ordered union of terms without case, blanks left out."""
    low = F.transform(F.flatten(F.array(*arrays)), fold)
    return F.slice(F.array_distinct(F.filter(low, lambda t: t != "")), 1, limit)


def affinity(impressions: Column, opens: Column, saves: Column, applies: Column, dwell_seconds: Column) -> Column:
    """Interest of a reader in a posting, from what they did; between 0 and 1."""
    # The most that each signal adds, and its weight.
    signals = ((impressions, 0.06, 0.016), (opens, 0.40, 0.18), (saves, 0.24, 0.16), (applies, 0.18, 0.13), (dwell_seconds / 30.0, 0.22, 0.085))
    total = F.lit(0.0)
    for value, most, weight in signals:
        total = total + F.least(F.lit(most), F.log1p(F.greatest(F.lit(0), value)) * weight)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def retry_delay(base: float, factor: float, attempt: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt))


def ladder(value: Column, steps: Sequence[tuple[float, float]], otherwise: float) -> Column:
    """Score of the first step that value does not exceed."""
    score = F.lit(float(otherwise))
    for most, v in reversed(steps):
        score = F.when(value <= most, float(v)).otherwise(score)
    return score


# Freshness by age in days.
AGE_STEPS = ((1, 1.0), (3, 0.95), (7, 0.88), (14, 0.76), (30, 0.6), (60, 0.42))


def age_days(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400))


def freshness(now: Column, last_seen: Column, posted: Column) -> Column:
    """Blend of the ages since posting and since it was last seen, between 0.2 and 1; 0.5 when neither is known."""
    p, s = ladder(age_days(now, posted), AGE_STEPS, 0.25) * 0.7, ladder(age_days(now, last_seen), AGE_STEPS, 0.25) * 0.3
    score = F.coalesce(F.when(posted.isNotNull(), p), F.lit(0.0)) + F.coalesce(F.when(last_seen.isNotNull(), s), F.lit(0.0))
    score = F.when(posted.isNull(), F.least(F.lit(1.0), score + 0.35)).otherwise(score)
    score = F.when(last_seen.isNotNull() & (age_days(now, last_seen) <= 1), F.least(F.lit(1.0), score + 0.05)).otherwise(score)
    return F.when(now.isNull() | posted.isNull() & last_seen.isNull(), 0.5).otherwise(F.round(F.greatest(F.lit(0.2), F.least(F.lit(1.0), score)), 4))
