"""Scores of a profile against postings: components, their weighted sum, and the ranking.

Profiles and postings carry array and scalar columns; a score is a few projections over their join, so
Catalyst keeps it in generated code and only the columns that it names are read. What several
components need (skills in common, strength of evidence) is computed once, in a struct of its own.
Unknown values get a neutral score of their component and never make a sum null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import free
from tessera.functions.text import SENIORITY_RANK, jaccard, rank_of

# What each component counts, and the ranks of its levels.
WEIGHTS = {
    "skill": 0.26, "role": 0.14, "seniority": 0.08, "discipline": 0.09, "domain": 0.06, "location": 0.09,
    "experience": 0.08, "title": 0.05, "scope": 0.04, "workplace": 0.05, "language": 0.03, "education": 0.03,
}
EDUCATION_RANK = {"high_school": 1, "associate": 2, "bachelor": 3, "master": 4, "doctorate": 5}
SCOPE_RANK = {"ic": 1, "senior-ic": 2, "tech-lead": 3, "architect": 4, "manager": 5}
COMPATIBLE = (("remote", "hybrid"), ("hybrid", "remote"), ("hybrid", "onsite"))
MATCHED = 0.55


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def count(terms: Column) -> Column:
    return F.when(terms.isNull(), 0).otherwise(F.size(terms))


def both(left: Column, right: Column) -> Column:
    """Terms of left that right has, in the order and number of left."""
    return F.filter(F.coalesce(left, F.array().cast("array<string>")), lambda t: F.coalesce(F.array_contains(right, t), F.lit(False)))


def capped(terms: Column, most: float, each: float) -> Column:
    return F.least(F.lit(most), count(terms) * each)


def evidence(p) -> Column:
    """How strongly a profile's experience supports it."""
    return clamp(capped(p("evidence_terms"), 0.5, 0.025) + capped(p("ownership_signals"), 0.25, 0.08) + capped(p("impact_signals"), 0.25, 0.08))


def lacking(left: Column, right: Column) -> Column:
    """Terms of left that right has not, in the order and number of left."""
    return F.filter(F.coalesce(left, F.array().cast("array<string>")), lambda t: ~F.coalesce(F.array_contains(right, t), F.lit(False)))


def common(p, j) -> tuple[dict[str, Column], dict[str, Column]]:
    """What several components read of a pair: first from the pair, then also from the first ones (named w_)."""
    none = F.array().cast("array<string>")
    required = F.when(count(j("required_skills")) > 0, j("required_skills")).otherwise(F.coalesce(j("skills"), none))
    return (
        {"required": required, "preferred": F.coalesce(j("preferred_skills"), none), "strength": evidence(p)},
        {"hit": lambda w: both(w("required"), p("skills")), "nice": lambda w: both(w("preferred"), p("skills"))},
    )


def skill(p, j, w) -> Column:
    """w: what common() gives."""
    n_req, n_pref, hits = F.size(w("required")), F.size(w("preferred")), F.size(w("hit"))
    up = lambda x: F.least(F.lit(1.0), x)
    base = F.when(n_req > 0, 0.10 + 0.90 * hits / F.least(F.lit(10), n_req)).otherwise(0.50)
    base = up(base + F.when(n_pref > 0, 0.08 * F.size(w("nice")) / F.least(F.lit(6), n_pref)).otherwise(0.0))
    base = up(base + F.when(hits > 7, 0.04).otherwise(0.0))
    strength = w("strength")
    proven = F.size(both(w("hit"), p("evidence_terms"))) / F.greatest(F.lit(1), hits)
    more = (
        F.when(proven >= 0.75, F.when(strength >= 0.55, 0.08).otherwise(0.06))
        .when(proven >= 0.45, F.when(strength >= 0.65, 0.04).otherwise(0.03))
        .when((proven == 0) & (hits >= 2), F.when(strength >= 0.3, -0.05).otherwise(-0.08))
        .otherwise(0.0)
    )
    change = F.when((hits > 0) & (count(p("evidence_terms")) > 0), more).when((hits >= 2) & (strength < 0.2), -0.04).otherwise(0.0)
    missing = F.when(n_req > 0, n_req - hits).otherwise(0)
    ceiling = F.when(missing >= 3, 0.30).when(missing == 2, 0.52).otherwise(1.0)
    score = F.least(clamp(base + change), ceiling)
    return F.when((n_req == 0) & (n_pref == 0), 0.50).when(count(p("skills")) == 0, 0.08).otherwise(score)


def one_of(value: Column, wanted: Column, neutral: float, sparse: float, miss: float) -> Column:
    return F.when(value.isNull(), neutral).when(F.coalesce(F.array_contains(wanted, value), F.lit(False)), 1.0).when(count(wanted) == 0, sparse).otherwise(miss)


def seniority(p, j) -> Column:
    delta = F.coalesce(rank_of(p("seniority"), SENIORITY_RANK), F.lit(3)) - F.coalesce(rank_of(j("seniority"), SENIORITY_RANK), F.lit(3))
    score = F.when(delta == 0, 1.0).when(delta == 1, 0.82).when(delta == 2, 0.60).when(delta > 2, 0.42).when(delta == -1, 0.72).when(delta == -2, 0.38).otherwise(0.18)
    return F.when(p("seniority").isNull() | j("seniority").isNull(), 0.58).otherwise(score)


def domain(p, j) -> Column:
    n = F.size(both(j("domains"), p("domains")))
    return F.when(count(j("domains")) == 0, 0.55).when(count(p("domains")) == 0, 0.46).when(n > 0, F.least(F.lit(1.0), 0.76 + 0.08 * n)).otherwise(0.22)


def location(p, j) -> Column:
    wish = F.lower(F.coalesce(p("remote_preference"), F.lit("")))
    remote = F.coalesce(j("workplace") == "remote", F.lit(False))
    unknown = F.when(remote & (wish == "onsite"), 0.24).otherwise(0.55)
    return F.when(count(p("locations")) == 0, unknown).when(F.size(both(j("locations"), p("locations"))) > 0, 1.0).when(remote & wish.isin("remote", "hybrid", "flexible"), 0.88).otherwise(0.18)


def workplace(p, j) -> Column:
    wish, have = (F.lower(F.coalesce(c, F.lit(""))) for c in (p("remote_preference"), j("workplace")))
    near = F.lit(False)
    for a, b in COMPATIBLE:
        near = near | ((wish == a) & (have == b))
    return F.when((wish == "") | (have == ""), 0.55).when(wish == have, 1.0).when(near, 0.68).otherwise(0.18)


def experience(p, j, w) -> Column:
    strength, delta = w("strength"), p("years") - j("years_min")
    score = F.when(delta >= 3, 1.0).when(delta >= 1, 0.90).when(delta == 0, 0.80).when(delta == -1, 0.52).when(delta == -2, 0.30).otherwise(0.14)
    score = (
        F.when((strength >= 0.6) & (delta >= 0), F.least(F.lit(1.0), score + 0.03))
        .when((strength >= 0.6) & (delta == -1), score + 0.08)
        .when((strength < 0.2) & (delta <= -1), F.greatest(F.lit(0.0), score - 0.04))
        .otherwise(score)
    )
    strong = strength >= 0.55
    return F.when(j("years_min").isNull(), F.when(strong, 0.60).otherwise(0.55)).when(p("years").isNull(), F.when(strong, 0.62).otherwise(0.48)).otherwise(score)


def title(p, j) -> Column:
    return F.when((count(p("titles")) == 0) | (count(j("titles")) == 0), 0.40).otherwise(0.20 + F.least(F.lit(0.80), jaccard(p("titles"), j("titles")) * 1.4))


def profile_scope(p) -> Column:
    rank, leads = F.coalesce(rank_of(p("seniority"), SENIORITY_RANK), F.lit(3)), F.coalesce(p("manages"), F.lit(False))
    guess = F.when(leads & (rank >= 5), "manager").when(leads & (rank >= 4), "tech-lead").when(rank >= 6, "architect").when(rank >= 5, "tech-lead").when(rank >= 4, "senior-ic").otherwise("ic")
    return F.coalesce(p("scope"), F.when(p("seniority").isNotNull(), guess))


def scope(p, j) -> Column:
    have, want = profile_scope(p), j("scope")
    delta = F.coalesce(rank_of(have, SCOPE_RANK), F.lit(2)) - F.coalesce(rank_of(want, SCOPE_RANK), F.lit(2))
    raw = F.when(delta == 0, 1.0).when(delta == 1, 0.82).when(delta == -1, 0.70).when(F.abs(delta) == 2, 0.44).otherwise(0.20)
    owns = lambda s: F.coalesce(F.array_contains(p("ownership_signals"), s), F.lit(False))
    some = count(p("ownership_signals")) + count(p("impact_signals")) > 0
    more = F.when(owns("architecture") & want.isin("architect", "tech-lead"), 0.08).when(owns("technical_leadership") & want.isin("tech-lead", "manager"), 0.06).when(owns("system_ownership") & want.isin("senior-ic", "tech-lead"), 0.04).otherwise(0.0)
    raw = F.when((delta <= 0) & some, F.least(F.lit(1.0), raw + more)).when((delta < 0) & ~some, F.greatest(F.lit(0.0), raw - 0.05)).otherwise(raw)
    return F.when(want.isNull(), 0.56).when(have.isNull(), 0.54).otherwise(raw)


def language(p, j) -> Column:
    n = count(j("languages"))
    return F.when(n == 0, 0.65).when(count(p("languages")) == 0, 0.16).otherwise(0.18 + 0.82 * F.size(both(j("languages"), p("languages"))) / F.greatest(F.lit(1), n))


def education(p, j) -> Column:
    have, want = (F.coalesce(rank_of(c, EDUCATION_RANK), F.lit(0)) for c in (p("education"), j("education")))
    return F.when(j("education").isNull(), 0.62).when(p("education").isNull(), 0.32).when(have >= want, 1.0).when(have + 1 == want, 0.52).otherwise(0.18)


def components(p, j, w) -> dict[str, Column]:
    """Raw score of every component; p and j give a column of the profile and of the posting by name, w one of common()."""
    return {
        "skill": skill(p, j, w), "role": one_of(j("role"), p("roles"), 0.52, 0.42, 0.16), "seniority": seniority(p, j), "discipline": one_of(j("discipline"), p("disciplines"), 0.50, 0.40, 0.20),
        "domain": domain(p, j), "location": location(p, j), "experience": experience(p, j, w), "title": title(p, j), "scope": scope(p, j), "workplace": workplace(p, j), "language": language(p, j), "education": education(p, j),
    }


def external(j) -> Column:
    return ~F.lower(F.coalesce(j("external_status"), F.lit(""))).isin("", "unavailable", "error")


def content_strength(j) -> Column:
    """How much structured content a posting offers to be judged by."""
    skills = F.when(count(j("required_skills")) > 0, capped(j("required_skills"), 0.28, 0.035)).otherwise(capped(j("skills"), 0.18, 0.02))
    rest = F.when(j("scope").isNotNull(), 0.12).otherwise(0.0) + F.when(j("years_min").isNotNull(), 0.08).otherwise(0.0)
    page = 0.10 + capped(j("external_requirements"), 0.08, 0.02) + capped(j("external_technologies"), 0.10, 0.025) + capped(j("external_responsibilities"), 0.08, 0.02)
    return clamp(skills + capped(j("preferred_skills"), 0.10, 0.025) + capped(j("domains"), 0.10, 0.04) + rest + capped(j("languages"), 0.06, 0.03) + F.when(external(j), page).otherwise(0.0))


def analysis_score(j) -> Column:
    """How well a posting could be analysed, by the length of its description and what was found in it and on its page."""
    n = j("description_chars")
    score = F.when(n >= 1200, 0.28).when(n >= 700, 0.24).when(n >= 350, 0.20).when(n >= 180, 0.14).when(n >= 80, 0.08).otherwise(0.0)
    page = 0.20 + capped(j("external_requirements"), 0.08, 0.02) + capped(j("external_technologies"), 0.06, 0.015) + capped(j("external_responsibilities"), 0.06, 0.02)
    score = score + F.when(external(j), page).otherwise(0.0)
    score = score + F.when(count(j("required_skills")) > 0, capped(j("required_skills"), 0.14, 0.02)).otherwise(capped(j("skills"), 0.08, 0.01))
    score = score + capped(j("preferred_skills"), 0.05, 0.0125) + capped(j("languages"), 0.04, 0.02) + capped(j("domains"), 0.04, 0.015)
    for name, value in (("scope", 0.05), ("years_min", 0.04), ("role", 0.03), ("discipline", 0.03)):
        score = score + F.when(j(name).isNotNull(), value).otherwise(0.0)
    return F.round(clamp(score), 4)


def scores(pairs: DataFrame, profile: str, posting: str, affinity: Column | None = None) -> DataFrame:
    """Add fit, catalog, final, matched, analysis and blockers, and each component's raw score (raw_...), to pairs of two struct columns.

    The names of what is added must not be among the columns of pairs.
    """
    p, j = (lambda name: F.col(f"{profile}.{name}")), (lambda name: F.col(f"{posting}.{name}"))
    one, two, work = free(pairs, "match_one", "match_two", "match_sum")
    w = lambda name: F.col(f"{two}.{name}") if name in second else F.col(f"{one}.{name}")
    first, second = common(p, j)
    rows = pairs.withColumn(one, F.struct(*[v.alias(k) for k, v in first.items()]))
    rows = rows.withColumn(two, F.struct(*[v(lambda name: F.col(f"{one}.{name}")).alias(k) for k, v in second.items()]))
    rows = rows.withColumns({f"raw_{k}": F.round(clamp(v), 4) for k, v in components(p, j, w).items()})
    # Components are rounded before they are added up.
    fit = F.lit(0.0)
    for k, weight in WEIGHTS.items():
        fit = fit + F.round(F.col(f"raw_{k}") * weight, 4)
    rows = rows.withColumns({"fit": F.round(fit, 4), "analysis": analysis_score(j)})
    catalog = F.round(clamp(j("trust") * 0.22 + j("freshness") * 0.18 + j("readiness") * 0.33 + content_strength(j) * 0.12 + F.col("analysis") * 0.15), 4)
    rows = rows.withColumn("catalog", catalog)
    plain = F.round(F.col("fit") * 0.91 + F.col("catalog") * 0.09, 4)
    total = plain if affinity is None else F.when(affinity.isNull(), plain).otherwise(F.round(F.col("fit") * 0.86 + F.col("catalog") * 0.09 + clamp(affinity) * 0.05, 4))
    a, t = F.col("analysis"), F.col(work)
    final = F.when(a < 0.38, F.round(t * 0.92, 4)).when(a < 0.52, F.round(t * 0.97, 4)).when(a >= 0.82, F.round(F.least(F.lit(1.0), t + 0.01), 4)).otherwise(t)
    stuck = F.when(F.col("raw_skill") <= 0.30, F.slice(F.when(count(p("skills")) > 0, lacking(w("required"), p("skills"))).otherwise(w("required")), 1, 6))
    rows = rows.withColumn(work, total).withColumns({"final": final, "blockers": F.coalesce(stuck, F.array().cast("array<string>"))})
    return rows.withColumn("matched", F.col("final") >= MATCHED).drop(one, two, work)


def best_first(posting: str, key: str, updated: Column | None = None) -> list[Column]:
    """The order of matches: final, fit, readiness, trust, freshness, last change, key; all from the highest down."""
    j = lambda name: F.col(f"{posting}.{name}")
    return [F.desc("final"), F.desc("fit"), j("readiness").desc(), j("trust").desc(), j("freshness").desc(), *([F.coalesce(updated, F.lit("")).desc()] if updated is not None else []), F.desc(key)]


def ranked(scored: DataFrame, profile_key: str, posting_key: str, posting: str, limit: int, least: float = 0.0, updated: Column | None = None) -> DataFrame:
    """The best postings of each profile with their place, best first; the limit is the feature."""
    # The score leads the order, so rows below the least one come last: it is asked for after the places, which keeps
    # the optimizer from copying the whole score into a filter below them.
    order = Window.partitionBy(profile_key).orderBy(*best_first(posting, posting_key, updated))
    return scored.withColumn("place", F.row_number().over(order)).filter((F.col("place") <= limit) & (F.col("final") >= least))


def match_of(pairs: DataFrame, key: str, value, profile: str = "profile", posting: str = "posting") -> DataFrame:
    """The scores of one posting; only its pair is scored."""
    return scores(pairs.filter(F.col(key) == F.lit(value)), profile, posting)


def saved_snapshots(saved: DataFrame, pairs: DataFrame, key: Sequence[str], profile: str = "profile", posting: str = "posting") -> DataFrame:
    """The scores of saved postings alone, as they are now."""
    return scores(pairs.join(saved.select(*key).distinct(), list(key), "left_semi"), profile, posting).select(*key, "fit", "catalog", "final", "matched", "blockers")


def display_score(hits: Column, asked: Column) -> Column:
    """Score shown where only key words could be compared: 42 to 74."""
    ratio = F.when(asked > 0, hits / asked).otherwise(0.0)
    return F.least(F.lit(74), F.greatest(F.lit(42), 42 + F.bround(32 * ratio).cast("int")))


# Terms too common to be shown, and the words for them.
GENERIC = (
    "engineer", "developer", "manager", "specialist", "lead", "intern", "analyst", "software", "platform", "cloud", "backend", "frontend",
    "fullstack", "full-stack", "senior", "junior", "mid", "staff", "principal", "associate", "consultant",
)


def shown_terms(terms: Column, limit: int = 8) -> Column:
    """Terms as they are displayed: spaces for underscores, lower case, distinct, generic ones left out."""
    clean = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.lower(F.trim(F.replace(t, F.lit("_"), F.lit(" ")))))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: (t != "") & ~t.isin(*GENERIC))), 1, limit)


def insights(scored: DataFrame, posting: str, skill_terms: tuple[Column, Column], order: list[Column], considered: int = 40, for_gaps: int = 20, top: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From one profile's scored postings: (matched, remote) counts, (term, items, total) strengths, (term, weight, percent) gaps.

    skill_terms: terms that a posting and the profile share, and those that the profile lacks. The best postings
    considered are the feature: 40, and 20 of at least 0.45 for gaps, where blockers count twice.
    """
    best = scored.withColumns({"shared_terms": skill_terms[0], "lacked_terms": skill_terms[1]}).orderBy(*order).limit(considered)
    matched = best.filter("matched")
    remote = F.coalesce(F.lower(F.col(f"{posting}.workplace")).isin("remote", "hybrid"), F.lit(False))
    counts = matched.agg(F.count("*").alias("matched"), F.count_if(remote).alias("remote"))
    strong = matched.select(F.explode(shown_terms(F.col("shared_terms"))).alias("term")).groupBy("term").agg(F.count("*").alias("items"))
    strengths = strong.orderBy(F.desc("items"), "term").limit(top).crossJoin(counts.select(F.col("matched").alias("total")))  # a row
    weak = best.filter("final >= 0.45").orderBy(*order).limit(for_gaps)
    blocked = shown_terms(F.col("blockers"))
    rows = weak.select(F.explode(F.when(F.size(blocked) > 0, F.transform(blocked, lambda t: F.struct(t.alias("term"), F.lit(2).alias("weight")))).otherwise(F.transform(shown_terms(F.col("lacked_terms"), 6), lambda t: F.struct(t.alias("term"), F.lit(1).alias("weight"))))).alias("g"))
    summed = rows.groupBy("g.term").agg(F.sum("g.weight").alias("weight")).orderBy(F.desc("weight"), "term").limit(top)
    share = F.least(F.lit(100), F.bround(F.col("weight") * 100 / F.greatest(F.lit(1), F.col("n"))).cast("int"))
    lacking_terms = summed.crossJoin(weak.agg(F.count("*").alias("n"))).select("term", "weight", share.alias("percent"))  # a row
    return counts, strengths, lacking_terms


def gaps(scored: DataFrame, required: Column, have: Column, top: int = 5) -> DataFrame:
    """(term, weight): terms that postings ask for and the profile lacks, twice as heavy where the posting failed on them; the top few are the feature."""
    missing = F.filter(required, lambda t: ~F.coalesce(F.array_contains(have, t), F.lit(False)))
    rows = scored.select(F.explode(missing).alias("term"), F.when(F.col("raw_skill") <= 0.30, 2).otherwise(1).alias("weight"))
    return rows.groupBy("term").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "term").limit(top)
