"""Why a posting matches a profile: components by weight, evidence, gaps, reasons, and how well the posting could be judged.

Everything is a projection over scored pairs (``matching.scores``): terms of the components first, then
ordered arrays of structs cut to their limits. Texts are put together from the terms when they are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import free
from tessera.functions.text import SENIORITY_RANK, rank_of
from tessera.operators import matching as M

# Titles of the components, the orders in which they are looked at, and the limits.
LABELS = {
    "skill": "Skill overlap", "role": "Role alignment", "seniority": "Seniority fit", "discipline": "Discipline fit", "domain": "Domain experience fit", "location": "Location fit", "experience": "Experience fit",
    "title": "Title similarity", "scope": "Responsibility scope fit", "workplace": "Workplace preference fit", "language": "Language fit", "education": "Education fit",
}
BREAKDOWN, EVIDENCE, GAPS, REASONS = 6, 4, 4, 3
NONE = "array<string>"


def empty() -> Column:
    return F.array().cast(NONE)


def one(value: Column, when: Column) -> Column:
    """The value as an array of one where the condition holds, else an empty one."""
    return F.when(F.coalesce(when, F.lit(False)) & value.isNotNull(), F.array(value.cast("string"))).otherwise(empty())


def component_terms(p, j) -> dict[str, tuple[Column, Column]]:
    """(matched, missing) terms of every component."""
    have = lambda name: F.coalesce(p(name), empty())
    want = lambda name: F.coalesce(j(name), empty())
    required = F.when(M.count(j("required_skills")) > 0, j("required_skills")).otherwise(want("skills"))
    known = M.count(p("skills")) > 0
    signs = F.slice(F.array_distinct(F.concat(have("ownership_signals"), have("impact_signals"))), 1, 6)
    level = lambda c: F.coalesce(rank_of(c, SENIORITY_RANK), F.lit(3))
    below = level(p("seniority")) < level(j("seniority"))
    both_levels = p("seniority").isNotNull() & j("seniority").isNotNull()
    scope = M.profile_scope(p)
    scope_rank = lambda c: F.coalesce(rank_of(c, M.SCOPE_RANK), F.lit(2))
    places = M.both(want("locations"), have("locations"))
    wish = F.lower(F.coalesce(p("remote_preference"), F.lit("")))
    remote = (j("workplace") == "remote") & wish.isin("remote", "hybrid", "flexible")
    at = F.lower(F.coalesce(j("workplace"), F.lit("")))
    fits = M.workplace(p, j) >= 0.68
    grade = lambda c: F.coalesce(rank_of(c, M.EDUCATION_RANK), F.lit(0))
    short = grade(j("education")) - grade(p("education"))
    years = F.concat(one(p("years"), p("years").isNotNull()), F.slice(signs, 1, 2))
    return {
        "skill": (
            F.when(known, F.slice(F.concat(M.both(required, p("skills")), M.both(want("preferred_skills"), p("skills"))), 1, 12)).otherwise(empty()),
            F.when(known, F.slice(F.concat(M.lacking(required, p("skills")), M.lacking(want("preferred_skills"), p("skills"))), 1, 12)).otherwise(F.concat(F.slice(required, 1, 8), F.slice(want("preferred_skills"), 1, 4))),
        ),
        "role": (one(j("role"), F.array_contains(have("roles"), j("role"))), one(j("role"), (F.size(have("roles")) > 0) & ~F.array_contains(have("roles"), j("role")))),
        "discipline": (one(j("discipline"), F.array_contains(have("disciplines"), j("discipline"))), one(j("discipline"), (F.size(have("disciplines")) > 0) & ~F.array_contains(have("disciplines"), j("discipline")))),
        "seniority": (one(p("seniority"), both_levels), one(j("seniority"), both_levels & below)),
        "domain": (F.slice(M.both(want("domains"), have("domains")), 1, 4), F.when((F.size(have("domains")) > 0) & (F.size(M.both(want("domains"), have("domains"))) == 0), F.slice(want("domains"), 1, 4)).otherwise(empty())),
        "scope": (
            F.when(j("scope").isNotNull() & scope.isNotNull(), F.concat(F.array(scope), F.slice(signs, 1, 2))).otherwise(signs),
            one(j("scope"), scope.isNotNull() & (scope_rank(scope) < scope_rank(j("scope")))),
        ),
        "title": (F.slice(M.both(want("titles"), have("titles")), 1, 10), empty()),
        "location": (
            F.when(F.size(have("locations")) == 0, empty()).when(F.size(places) > 0, F.slice(places, 1, 8)).otherwise(one(F.lit("remote"), remote)),
            F.when((F.size(have("locations")) > 0) & (F.size(places) == 0) & ~F.coalesce(remote, F.lit(False)), F.slice(want("locations"), 1, 8)).otherwise(empty()),
        ),
        "workplace": (one(at, (wish != "") & (at != "") & fits), one(at, (wish != "") & (at != "") & ~fits)),
        "experience": (F.when(j("years_min").isNull() | p("years").isNull(), signs).otherwise(years), one(j("years_min"), j("years_min").isNotNull())),
        "language": (F.slice(M.both(want("languages"), have("languages")), 1, 6), F.slice(M.lacking(want("languages"), have("languages")), 1, 6)),
        "education": (one(p("education"), j("education").isNotNull() & (short <= 1)), one(j("education"), p("education").isNull() | (short >= 1))),
    }


def coverage(j) -> Column:
    """struct(score, level, sources, signals): how well a posting's content could be analysed, and from what."""
    score = M.analysis_score(j)
    some = lambda name: M.count(j(name)) > 0
    named = lambda pairs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))
    responsible = j("scope").isNotNull() | some("external_responsibilities")
    sources = [
        ("canonical_description", j("description_chars") > 0), ("original_source_page", M.external(j)), ("structured_requirements", some("required_skills") | some("preferred_skills")),
        ("responsibility_signals", responsible), ("technology_signals", some("external_technologies") | some("skills")),
    ]
    signals = [
        ("required_skills", some("required_skills")), ("preferred_skills", some("preferred_skills")), ("source_requirements", some("external_requirements")), ("source_technology", some("external_technologies")),
        ("responsibilities", responsible), ("experience_requirement", j("years_min").isNotNull()), ("languages", some("languages")), ("domain", some("domains")), ("role_family", j("role").isNotNull()), ("discipline", j("discipline").isNotNull()),
    ]
    level = F.when(score >= 0.66, "strong").when(score >= 0.40, "moderate").otherwise("limited")
    return F.struct(score.alias("score"), level.alias("level"), named(sources).alias("sources"), named(signals).alias("signals"))


def impact(raw: Column) -> Column:
    return F.when(raw >= 0.75, "strong").when(raw >= 0.45, "moderate").otherwise("weak")


def severity(raw: Column) -> Column:
    return F.when(raw < 0.35, "high").when(raw < 0.60, "medium").otherwise("low")


def human_join(terms: Column) -> Column:
    """Terms as a phrase: a, b, and c."""
    shown = F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    n = F.size(shown)
    return F.when(n == 0, "relevant profile evidence").when(n == 1, shown[0]).when(n == 2, F.concat_ws(" and ", shown)).otherwise(F.concat(F.array_join(F.slice(shown, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(shown, -1)))


def explained(scored: DataFrame, profile: str, posting: str, affinity: Column | None = None) -> DataFrame:
    """Add coverage, breakdown, evidence, gap_analysis and reasons to scored pairs."""
    p, j = (lambda name: F.col(f"{profile}.{name}")), (lambda name: F.col(f"{posting}.{name}"))
    (terms,) = free(scored, "explain_terms")
    rows = scored.withColumn(terms, F.struct(*[F.struct(m.alias("matched"), x.alias("missing")).alias(k) for k, (m, x) in component_terms(p, j).items()]))
    rows = rows.withColumn("coverage", coverage(j))
    raw = lambda k: F.col(f"raw_{k}")
    matched = lambda k: F.col(f"{terms}.{k}.matched")
    missing = lambda k: F.col(f"{terms}.{k}.missing")
    weighted = lambda k: F.round(raw(k) * M.WEIGHTS[k], 4)
    # Ties keep the order in which components are computed.
    parts = [F.struct((-weighted(k)).alias("o"), F.lit(i).alias("place"), F.lit(k).alias("component"), F.lit(LABELS[k]).alias("label"), F.lit(w).alias("weight"), raw(k).alias("raw"), weighted(k).alias("weighted"), impact(raw(k)).alias("impact"), F.slice(matched(k), 1, 6).alias("terms"), F.slice(missing(k), 1, 6).alias("missing")) for i, (k, w) in enumerate(M.WEIGHTS.items())]
    ordered = F.slice(F.array_sort(F.array(*parts)), 1, BREAKDOWN)
    breakdown = F.transform(ordered, lambda c: F.struct(*[c[n].alias(n) for n in ("component", "label", "weight", "raw", "weighted", "impact", "terms", "missing")]))
    point = lambda code, title, some: F.struct(F.lit(code).alias("code"), F.lit(title).alias("title"), some.alias("terms"))
    has = lambda k: F.size(matched(k)) > 0
    enough = lambda k: raw(k) >= 0.55
    # Codes, titles and thresholds, in the order in which points are made.
    points = [
        ((enough("skill") | (F.size(matched("skill")) >= 3) & (weighted("skill") >= 0.12)) & has("skill"), point("skill_overlap_high", "Strong skill overlap", F.slice(matched("skill"), 1, 6))),
        (enough("role") & has("role"), point("role_family_match", "Role family match", matched("role"))),
        (raw("seniority") >= 0.8, point("seniority_match", "Seniority level fit", F.slice(matched("seniority"), 1, 2))),
        ((raw("domain") >= 0.76) & has("domain"), point("domain_experience_match", "Domain experience match", F.slice(matched("domain"), 1, 4))),
        (enough("discipline") & has("discipline"), point("discipline_preference_match", "Discipline fit", matched("discipline"))),
        (enough("location") & has("location"), point("location_preference_match", "Location preference fit", F.slice(matched("location"), 1, 6))),
        (raw("experience") >= 0.8, point("experience_requirement_covered", "Experience coverage", F.concat(F.slice(matched("experience"), 1, 1), F.slice(missing("experience"), 1, 1)))),
        (raw("scope") >= 0.8, point("scope_alignment", "Responsibility scope fit", F.slice(matched("scope"), 1, 2))),
        (enough("workplace") & has("workplace"), point("workplace_mode_match", "Workplace mode fit", matched("workplace"))),
        (enough("title") & has("title"), point("title_similarity_strong", "Title similarity", F.slice(matched("title"), 1, 6))),
        (enough("language") & has("language"), point("language_requirement_covered", "Language coverage", matched("language"))),
        (enough("education") & has("education"), point("education_requirement_covered", "Education signal present", matched("education"))),
    ]
    evidence = F.slice(F.array_compact(F.array(*[F.when(c, x) for c, x in points])), 1, EVIDENCE)
    verified = point("job_content_verified", "Job content analyzed clearly", F.slice("coverage.signals", 1, 4))
    strong = F.col("coverage.level") == "strong"
    best = F.array_min(F.array(*parts))
    fallback = F.array(F.struct(F.concat(F.lit("fallback_"), best["component"]).alias("code"), best["label"].alias("title"), F.slice(best["terms"], 1, 4).alias("terms")))
    gap = lambda code, title, level, some: F.struct(F.lit(code).alias("code"), F.lit(title).alias("title"), level.alias("severity"), some.alias("terms"))
    plain = lambda k, code, title, some: gap(code, title, severity(raw(k)), some)
    lacks = lambda k: F.size(missing(k)) > 0
    blocked = (F.size("blockers") > 0) & (raw("skill") < 0.35)
    gaps = [
        ((raw("skill") < 0.75) & (blocked | lacks("skill")), F.when(blocked, gap("skill_hard_blocker", "Hard skill blockers", F.lit("high"), F.col("blockers"))).otherwise(plain("skill", "skill_gap_detected", "Skills to strengthen", F.slice(missing("skill"), 1, 6)))),
        (raw("seniority") < 0.55, plain("seniority", "seniority_gap_detected", "Seniority mismatch", missing("seniority"))),
        (raw("scope") < 0.50, plain("scope", "responsibility_scope_gap", "Responsibility scope mismatch", missing("scope"))),
        (raw("experience") < 0.70, plain("experience", "experience_gap_detected", "Experience gap to review", missing("experience"))),
        ((raw("domain") < 0.45) & lacks("domain"), plain("domain", "domain_experience_gap", "Domain experience gap", missing("domain"))),
        (lacks("language"), plain("language", "language_requirement_gap", "Language requirement gap", missing("language"))),
        (raw("location") < 0.45, plain("location", "location_preference_gap", "Location mismatch risk", F.when(lacks("location"), F.slice(missing("location"), 1, 6)).otherwise(F.slice(F.coalesce(j("locations"), empty()), 1, 4)))),
        (raw("workplace") < 0.45, plain("workplace", "workplace_preference_gap", "Workplace mode mismatch", missing("workplace"))),
        ((raw("education") < 0.65) & lacks("education"), plain("education", "education_signal_gap", "Education requirement to verify", missing("education"))),
        ((raw("role") < 0.4) & lacks("role"), plain("role", "role_alignment_gap", "Role direction mismatch", missing("role"))),
    ]
    found_gaps = F.slice(F.array_compact(F.array(*[F.when(c, x) for c, x in gaps])), 1, GAPS)
    partial = gap("job_content_partial", "Job content is still partial", F.lit("medium"), empty())
    limited = F.col("coverage.level") == "limited"
    rows = rows.withColumns({"breakdown": breakdown, "evidence": evidence, "gap_analysis": found_gaps})
    many = F.size("evidence") >= EVIDENCE
    with_verified = F.when(strong & many, F.concat(F.slice("evidence", 1, EVIDENCE - 1), F.array(verified))).when(strong, F.concat("evidence", F.array(verified))).otherwise(F.col("evidence"))
    rows = rows.withColumns({
        "evidence": F.when(strong | (F.size("evidence") > 0), with_verified).otherwise(fallback),
        "gap_analysis": F.when(limited & (F.size("gap_analysis") < GAPS), F.concat("gap_analysis", F.array(partial))).otherwise(F.col("gap_analysis")),
    })
    engaged = F.coalesce(affinity >= 0.6, F.lit(False)) if affinity is not None else F.lit(False)
    code = lambda name, k: F.try_element_at(F.transform(name, lambda x: x["code"]), F.lit(k))
    reasons = F.array(code("evidence", 1), code("evidence", 2), F.when(engaged, "recent_engagement").otherwise(code("gap_analysis", 1)), F.when(strong, "strong_content").when(limited, "partial_content"))
    return rows.withColumn("reasons", F.slice(F.array_distinct(F.array_compact(reasons)), 1, REASONS)).drop(terms)
