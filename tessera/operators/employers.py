"""An employer's view: candidates scored for a posting, dashboards, stages with history, audit trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SENIORITY_RANK, jaccard, rank_of
from tessera.operators.matching import EDUCATION_RANK, both, clamp, count, lacking

# What each part counts, which workplaces suit, and the bands of the sum.
WEIGHTS = {"skill_coverage": 0.35, "seniority_fit": 0.15, "experience_fit": 0.12, "role_relevance": 0.12, "location_fit": 0.10, "workplace_fit": 0.08, "language_fit": 0.05, "education_fit": 0.03}
WORKPLACES = {
    "remote": {"remote": 1.0, "hybrid": 0.7}, "hybrid": {"hybrid": 1.0, "remote": 0.8, "onsite": 0.5},
    "onsite": {"onsite": 1.0, "hybrid": 0.6, "remote": 0.0}, "flexible": {"remote": 0.9, "hybrid": 0.9, "onsite": 0.7},
}
BANDS = ((0.85, "excellent"), (0.70, "strong"), (0.50, "moderate"), (0.30, "weak"))
HIGH_PREFIXES = ("employer.auth.", "employer.team.", "employer.settings.", "employer.audit.")
MEDIUM_RESOURCES = ("candidate", "candidate_note", "candidate_tag", "candidate_stage", "send_queue", "send_queue_item", "outreach_campaign")


def lowered(terms: Column) -> Column:
    return F.transform(F.coalesce(terms, F.array().cast("array<string>")), F.lower)


def near_places(wanted: Column, offered: Column) -> Column:
    """Whether a place of one list holds a place of the other, either way."""
    return F.exists(lowered(wanted), lambda a: F.exists(lowered(offered), lambda b: F.contains(a, b) | F.contains(b, a)))


def scored_candidates(pairs: DataFrame, posting: str = "posting", candidate: str = "candidate") -> DataFrame:
    """Add score, band, parts, strengths, gaps, risks and review reasons to pairs of two struct columns.

    posting: required_skills, preferred_skills, seniority, years_min, locations, workplace, role, languages, education;
    candidate: skills, seniority, years, locations, remote_preference, role, languages, education, headline.
    What is not known counts 0, unlike in the scores of a profile against postings.
    """
    j, c = (lambda n: F.col(f"{posting}.{n}")), (lambda n: F.col(f"{candidate}.{n}"))
    zero = F.lit(0.0)
    required, preferred, have = lowered(j("required_skills")), lowered(j("preferred_skills")), lowered(c("skills"))
    rows = pairs.withColumns({"present": both(required, have), "missing": lacking(required, have), "wished": both(preferred, have)})
    n_req, n_pref = F.size(required), F.size(preferred)
    share = lambda part, n: F.size(part) / F.greatest(n, F.lit(1))
    rank = lambda x: F.coalesce(rank_of(x, SENIORITY_RANK), F.lit(0))
    delta = rank(c("seniority")) - rank(j("seniority"))
    least, years = F.coalesce(j("years_min").cast("double"), zero), F.coalesce(c("years").cast("double"), zero)
    role_j, role_c = F.lower(F.coalesce(j("role"), F.lit(""))), F.lower(F.coalesce(c("role"), F.lit("")))
    near = near_places(j("locations"), c("locations"))
    anywhere = (count(j("locations")) > 0) & F.coalesce(j("workplace").isin("remote", "flexible"), F.lit(False))
    at, wish = F.lower(j("workplace")), F.lower(c("remote_preference"))
    suits = F.lit(0.3)
    for a, some in WORKPLACES.items():
        for b, value in some.items():
            suits = F.when((at == a) & (wish == b), value).otherwise(suits)
    grade = lambda x: F.coalesce(rank_of(x, EDUCATION_RANK), F.lit(0))
    spoken = both(lowered(j("languages")), lowered(c("languages")))
    parts = {
        "skill_coverage": F.when(n_req + n_pref == 0, 0.0).otherwise(0.7 * share(F.col("present"), n_req) + 0.3 * share(F.col("wished"), n_pref)),
        "seniority_fit": F.when(rank(j("seniority")) == 0, 0.0).when(delta >= 0, F.greatest(zero, 1.0 - delta * 0.08)).otherwise(F.greatest(zero, 1.0 + delta * 0.25)),
        "experience_fit": F.when(least <= 0, 0.0).when(years >= least, 1.0).otherwise(clamp(F.pow(years / least, F.lit(1.5)))),
        "role_relevance": F.when((role_j == "") | (role_c == ""), 0.0).when(role_j == role_c, 1.0).otherwise(jaccard(F.split(role_j, r"\s+"), F.split(role_c, r"\s+"))),
        "location_fit": F.when(near, 1.0).when(anywhere, 0.6).otherwise(0.0),
        "workplace_fit": F.when((F.coalesce(at, F.lit("")) == "") | (F.coalesce(wish, F.lit("")) == ""), 0.0).otherwise(suits),
        "language_fit": F.when((count(j("languages")) == 0) | (count(c("languages")) == 0), 0.0).otherwise(share(spoken, count(j("languages")))),
        "education_fit": F.when(grade(j("education")) == 0, 0.0).when(grade(c("education")) >= grade(j("education")), 1.0).otherwise(grade(c("education")) / grade(j("education"))),
    }
    rows = rows.withColumns(parts).withColumns({"seniority_delta": delta, "years_delta": F.round(years - least, 2), "location_match": near | anywhere})
    rows = rows.withColumn("remote_match", F.col("workplace_fit") >= 0.5)
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * F.col(name)
    rows = rows.withColumn("score", clamp(total))
    band = F.lit("poor")
    for low, name in reversed(BANDS):
        band = F.when(F.col("score") >= low, name).otherwise(band)
    lacks = F.size("missing")
    some = lambda *pairs_: F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs_]))
    many = (lacks > 0) & (lacks >= F.greatest(n_req * 0.5, F.lit(2.0)))
    d, y, r = F.col("seniority_delta"), years - least, F.col("role_relevance")
    sparse = (F.coalesce(c("headline"), F.lit("")) == "") | (F.size(have) == 0)
    strengths = some(("most_required_skills", F.size("present") >= F.greatest(n_req - 1, F.lit(1))), ("all_required_skills", (lacks == 0) & (n_req > 0)), ("seniority_fits", (d >= 0) & (d <= 1)), ("seniority_above", d > 1), ("experience_met", y >= 0), ("location_fits", F.col("location_match")), ("remote_fits", F.col("remote_match")), ("role_strong", r >= 0.8), ("languages_met", F.col("language_fit") >= 0.8))
    gaps = some(("required_skills_missing", lacks > 0), ("seniority_below", d < 0), ("experience_short", y < 0), ("location_off", ~F.col("location_match")), ("role_weak", (r <= 0.3) & (role_j != "")), ("languages_partly", (F.col("language_fit") < 0.5) & (count(j("languages")) > 0)))
    risks = some(("missing_required_skills", many), ("underqualified_seniority", d <= -2), ("underexperienced", y < -2))
    rows = rows.withColumns({"band": band, "score": F.round("score", 4), "skill_coverage": F.round("skill_coverage", 4), "strengths": strengths, "gaps": gaps, "risks": risks})
    reasons = F.concat("risks", F.when(sparse, F.array(F.lit("sparse_profile"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("review_reasons", reasons).withColumn("review_required", F.size("review_reasons") > 0).drop("wished")


def dashboard(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """A row for each company: postings, active ones, applications, pending ones, mean score (one decimal).

    jobs: company_id, job_id, status; matches: company_id, job_id, stage_key, match_score, is_archived.
    """
    per_job = jobs.groupBy("company_id").agg(F.count("*").alias("total_jobs"), F.count_if(F.col("status").isin("published", "paused")).alias("active_jobs"))
    live = matches.filter(~F.col("is_archived")).groupBy("company_id").agg(F.count("*").alias("n"), F.count_if(F.col("stage_key").isin("new", "reviewed")).alias("p"), F.avg("match_score").alias("m"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return per_job.join(live, "company_id", "full_outer").select("company_id", zero("total_jobs", 0).alias("total_jobs"), zero("active_jobs", 0).alias("active_jobs"), zero("n", 0).alias("applications"), zero("p", 0).alias("pending"), F.round(zero("m", 0.0), 1).alias("mean_score"))


def job_overview(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Every posting with its applicants, their mean score, and how many reach 75; archived matches do not count."""
    live = matches.filter(~F.col("is_archived")).groupBy("company_id", "job_id").agg(F.count("*").alias("n"), F.avg("match_score").alias("m"), F.count_if(F.col("match_score") >= 75).alias("q"))
    return jobs.join(live, ["company_id", "job_id"], "left").select(*jobs.columns, F.coalesce("n", F.lit(0)).alias("applicants"), F.coalesce("m", F.lit(0.0)).alias("mean_score"), F.coalesce("q", F.lit(0)).alias("qualified"))


def candidate_overview(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Every candidate with the best score of their matches (else their own, else 0), and stage and time of the latest one."""
    last = F.max(F.struct("updated_at", "match_id", "stage_key"))
    live = matches.filter(~F.col("is_archived")).groupBy("company_id", "candidate_id").agg(F.max("match_score").alias("s"), F.max("intent_score").alias("i"), last.alias("l"))
    joined = candidates.join(live, ["company_id", "candidate_id"], "left")
    return joined.select("company_id", "candidate_id", F.coalesce("s", "match_score", F.lit(0)).alias("best_score"), F.coalesce("i", "intent_score", F.lit(0)).alias("best_intent"), F.col("l.stage_key").alias("stage_key"), F.col("l.updated_at").alias("last_activity_at"))


def workflow(candidates: DataFrame, tags: DataFrame, notes: DataFrame, matches: DataFrame, most_notes: int = 100) -> DataFrame:
    """Every candidate with tags (sorted), the latest notes (most_notes is the feature), and latest stage, nested."""
    named = tags.groupBy("candidate_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    order = F.struct(F.col("created_at"), F.col("note_id"), F.col("note"))
    written = notes.groupBy("candidate_id").agg(F.slice(F.sort_array(F.collect_list(order), asc=False), 1, most_notes).alias("n"))
    stage = matches.groupBy("candidate_id").agg(F.max_by("stage_key", F.struct("updated_at", "match_id")).alias("stage_key"))
    joined = candidates.join(named, "candidate_id", "left").join(written, "candidate_id", "left").join(stage, "candidate_id", "left")
    none = F.array().cast("array<string>")
    return joined.select(*candidates.columns, F.coalesce("tags", none).alias("tags"), F.coalesce(F.transform("n", lambda x: x["note"]), none).alias("notes"), "stage_key")


def queue_counts(items: DataFrame, status: str = "status") -> DataFrame:
    """(ready, review, blocked, total) of a send queue."""
    return items.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("ready", "review", "blocked")], F.count("*").alias("total"))


def change_stages(matches: DataFrame, history: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches and their history after moves (company_id, candidate_id, job_id, stage_key, user_id, note, at).

    The last of several moves of a match counts for its stage; every move gets a row of history with the stage before it.
    """
    from pyspark.sql import Window

    key = ["company_id", "candidate_id", "job_id"]
    in_time = Window.partitionBy(*key).orderBy("at", "stage_key")
    known = matches.select(*key, F.col("stage_key").alias("old"))
    steps = moves.join(known, key, "left").withColumn("from_stage_key", F.coalesce(F.lag("stage_key").over(in_time), "old"))
    added = steps.select(*key, "from_stage_key", F.col("stage_key").alias("to_stage_key"), "user_id", "note", F.col("at").alias("created_at"))
    last = moves.groupBy(*key).agg(F.max(F.struct("at", "stage_key")).alias("l"))
    moved = matches.join(last, key, "full_outer").select(*[F.coalesce(F.col("l.stage_key"), F.col("stage_key")).alias(c) if c == "stage_key" else F.coalesce(F.col("l.at"), F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in matches.columns])
    return moved, history.unionByName(added.select(*history.columns))


def sensitivity(event_type: Column, resource: Column) -> Column:
    """Class of an audit event: by the prefix of its type, then by what it touches."""
    high = F.lit(False)
    for prefix in HIGH_PREFIXES:
        high = high | F.coalesce(event_type.startswith(prefix), F.lit(False))
    return F.when(high, "high").when(resource.isin(*MEDIUM_RESOURCES), "medium").otherwise("low")


def campaign_events(events: DataFrame, campaign: str, payload: str = "metadata") -> DataFrame:
    """Audit events of a campaign: by resource, or by the campaign id that their JSON names."""
    own = (F.col("resource_type") == "outreach_campaign") & (F.col("resource_id") == campaign)
    return events.filter(own | (F.get_json_object(payload, "$.campaign_id") == campaign) | (F.get_json_object(payload, "$.campaign.id") == campaign))


def first_that_has_rows(*tables: DataFrame) -> DataFrame:
    """The rows of the first table that has any: a fallback in one plan, each table guarded by whether those before are empty."""
    out, seen = tables[0], tables[0].agg((F.count("*") > 0).alias("any_before"))
    for t in tables[1:]:
        out = out.unionByName(t.crossJoin(F.broadcast(seen)).filter(~F.col("any_before")).drop("any_before"))  # a row
        seen = seen.unionByName(t.agg((F.count("*") > 0).alias("any_before"))).agg(F.max("any_before").alias("any_before"))
    return out
