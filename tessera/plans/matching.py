"""Match queries: one profile against all postings, explanations, insights, candidates for postings, and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import employers as P
from tessera.operators import explain as X
from tessera.operators import matching as M
from tessera.plans.base import query, table
from tessera.plans.operational import AFFINITY_SQL
from tessera.streaming import events as S

PROFILE = {
    "skills": ["red", "ring", "small", "steel"], "roles": ["ECONOMY", "SMALL"], "locations": ["Brand#2", "Brand#17"], "titles": ["red", "ring", "widget"], "disciplines": ["backend"], "domains": ["fintech", "saas"],
    "languages": ["english"], "evidence_terms": ["red", "steel"], "ownership_signals": ["technical_leadership", "architecture"], "impact_signals": ["delivery"],
}


def terms(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def profile_column():
    plain = {"seniority": "senior", "scope": "tech-lead", "education": "bachelor", "remote_preference": "remote"}
    return F.struct(*[terms(v).alias(k) for k, v in PROFILE.items()], *[F.lit(v).alias(k) for k, v in plain.items()], F.lit(6).alias("years"), F.lit(True).alias("manages"))


def by_rest(part: int, *values: str | None) -> Column:
    """The value at the place that the key leaves when divided; null beyond the last."""
    return F.try_element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % part + 1).cast("int"))


def posting_column():
    """Postings made from parts by rule: every component of a match takes all of its values."""
    words, k = F.split("p_name", " "), F.col("p_partkey")
    none = terms([])
    level = F.when(F.col("p_size") > 40, "lead").when(F.col("p_size") > 20, "senior").when(F.col("p_size") > 10, "mid")
    page = k % 4 == 1
    return F.struct(
        words.alias("skills"), F.when(k % 3 == 0, F.slice(words, 1, 2)).otherwise(none).alias("required_skills"), F.when(k % 4 == 0, F.slice(words, 2, 1)).otherwise(none).alias("preferred_skills"), words.alias("titles"),
        F.col("p_type").alias("role"), by_rest(3, "backend", "mobile").alias("discipline"), F.when(k % 4 == 0, terms(["fintech"])).when(k % 4 == 1, terms(["gaming"])).otherwise(none).alias("domains"),
        F.when(k % 5 == 0, terms(["english", "german"])).when(k % 5 == 1, terms(["english"])).otherwise(none).alias("languages"), F.array("p_brand").alias("locations"), by_rest(5, "remote", "hybrid", "onsite", "remote").alias("workplace"),
        level.alias("seniority"), F.when(F.col("p_size") < 45, F.floor(F.col("p_size") / 5).cast("int")).alias("years_min"), by_rest(6, "ic", "senior-ic", "tech-lead", "architect", "manager").alias("scope"),
        by_rest(7, "bachelor", "master", "doctorate").alias("education"), (F.col("p_size") * 40).alias("description_chars"), (0.5 + k % 5 * 0.1).alias("trust"), (0.4 + k % 6 * 0.1).alias("freshness"), (0.3 + k % 7 * 0.1).alias("readiness"),
        F.when(page, "ok").alias("external_status"), F.when(page, terms(["linux", "git"])).otherwise(none).alias("external_requirements"), F.when(page, terms(["kafka"])).otherwise(none).alias("external_technologies"), none.alias("external_responsibilities"),
    )


def quoted(values) -> str:
    return "[" + ", ".join(f"'{t}'" for t in values) + "]"


HAS = {k: (lambda x, v=v: f"list_contains({quoted(v)}, {x})") for k, v in PROFILE.items()}
#: The postings and every component by the values that the one profile fixes, each rounded as the operator rounds.
RAW_SQL = f"""p AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS w, p_type, p_brand, p_size, CASE WHEN p_size > 40 THEN 5 WHEN p_size > 20 THEN 4 WHEN p_size > 10 THEN 3 END AS level,
    CASE WHEN p_size < 45 THEN p_size // 5 END AS years, CASE WHEN p_partkey % 3 = 0 THEN w[1:2] ELSE [] END AS req, CASE WHEN p_partkey % 4 = 0 THEN w[2:2] ELSE [] END AS pref, p_partkey % 4 = 1 AS page,
    0.5 + p_partkey % 5 * 0.1 AS trust, 0.4 + p_partkey % 6 * 0.1 AS fresh, 0.3 + p_partkey % 7 * 0.1 AS ready, p_size * 40 AS chars,
    CASE p_partkey % 5 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' WHEN 3 THEN 'remote' END AS workplace FROM part),
  e AS (SELECT *, CASE WHEN len(req) > 0 THEN req ELSE w END AS eff FROM p),
  h AS (SELECT *, list_filter(eff, lambda x: {HAS['skills']('x')}) AS hit, list_filter(eff, lambda x: NOT {HAS['skills']('x')}) AS lack, list_filter(pref, lambda x: {HAS['skills']('x')}) AS nice,
    len(list_filter(eff, lambda x: {HAS['skills']('x')} AND {HAS['evidence_terms']('x')})) AS shown, len(list_intersect(w, {quoted(PROFILE['titles'])})) * 1.0 / len(list_distinct(list_concat(w, {quoted(PROFILE['titles'])}))) AS jac FROM e),
  r AS (SELECT *, round(least(greatest(0, least(1.0, least(1.0, 0.10 + 0.90 * len(hit) / least(10, len(eff)) + CASE WHEN len(pref) > 0 THEN 0.08 * len(nice) / least(6, len(pref)) ELSE 0 END)
      + CASE WHEN len(hit) = 0 THEN 0 WHEN shown / len(hit) >= 0.75 THEN 0.06 WHEN shown / len(hit) >= 0.45 THEN 0.03 WHEN shown = 0 AND len(hit) >= 2 THEN -0.08 ELSE 0 END)),
      CASE WHEN len(lack) >= 3 THEN 0.30 WHEN len(lack) = 2 THEN 0.52 ELSE 1.0 END), 4) AS skill,
    CASE WHEN {HAS['roles']('p_type')} THEN 1.0 ELSE 0.16 END AS role, CASE WHEN level IS NULL THEN 0.58 WHEN level = 4 THEN 1.0 WHEN level = 3 THEN 0.82 ELSE 0.72 END AS seniority,
    CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.20 ELSE 0.50 END AS discipline, CASE k % 4 WHEN 0 THEN 0.84 WHEN 1 THEN 0.22 ELSE 0.55 END AS domain,
    CASE WHEN {HAS['locations']('p_brand')} THEN 1.0 WHEN workplace = 'remote' THEN 0.88 ELSE 0.18 END AS location,
    CASE WHEN years IS NULL THEN 0.55 WHEN 6 - years >= 3 THEN 1.0 WHEN 6 - years >= 1 THEN 0.9 WHEN 6 = years THEN 0.8 WHEN 6 - years = -1 THEN 0.52 WHEN 6 - years = -2 THEN 0.30 ELSE 0.14 END AS experience,
    round(0.20 + least(0.80, jac * 1.4), 4) AS title, CASE k % 6 WHEN 0 THEN 0.44 WHEN 1 THEN 0.82 WHEN 2 THEN 1.0 WHEN 3 THEN 0.78 WHEN 4 THEN 0.50 ELSE 0.56 END AS scope,
    CASE workplace WHEN 'remote' THEN 1.0 WHEN 'hybrid' THEN 0.68 WHEN 'onsite' THEN 0.18 ELSE 0.55 END AS place, CASE k % 5 WHEN 0 THEN 0.59 WHEN 1 THEN 1.0 ELSE 0.65 END AS language,
    CASE k % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.52 WHEN 2 THEN 0.18 ELSE 0.62 END AS education FROM h),
  f AS (SELECT *, round(round(skill * 0.26, 4) + round(role * 0.14, 4) + round(seniority * 0.08, 4) + round(discipline * 0.09, 4) + round(domain * 0.06, 4) + round(location * 0.09, 4) + round(experience * 0.08, 4)
    + round(title * 0.05, 4) + round(scope * 0.04, 4) + round(place * 0.05, 4) + round(language * 0.03, 4) + round(education * 0.03, 4), 4) AS fit,
    round(CASE WHEN chars >= 1200 THEN 0.28 WHEN chars >= 700 THEN 0.24 WHEN chars >= 350 THEN 0.20 WHEN chars >= 180 THEN 0.14 WHEN chars >= 80 THEN 0.08 ELSE 0 END + CASE WHEN page THEN 0.20 + 0.04 + 0.015 ELSE 0 END
      + CASE WHEN len(req) > 0 THEN least(0.14, len(req) * 0.02) ELSE least(0.08, len(w) * 0.01) END + len(pref) * 0.0125 + CASE k % 5 WHEN 0 THEN 0.04 WHEN 1 THEN 0.02 ELSE 0 END + CASE WHEN k % 4 < 2 THEN 0.015 ELSE 0 END
      + CASE WHEN k % 6 < 5 THEN 0.05 ELSE 0 END + CASE WHEN years IS NULL THEN 0 ELSE 0.04 END + 0.03 + CASE WHEN k % 3 < 2 THEN 0.03 ELSE 0 END, 4) AS analysis,
    CASE WHEN len(req) > 0 THEN least(0.28, len(req) * 0.035) ELSE least(0.18, len(w) * 0.02) END + len(pref) * 0.025 + CASE WHEN k % 4 < 2 THEN 0.04 ELSE 0 END + CASE WHEN k % 6 < 5 THEN 0.12 ELSE 0 END
      + CASE WHEN years IS NULL THEN 0 ELSE 0.08 END + CASE k % 5 WHEN 0 THEN 0.06 WHEN 1 THEN 0.03 ELSE 0 END + CASE WHEN page THEN 0.10 + 0.04 + 0.025 ELSE 0 END AS content FROM r),
  g AS (SELECT *, round(trust * 0.22 + fresh * 0.18 + ready * 0.33 + content * 0.12 + analysis * 0.15, 4) AS catalog FROM f),
  i AS (SELECT *, CASE WHEN k % 10 = 0 THEN round(fit * 0.86 + catalog * 0.09 + 0.8 * 0.05, 4) ELSE round(fit * 0.91 + catalog * 0.09, 4) END AS total FROM g),
  s AS (SELECT *, CASE WHEN analysis < 0.38 THEN round(total * 0.92, 4) WHEN analysis < 0.52 THEN round(total * 0.97, 4) WHEN analysis >= 0.82 THEN round(least(1.0, total + 0.01), 4) ELSE total END AS final,
    CASE WHEN skill <= 0.30 THEN lack[1:6] ELSE [] END AS blockers FROM i)"""
SCORE_SQL = f"WITH {RAW_SQL} SELECT k AS p_partkey, fit::DOUBLE AS fit, catalog::DOUBLE AS catalog, final::DOUBLE AS final, array_to_string(blockers, ' ') AS blockers FROM s"


def scored(spark, d):
    """Every posting with its scores; the profile goes along as a literal."""
    pairs = table(spark, d, "part").select("p_partkey", profile_column().alias("profile"), posting_column().alias("posting"))
    return M.scores(pairs, "profile", "posting", F.when(F.col("p_partkey") % 10 == 0, F.lit(0.8)))


@query("match_scores", SCORE_SQL)
def match_scores(spark, d):
    return scored(spark, d).select("p_partkey", "fit", "catalog", "final", F.array_join("blockers", " ").alias("blockers"))


BEST_SQL = "final DESC, fit DESC, ready DESC, trust DESC, fresh DESC, k DESC"


@query("match_ranking", f"WITH {RAW_SQL} SELECT k AS p_partkey, final::DOUBLE AS final, row_number() OVER (ORDER BY {BEST_SQL})::INTEGER AS place FROM s WHERE final >= 0.3 ORDER BY place LIMIT 25")
def match_ranking(spark, d):
    """The 25 best are the feature; their places are numbered after the limit, and the least score is asked for after both."""
    best = scored(spark, d).orderBy(*M.best_first("posting", "p_partkey")).limit(25)
    return M.ranked(best.withColumn("profile_id", F.lit(1)), "profile_id", "p_partkey", "posting", 25, 0.3).select("p_partkey", "final", "place")


@query("match_single", f"WITH {RAW_SQL} SELECT k AS p_partkey, round(fit * 0.91 + catalog * 0.09, 4)::DOUBLE AS plain, fit::DOUBLE AS fit FROM s WHERE k = 7")
def match_single(spark, d):
    """One posting; the filter reaches the scan."""
    pairs = table(spark, d, "part").select("p_partkey", profile_column().alias("profile"), posting_column().alias("posting"))
    return M.match_of(pairs, "p_partkey", 7).select("p_partkey", F.round(F.col("fit") * 0.91 + F.col("catalog") * 0.09, 4).alias("plain"), "fit")


@query("saved_snapshots", f"WITH {RAW_SQL} SELECT k AS p_partkey, fit::DOUBLE AS fit, catalog::DOUBLE AS catalog FROM s WHERE k IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def saved_snapshots(spark, d):
    pairs = table(spark, d, "part").select("p_partkey", profile_column().alias("profile"), posting_column().alias("posting"))
    saved = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"))
    return M.saved_snapshots(saved, pairs, ["p_partkey"]).select("p_partkey", "fit", "catalog")


LEVEL_SQL = "CASE WHEN analysis >= 0.66 THEN 'strong' WHEN analysis >= 0.40 THEN 'moderate' ELSE 'limited' END"
#: Codes of evidence and gaps in their order, from the components' values.
EXPLAIN_SQL = f"""WITH {RAW_SQL}, t AS (SELECT *, {LEVEL_SQL} AS verdict, list_filter([
    CASE WHEN (skill >= 0.55 OR len(hit) + len(nice) >= 3 AND round(skill * 0.26, 4) >= 0.12) AND len(hit) + len(nice) > 0 THEN 'skill_overlap_high' END, CASE WHEN role = 1 THEN 'role_family_match' END,
    CASE WHEN seniority >= 0.8 THEN 'seniority_match' END, CASE WHEN domain >= 0.76 THEN 'domain_experience_match' END, CASE WHEN discipline = 1 THEN 'discipline_preference_match' END,
    CASE WHEN location >= 0.55 THEN 'location_preference_match' END, CASE WHEN experience >= 0.8 THEN 'experience_requirement_covered' END, CASE WHEN scope >= 0.8 THEN 'scope_alignment' END,
    CASE WHEN workplace IN ('remote', 'hybrid') THEN 'workplace_mode_match' END, CASE WHEN title >= 0.55 AND jac > 0 THEN 'title_similarity_strong' END, CASE WHEN k % 5 < 2 THEN 'language_requirement_covered' END,
    CASE WHEN k % 7 = 0 THEN 'education_requirement_covered' END], lambda x: x IS NOT NULL)[1:4] AS ev, list_filter([
    CASE WHEN skill < 0.75 AND len(blockers) > 0 AND skill < 0.35 THEN 'skill_hard_blocker' WHEN skill < 0.75 AND len(lack) + len(pref) - len(nice) > 0 THEN 'skill_gap_detected' END,
    CASE WHEN scope < 0.5 THEN 'responsibility_scope_gap' END, CASE WHEN experience < 0.7 THEN 'experience_gap_detected' END, CASE WHEN domain < 0.45 THEN 'domain_experience_gap' END, CASE WHEN k % 5 = 0 THEN 'language_requirement_gap' END,
    CASE WHEN location < 0.45 THEN 'location_preference_gap' END, CASE WHEN place < 0.45 THEN 'workplace_preference_gap' END, CASE WHEN k % 7 IN (1, 2) THEN 'education_signal_gap' END,
    CASE WHEN role < 0.4 THEN 'role_alignment_gap' END], lambda x: x IS NOT NULL)[1:4] AS ga, greatest(round(skill * 0.26, 4), round(role * 0.14, 4), round(seniority * 0.08, 4), round(discipline * 0.09, 4), round(domain * 0.06, 4), round(location * 0.09, 4), round(experience * 0.08, 4),
      round(title * 0.05, 4), round(scope * 0.04, 4), round(place * 0.05, 4), round(language * 0.03, 4), round(education * 0.03, 4)) AS top FROM s),
  u AS (SELECT *, CASE WHEN verdict = 'strong' THEN list_append(ev[1:3], 'job_content_verified') WHEN len(ev) = 0 THEN ['fallback_' || list_filter([CASE WHEN round(skill * 0.26, 4) = top THEN 'skill' END, CASE WHEN round(role * 0.14, 4) = top THEN 'role' END, CASE WHEN round(seniority * 0.08, 4) = top THEN 'seniority' END,
      CASE WHEN round(discipline * 0.09, 4) = top THEN 'discipline' END, CASE WHEN round(location * 0.09, 4) = top THEN 'location' END, CASE WHEN round(experience * 0.08, 4) = top THEN 'experience' END], lambda x: x IS NOT NULL)[1]] ELSE ev END AS evidence, CASE WHEN verdict = 'limited' AND len(ga) < 4 THEN list_append(ga, 'job_content_partial') ELSE ga END AS gaps FROM t)
  SELECT k AS p_partkey, verdict AS level, array_to_string(evidence, ' ') AS evidence, array_to_string(gaps, ' ') AS gaps, array_to_string(list_filter([evidence[1], evidence[2], CASE WHEN k % 10 = 0 THEN 'recent_engagement' ELSE gaps[1] END,
    CASE verdict WHEN 'strong' THEN 'strong_content' WHEN 'limited' THEN 'partial_content' END], lambda x: x IS NOT NULL)[1:3], ' ') AS reasons FROM u"""


@query("match_explanations", EXPLAIN_SQL)
def match_explanations(spark, d):
    """Codes of every posting's evidence, gaps and reasons."""
    rows = X.explained(scored(spark, d), "profile", "posting", F.when(F.col("p_partkey") % 10 == 0, F.lit(0.8)))
    codes = lambda name: F.array_join(F.transform(name, lambda x: x["code"]), " ").alias(name)
    return rows.select("p_partkey", F.col("coverage.level").alias("level"), codes("evidence"), codes("gap_analysis").alias("gaps"), F.array_join("reasons", " ").alias("reasons"))


@query("match_strengths", f"""WITH {RAW_SQL}, b AS (SELECT * FROM s ORDER BY {BEST_SQL} LIMIT 40), m AS (SELECT * FROM b WHERE final >= 0.55), t AS (SELECT unnest(list_distinct(list_concat(hit, nice))) AS term FROM m)
  SELECT term, count(*) AS items, (SELECT count(*) FROM m) AS total FROM t GROUP BY 1 ORDER BY items DESC, term LIMIT 5""")
def match_strengths(spark, d):
    """What the matched ones of the forty best share with the profile; forty and five are the feature."""
    return insight_parts(spark, d)[1]


@query("match_gaps", f"""WITH {RAW_SQL}, b AS (SELECT * FROM s ORDER BY {BEST_SQL} LIMIT 40), c AS (SELECT * FROM b WHERE final >= 0.45 ORDER BY {BEST_SQL} LIMIT 20),
  t AS (SELECT unnest(CASE WHEN len(blockers) > 0 THEN list_distinct(blockers) ELSE list_distinct(list_concat(lack, list_filter(pref, lambda x: NOT list_contains(nice, x))))[1:6] END) AS term, CASE WHEN len(blockers) > 0 THEN 2 ELSE 1 END AS weight FROM c)
  SELECT term, sum(weight)::BIGINT AS weight, least(100, round_even(sum(weight) * 100.0 / (SELECT greatest(1, count(*)) FROM c), 0))::INTEGER AS percent FROM t GROUP BY 1 ORDER BY weight DESC, term LIMIT 5""")
def match_gaps(spark, d):
    """The five heaviest gaps of the twenty best postings are the feature."""
    return insight_parts(spark, d)[2]


def insight_parts(spark, d):
    rows = scored(spark, d)
    have, lack = X.component_terms(lambda n: F.col(f"profile.{n}"), lambda n: F.col(f"posting.{n}"))["skill"]
    return M.insights(rows, "posting", (have, lack), M.best_first("posting", "p_partkey"))


EMPLOYER_SQL = """WITH c AS (SELECT c_custkey, c_custkey % 4 AS skills, c_custkey % 5 AS lvl, (c_custkey % 9)::DOUBLE AS years, c_custkey % 3 AS place, c_custkey % 4 AS wish, c_custkey % 2 AS role, c_custkey % 3 AS lang, c_custkey % 6 AS edu FROM customer),
  r AS (SELECT *, CASE skills WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS present, CASE WHEN skills < 2 THEN 1 ELSE 0 END AS wished, CASE lvl WHEN 0 THEN 0 ELSE lvl + 1 END - 4 AS delta FROM c),
  p AS (SELECT *, 0.7 * present / 3 + 0.3 * wished / 2 AS cover, CASE WHEN delta >= 0 THEN greatest(0, 1.0 - delta * 0.08) ELSE greatest(0, 1.0 + delta * 0.25) END AS level, CASE WHEN years >= 4 THEN 1.0 ELSE (years / 4) ** 1.5 END AS exper,
    CASE role WHEN 0 THEN 1.0 ELSE 1.0 / 3 END AS rel, CASE place WHEN 0 THEN 1.0 ELSE 0 END AS loc, CASE wish WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0 END AS works, CASE lang WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END AS speak,
    CASE WHEN edu >= 3 THEN 1.0 ELSE edu / 3 END AS degree FROM r),
  t AS (SELECT *, least(1.0, 0.35 * cover + 0.15 * level + 0.12 * exper + 0.12 * rel + 0.10 * loc + 0.08 * works + 0.05 * speak + 0.03 * degree) AS score FROM p)
  SELECT c_custkey, round(score, 4)::DOUBLE AS score, CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.70 THEN 'strong' WHEN score >= 0.50 THEN 'moderate' WHEN score >= 0.30 THEN 'weak' ELSE 'poor' END AS band,
    array_to_string(list_filter([CASE WHEN 3 - present > 0 AND 3 - present >= 2 THEN 'missing_required_skills' END, CASE WHEN delta <= -2 THEN 'underqualified_seniority' END, CASE WHEN years - 4 < -2 THEN 'underexperienced' END,
      CASE WHEN skills = 3 THEN 'sparse_profile' END], lambda x: x IS NOT NULL), ' ') AS reasons FROM t"""


@query("employer_match", EMPLOYER_SQL)
def employer_match(spark, d):
    """Candidates made from customers by rule, each against one posting."""
    k = F.col("c_custkey")
    pick = lambda n, *values: F.try_element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (k % n + 1).cast("int"))
    candidate = F.struct(
        pick(4, terms(["Python", "SQL", "Kafka", "AWS"]), terms(["python", "sql", "aws"]), terms(["python"]), terms([])).alias("skills"), pick(5, None, "junior", "mid", "senior", "lead").alias("seniority"), (k % 9).cast("double").alias("years"),
        pick(3, terms(["Berlin, Germany"]), terms(["Paris"]), terms([])).alias("locations"), pick(4, "remote", "hybrid", "onsite", None).alias("remote_preference"), pick(2, "Data Engineering", "data science").alias("role"),
        pick(3, terms(["English", "German"]), terms(["english"]), terms([])).alias("languages"), pick(6, None, "high_school", "associate", "bachelor", "master", "doctorate").alias("education"), F.lit("someone").alias("headline"),
    )
    posting = F.struct(
        terms(["python", "sql", "kafka"]).alias("required_skills"), terms(["aws", "gcp"]).alias("preferred_skills"), F.lit("senior").alias("seniority"), F.lit(4.0).alias("years_min"), terms(["berlin"]).alias("locations"), F.lit("hybrid").alias("workplace"),
        F.lit("data engineering").alias("role"), terms(["english", "german"]).alias("languages"), F.lit("bachelor").alias("education"),
    )
    rows = P.scored_candidates(table(spark, d, "customer").select("c_custkey", posting.alias("posting"), candidate.alias("candidate")))
    return rows.select("c_custkey", "score", "band", F.array_join("review_reasons", " ").alias("reasons"))


def shared(spark, name: str) -> str:
    """A new folder where driver and executors both write: in spark.checkpoint.dir, or on one machine in the warehouse where it is unset."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("streamed_affinity", AFFINITY_SQL)
def streamed_affinity(spark, d):
    """The stream of all events, brought up to date; its last state equals the table's."""
    where = shared(spark, "affinity")
    schema = table(spark, d, "events").schema
    q = S.rollup(S.source(spark, f"{d}/event[s].parquet", schema), shared(spark, "cursor"), lambda rows, epoch: rows.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(where))
    q.awaitTermination()
    return S.latest_state(spark.read.parquet(where), "user_id", "epoch").drop("epoch")


@query("windowed_events", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS items, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    found = S.windowed(table(spark, d, "events"))
    return found.select("event_type", F.col("window.start").alias("hour"), "items", F.round("value", 4).alias("value"))


#: A window opens at the first event outside the last one, so the windows of a user follow one another: a recursion over events in order.
RATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  w AS (SELECT user_id, event_id, k, ts + INTERVAL 3600 SECOND AS ends, 1 AS n, 0::BIGINT AS wait FROM e WHERE k = 1
    UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.ts >= w.ends THEN e.ts + INTERVAL 3600 SECOND ELSE w.ends END, CASE WHEN e.ts >= w.ends THEN 1 WHEN w.n >= 3 THEN w.n ELSE w.n + 1 END,
      CASE WHEN e.ts < w.ends AND w.n >= 3 THEN greatest(1, floor(epoch(w.ends) - epoch(e.ts)))::BIGINT ELSE 0 END
    FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
  SELECT user_id, event_id, wait FROM w"""


@query("rate_limited", RATE_SQL)
def rate_limited(spark, d):
    return S.rate_limited_batch(table(spark, d, "events").select("user_id", "event_id", "ts"), limit=3, seconds=3600)
