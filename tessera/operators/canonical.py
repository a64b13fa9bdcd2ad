"""From source records to canonical postings, their links, and the features that matching reads.

Groups are reduced by one aggregate: the primary record is the greatest by an order struct, and what
only has to be the same in all members is compared by its least and greatest value, so no group is
collected, no row is multiplied for distinct counts, and a hot key is summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vocabulary as V
from tessera.operators.entity import all_equal, link_confidence, merge_reason

#: Kinds of fetches that give no external context.
NO_CONTEXT = ("", "unavailable", "error")
QUANTITATIVE = "struct<required_scripting_languages:array<string>,requires_linux:boolean,support_model_terms:array<string>,preferred_cloud_platforms:array<string>,preferred_virtualization_terms:array<string>,min_experience_years:int,minimum_stack_match_count:int>"


def keyed_records(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Active records of active sources, with the source's columns, their canonical key and their link.

    records: record_id, source_id, external_job_id, company, title, location, apply_url, canonical_url, payload,
    last_seen_at, posted_at, is_active; sources: source_id, source_type, source_name, trust, country_scope, is_active.
    """
    own = sources.filter("is_active").drop("is_active")
    rows = records.filter("is_active").drop("is_active").join(own, "source_id")
    link = F.coalesce(F.nullif(X.normalize_url(F.col("apply_url")), F.lit("")), F.nullif(X.normalize_url(F.col("canonical_url")), F.lit("")))
    fallback = F.concat_ws(":", "source_type", "source_name", "external_job_id")
    key = F.concat_ws("|", X.fold(F.col("company")), X.fold(F.col("title")), X.fold(F.col("location")), F.coalesce(link, X.fold(fallback)))
    return rows.withColumns({"link": link, "canonical_key": key})


def canonical_jobs(keyed: DataFrame, now: Column) -> DataFrame:
    """One row for each canonical key, built from its primary record and from what the group knows together."""
    described = keyed.withColumn("description", V.payload_description(F.col("payload"))).withColumn("quality", V.source_trust(F.col("trust"), F.col("source_type")))
    seconds = lambda c: F.coalesce(F.unix_micros(c), F.lit(0))
    order = F.struct(
        F.col("quality"), X.completeness(F.coalesce(F.col("description.text"), F.col("description.html"))).alias("complete"), X.freshness(now, F.col("last_seen_at"), F.col("posted_at")).alias("fresh"),
        F.col("link").isNotNull().alias("linked"), seconds("last_seen_at").alias("seen"), seconds("posted_at").alias("posted"), (-F.col("record_id")).alias("first"),
    )
    fields = F.struct("record_id", "title", "company", "location", "description", "country_scope", F.coalesce(F.nullif(F.col("apply_url"), F.lit("")), F.nullif(F.col("canonical_url"), F.lit(""))).alias("url"))
    ranked = described.select("canonical_key", order.alias("order"), fields.alias("fields"), "quality", "source_type", "link", "last_seen_at", "posted_at", *[X.fold(F.col(c)).alias(f"low_{c}") for c in ("title", "company", "location")])
    several, agreed = F.count("*") > 1, all_equal(F.col("link"))
    trust = F.max("quality") + F.least(F.lit(0.02), 0.01 * (F.size(F.collect_set("source_type")) - 1)) + F.when(several & agreed, 0.01).otherwise(0.0)  # kinds of sources are few
    reason = merge_reason(F.count("*"), agreed, *[all_equal(F.col(f"low_{c}")) for c in ("title", "company", "location")])
    groups = ranked.groupBy("canonical_key").agg(
        F.max_by("fields", "order").alias("p"), F.count("*").alias("members"), reason.alias("merge_reason"), F.max("last_seen_at").alias("last_seen_at"), F.max("posted_at").alias("posted_at"), F.round(F.least(F.lit(1.0), trust), 4).alias("trust")
    )
    title, place, text = F.col("p.title"), F.col("p.location"), F.col("p.description.text")
    return groups.select(
        "canonical_key", F.col("p.record_id").alias("primary_record"), "members", "merge_reason", link_confidence(F.col("merge_reason"), F.col("members")).alias("confidence"),
        title.alias("title"), F.col("p.company").alias("company"), X.fold(title).alias("normalized_title"), X.fold(F.col("p.company")).alias("normalized_company"),
        X.location_city(place).alias("city"), F.coalesce(V.location_country(place), F.col("p.country_scope")).alias("country"), X.workplace_type(place).alias("workplace"),
        X.employment_type(title, place, text).alias("employment"), X.seniority(title, text).alias("seniority"), V.label(V.ROLE_FAMILIES, title, text).alias("category"), V.label(V.DEPARTMENTS, title, text).alias("department"),
        text.alias("description"), F.col("p.description.html").alias("description_html"), "last_seen_at", "posted_at", F.coalesce("p.url", "canonical_key").alias("apply_url"), "trust",
        X.freshness(now, F.col("last_seen_at"), F.col("posted_at")).alias("freshness"), F.lit(True).alias("is_active"),
    )


def canonical_links(keyed: DataFrame, jobs: DataFrame) -> DataFrame:
    """(canonical_key, record_id, merge_reason, confidence): a row for each record."""
    return keyed.select("canonical_key", "record_id").join(jobs.select("canonical_key", "merge_reason", "confidence"), "canonical_key")


def refreshed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored canonical postings after a refresh: those built anew, and the others deactivated. Both have the columns of fresh."""
    gone = stored.join(fresh.select("canonical_key"), "canonical_key", "left_anti").withColumn("is_active", F.lit(False))
    return fresh.unionByName(gone.select(*fresh.columns))


def contexts(jobs: DataFrame, links: DataFrame, records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(canonical_key, snapshot): the context page of each posting, by its own link, else by the links of its records in their order.

    snapshots: url, requirements, responsibilities, technologies, culture (arrays), page_title, status, updated_at, signals.
    """
    own = jobs.select("canonical_key", F.col("apply_url").alias("url"), F.lit(0).cast("long").alias("rank"))
    linked = links.select("canonical_key", "record_id").join(records.select("record_id", F.coalesce("apply_url", "canonical_url").alias("url"), (F.col("record_id") + 1).alias("rank")), "record_id").select("canonical_key", "url", "rank")
    candidates = own.unionByName(linked).withColumn("address", X.normalize_url(F.col("url"))).filter("address <> ''")
    pages = snapshots.withColumn("address", X.normalize_url(F.col("url"))).groupBy("address").agg(F.max_by(F.struct(*snapshots.columns), F.struct("updated_at", "url")).alias("snapshot"))
    return candidates.join(pages, "address").groupBy("canonical_key").agg(F.min_by("snapshot", "rank").alias("snapshot"))


def job_features(jobs: DataFrame, context: DataFrame) -> DataFrame:
    """What matching reads of each active posting, from its own text and its context page."""
    none = F.array().cast("array<string>")
    array = lambda name: F.coalesce(F.col(f"snapshot.{name}"), none)
    signal = lambda name: F.coalesce(F.col(f"snapshot.signals.{name}"), none)
    text_of = lambda name: F.concat_ws(" ", array(name))
    linux = F.when(F.coalesce("snapshot.signals.requires_linux", F.lit(False)), F.array(F.lit("linux"))).otherwise(none)
    asked = X.merge_terms(signal("required_scripting_languages"), linux, signal("support_model_terms"), limit=16)
    wished = X.merge_terms(signal("preferred_cloud_platforms"), signal("preferred_virtualization_terms"), limit=12)
    rows = jobs.filter("is_active").join(context, "canonical_key", "left")
    rows = rows.withColumns({
        "external_requirements": X.merge_terms(V.skills(text_of("requirements"), limit=16), asked, limit=18),
        "external_technologies": X.merge_terms(array("technologies"), V.skills(text_of("technologies"), limit=16), wished, limit=18),
        "external_responsibilities": X.merge_terms(V.skills(text_of("responsibilities"), limit=16), signal("support_model_terms"), limit=18),
        "external_domains": V.labels(V.DOMAINS, F.concat_ws(" ", F.col("snapshot.page_title"), text_of("requirements"), text_of("responsibilities"), text_of("technologies"), text_of("culture"))),
        "own": V.section_skills(F.col("description")),
    })
    # Terms of a posting without a page are none, so that its parts are those of its own text alone.
    rows = rows.withColumn("enriched", F.concat_ws(" ", "description", F.concat_ws(" ", "external_requirements"), F.concat_ws(" ", "external_technologies"), text_of("responsibilities"), F.concat_ws(" ", "external_responsibilities")))
    full = F.col("enriched")
    required = X.merge_terms(F.col("own.required"), F.col("external_requirements"), F.slice(asked, 1, 10), limit=22)
    domains = X.merge_terms(
        V.labels(V.DOMAINS, F.col("title"), F.col("description")), F.col("external_domains"),
        *[F.when(c, F.array(F.lit(name))).otherwise(none) for c, name in ((F.size(signal("preferred_cloud_platforms")) > 0, "cloud"), (F.size(signal("preferred_virtualization_terms")) > 0, "virtualization"), (F.size(signal("support_model_terms")) > 0, "support"), (F.col("snapshot.signals.minimum_stack_match_count").isNotNull(), "distributed_systems"))],
        limit=12,
    )
    rows = rows.withColumns({
        "titles": X.keywords(F.col("title"), F.col("normalized_title"), limit=16),
        "locations": X.keywords(F.col("city"), F.col("country"), F.col("workplace"), limit=8),
        "skills": X.merge_terms(V.skills(F.col("title"), F.col("description"), limit=32), F.col("external_requirements"), F.col("external_technologies"), F.col("external_responsibilities"), limit=40),
        "required_skills": required,
        "languages": V.labels(V.LANGUAGES, F.col("title"), full),
        "discipline": V.label(V.DISCIPLINES, F.col("title"), full),
        "education": V.label(V.EDUCATION, F.col("title"), full),
        "years_min": F.coalesce(F.col("snapshot.signals.min_experience_years"), X.years_of_experience(full)),
        "manages": V.manages(F.col("title"), full),
        "domains": domains,
        "scope": V.label(V.SCOPES, F.col("title"), full),
    })
    nice = X.merge_terms(F.col("own.preferred"), F.col("external_technologies"), F.slice(wished, 1, 10), limit=18)
    rows = rows.withColumn("preferred_skills", F.filter(nice, lambda t: ~F.array_contains(F.col("required_skills"), t)))
    ready = V.readiness(*[F.col(c) for c in ("category", "discipline", "titles", "skills", "locations", "languages", "education", "years_min", "workplace", "employment", "seniority", "enriched")])
    chars = F.length(F.coalesce(X.strip_html(F.col("description")), X.strip_html(F.col("description_html")), F.lit("")))
    return rows.select(
        "canonical_key", F.col("category").alias("role"), "department", "discipline", "titles", "skills", "required_skills", "preferred_skills", "external_requirements", "external_technologies", "external_responsibilities",
        "locations", "languages", "education", "years_min", "manages", (~F.col("manages")).alias("contributes"), "domains", "scope", "workplace", "seniority",
        F.col("snapshot.status").alias("external_status"), F.col("snapshot.updated_at").alias("external_at"), chars.alias("description_chars"), "trust", "freshness", ready.alias("readiness"),
    )


def missing_features(jobs: DataFrame, features: DataFrame) -> DataFrame:
    """Active postings whose features have not been built yet."""
    return jobs.filter("is_active").join(features.select("canonical_key"), "canonical_key", "left_anti")


def transient_jobs(jobs: DataFrame, snapshots: DataFrame, now: Column) -> DataFrame:
    """Canonical rows built on the fly from plain postings, each by itself.

    jobs: job_id, source_name, source_type, title, company, location, url, posted_at, last_seen_at, first_seen_at, is_active;
    the description comes from the page with the posting's link, where there is one (url, clean_text).
    """
    pages = snapshots.groupBy("url").agg(F.max("clean_text").alias("description"))
    rows = jobs.join(pages, "url", "left")
    title, place, text = F.col("title"), F.col("location"), F.col("description")
    return rows.select(
        X.canonical_key(F.col("company"), title, place, F.col("url"), F.concat(F.lit("legacy:"), F.col("job_id"))).alias("canonical_key"), "job_id", "title", "company", X.fold(title).alias("normalized_title"),
        X.location_city(place).alias("city"), V.location_country(place).alias("country"), X.workplace_type(place).alias("workplace"), X.employment_type(title, place, text).alias("employment"), X.seniority(title, text).alias("seniority"),
        V.label(V.ROLE_FAMILIES, title, text).alias("category"), V.label(V.DEPARTMENTS, title, text).alias("department"), text.alias("description"), F.lit(None).cast("string").alias("description_html"), F.col("url").alias("apply_url"),
        V.hinted_trust(F.col("source_name"), F.col("source_type"), F.col("url")).alias("trust"), V.legacy_freshness(now, F.col("posted_at"), F.col("last_seen_at"), F.col("first_seen_at")).alias("freshness"), "is_active",
    )


def linked_by_url(pages: DataFrame, records: DataFrame) -> DataFrame:
    """(page_id, record_id, reason): the records that a page belongs to, by the first rule that finds any.

    pages: page_id, url, external_id, provider_id, title, company; records: record_id, apply_url, canonical_url, external_job_id,
    title, company. Rules: the same link; the same external id; the provider's id in a link; the same title and company.
    A page that no rule links has no row. Every rule is an equi-join; ids in links are the links' own parts.
    """
    urls = records.select("record_id", F.explode(F.array("apply_url", "canonical_url")).alias("url")).select("record_id", X.normalize_url(F.col("url")).alias("address")).filter("address <> ''")
    parts = urls.select("record_id", F.explode(F.array_distinct(F.filter(F.split("address", "[/?&=#]"), lambda p: p != ""))).alias("provider_id"))
    pair = lambda df, *keep: df.select(*keep, F.concat_ws("|", X.fold(F.col("title")), X.fold(F.col("company"))).alias("both")).filter("both <> '|'")
    found = [
        pages.select("page_id", X.normalize_url(F.col("url")).alias("address")).filter("address <> ''").join(urls, "address").select("page_id", "record_id", F.lit(1).alias("rule")),
        pages.select("page_id", F.col("external_id").alias("external_job_id")).filter("external_job_id <> ''").join(records.select("record_id", "external_job_id"), "external_job_id").select("page_id", "record_id", F.lit(2).alias("rule")),
        pages.select("page_id", "provider_id").filter("provider_id <> ''").join(parts, "provider_id").select("page_id", "record_id", F.lit(3).alias("rule")),
        pair(pages, "page_id").join(pair(records, "record_id"), "both").select("page_id", "record_id", F.lit(4).alias("rule")),
    ]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    best = every.groupBy("page_id").agg(F.min("rule").alias("rule"))
    reason = F.element_at(F.array(*map(F.lit, ("url_exact", "external_id", "provider_id_in_url", "title_company"))), F.col("rule"))
    return every.join(best, ["page_id", "rule"], "left_semi").select("page_id", "record_id", reason.alias("reason")).distinct()
