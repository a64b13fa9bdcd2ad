"""Queries over personal data in documents: findings with offsets, redacted texts, what each kind holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import redaction as R
from tessera.plans.base import query, table

#: A document's first two words stand for the name of its person.
NAME = r"nullif(regexp_extract(text, '^([^ \t\n]+ [^ \t\n]+)', 1), '')"
LETTER = r"[\p{L}\p{N}_]"
WORDS = "|".join(w for w in R.STREETS if not w.endswith("."))
DOTTED = "|".join(w.replace(".", r"\.") for w in R.STREETS if w.endswith("."))
STREET = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:(?:{WORDS})(?:$|[^\p{{L}}\p{{N}}_])|(?:{DOTTED}){LETTER})"
SPACED_PHONE = R.PHONE.replace(r"\s", r"\s\x0b")


def _hits_sql(place: int, pattern: str, replacement: str, where: str = "true") -> str:
    """Leftmost matches with their starts: lengths of what lies between matches, and of the matches, added up."""
    return f"""SELECT doc_id, {place} AS k, s, s + length(raw) AS e, raw, {replacement} AS r FROM (
      SELECT *, (sum(length(piece)) OVER w + sum(length(raw)) OVER w - length(raw))::INTEGER AS s FROM (
        SELECT doc_id, unnest(hits) AS raw, unnest(parts[:len(hits)]) AS piece, generate_subscripts(hits, 1) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, {pattern}) AS hits, string_split_regex(text, {pattern}) AS parts FROM d WHERE {where.split(" AND HIT ")[0]}))
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {where.split(" AND HIT ")[1] if " AND HIT " in where else "true"}"""


def _findings_sql() -> str:
    digits = r"length(regexp_replace(raw, '[^0-9]', '', 'g'))"
    hidden = " ".join(f"WHEN contains(raw, '{h}') THEN split_part(raw, '{h}', 1) || '{h}{R.REPLACEMENT['social_profile']}'" for h in R.HANDLES)
    profile = " OR ".join(f"contains(lower(raw), '{p}')" for p in R.PROFILES)
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, {NAME} AS name FROM documents WHERE text IS NOT NULL),
      a AS (
        {_hits_sql(0, "'(?i)' || regexp_escape(name)", f"'{R.REPLACEMENT['full_name']}'", f"length(trim(name)) >= {R.NAME_LETTERS}")}
        UNION ALL {_hits_sql(1, f"'{R.EMAIL}'", f"'{R.REPLACEMENT['email']}'")}
        UNION ALL {_hits_sql(2, f"'{SPACED_PHONE}'", f"'{R.REPLACEMENT['phone_number']}'", f"true AND HIT {digits} BETWEEN {R.PHONE_DIGITS[0]} AND {R.PHONE_DIGITS[1]}")}
        UNION ALL SELECT doc_id, 3, s, s + length(raw), raw, '{R.REPLACEMENT['address']}' FROM (
          SELECT doc_id, raw, i, (sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(raw) - 1)::INTEGER AS s FROM (
            SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d)))
          WHERE regexp_matches(raw, '{STREET}') AND regexp_matches(raw, '[0-9,;]')
        UNION ALL {_hits_sql(4, f"'{R.URL}'", f"CASE {hidden} ELSE '{R.REPLACEMENT['social_profile']}' END", f"true AND HIT ({profile})")}),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, k) AS n FROM a),
      j AS (SELECT x.doc_id, x.n, min(y.n) AS after FROM f x LEFT JOIN f y ON x.doc_id = y.doc_id AND y.s >= x.e GROUP BY 1, 2),
      c AS (SELECT doc_id, n, after FROM j WHERE n = 1 UNION ALL SELECT j.doc_id, j.n, j.after FROM c JOIN j ON j.doc_id = c.doc_id AND j.n = c.after),
      p AS (SELECT f.*, c.n IS NOT NULL AS applied, (s + coalesce(sum(CASE WHEN c.n IS NOT NULL THEN length(r) - (e - s) ELSE 0 END) OVER (PARTITION BY f.doc_id ORDER BY f.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS t
            FROM f LEFT JOIN c USING (doc_id, n)),
      v AS (SELECT doc_id, n, s, e, raw, r, applied, t, ['{"', '".join(R.KINDS)}'][k + 1] AS kind FROM p)"""


FINDINGS_SQL = _findings_sql()


def _found(spark, d):
    """Everything that is found: every line that is an address, however many a text has."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", R.redaction(F.col("text"), F.expr(NAME.replace("\\", "\\\\")), address_lines=None).alias("r"))


@query(
    "redaction_findings",
    FINDINGS_SQL
    + f""" SELECT doc_id, kind, s AS start_offset, e AS end_offset, r AS replacement, sha256(raw) AS raw_sha256,
             CASE kind {' '.join(f"WHEN '{k}' THEN {c}" for k, c in R.CONFIDENCE.items())} END::DOUBLE AS confidence, applied,
             CASE WHEN applied THEN t END AS new_start, CASE WHEN applied THEN t + length(r) END::INTEGER AS new_end FROM v""",
)
def redaction_findings(spark, d):
    """All personal data of every whole text, with offsets before and after redaction."""
    rows = _found(spark, d).select("doc_id", F.explode("r.findings").alias("f")).select("doc_id", "f.*")
    return rows.withColumn("raw_sha256", F.sha2("raw", 256)).drop("raw")


@query(
    "redacted_documents",
    FINDINGS_SQL
    + """, g AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY n), 0) AS z FROM v WHERE applied),
           m AS (SELECT g.doc_id, string_agg(substring(text, z + 1, s - z) || r, '' ORDER BY n) AS head, max(e) AS z, count(*) AS applied FROM g JOIN documents USING (doc_id) GROUP BY 1),
           o AS (SELECT doc_id, count(*) AS findings FROM v GROUP BY 1)
         SELECT doc_id, coalesce(findings, 0) AS findings, coalesce(applied, 0) AS applied, sha256(CASE WHEN head IS NULL THEN text ELSE head || substring(text, z + 1) END) AS redacted_sha256
         FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN o USING (doc_id)""",
)
def redacted_documents(spark, d):
    """Every whole text with its personal data replaced, as a digest."""
    counted = lambda c: F.size(c).cast("long")
    return _found(spark, d).select("doc_id", counted(F.col("r.findings")).alias("findings"), counted(F.filter("r.findings", lambda f: f["applied"])).alias("applied"), F.sha2("r.redacted", 256).alias("redacted_sha256"))


@query(
    "redaction_maps",
    FINDINGS_SQL
    + """, u AS (SELECT doc_id, kind, raw, min((s, -e)) AS o FROM v GROUP BY 1, 2, 3)
         SELECT doc_id, kind, count(*) AS n_values, string_agg(raw, chr(10) ORDER BY o) AS raw_values FROM u GROUP BY 1, 2""",
)
def redaction_maps(spark, d):
    """The different raw texts of each kind in each document."""
    rows = _found(spark, d).select("doc_id", F.explode(R.redaction_map(F.col("r.findings"))).alias("kind", "found"))
    return rows.select("doc_id", "kind", F.size("found").cast("long").alias("n_values"), F.array_join("found", "\n").alias("raw_values"))
