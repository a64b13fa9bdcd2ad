"""Queries over chunks, vectors and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.plans.base import query, table


def query_vector(items):
    """The vector of item 0; an empty one, to which nothing is similar, where it is absent or null."""
    row = items.filter("vec_id = 0").select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in (row and row["embedding"]) or ()]).cast("array<double>")


@query(
    "vector_search",
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
       SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 6) AS similarity FROM embeddings, q WHERE vec_id <> 0
       ORDER BY similarity DESC, vec_id LIMIT 12""",
)
def vector_search(spark, d):
    """The twelve nearest are the feature."""
    items = table(spark, d, "embeddings")
    found = R.search(items.filter("vec_id <> 0"), query_vector(items), "embedding", "vec_id", 12)
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(
    "filtered_search",
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q.e) AS s FROM embeddings, q WHERE vec_id <> 0 AND label <= 4)
       SELECT vec_id, label, round(s, 6) AS similarity, (SELECT count(*) FROM c) AS total_candidates FROM c WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 12""",
)
def filtered_search(spark, d):
    """The twelve nearest of the wanted labels are the feature."""
    items = table(spark, d, "embeddings")
    found = R.filtered_search(items, query_vector(items), "embedding", "vec_id", 12, 0.05, F.expr("vec_id <> 0 and label <= 4"))
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), "total_candidates")


def vector_sql() -> str:
    word = lambda i: f"('0x' || substr(sha256('{i // 8}:' || text), {8 * (i % 8) + 1}, 8))::UBIGINT / 4294967295.0 * 2.0 - 1.0"
    return f"""WITH v AS (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN list_transform(range(16), lambda x: 0.0::DOUBLE) ELSE [{', '.join(word(i) + '::DOUBLE' for i in range(16))}] END AS e FROM documents),
      n AS (SELECT doc_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
      SELECT doc_id, array_to_string(list_transform(e, lambda x: (floor(CASE WHEN n = 0 THEN 0 ELSE x / n END * 100000 + 0.5))::BIGINT::VARCHAR), ',') AS vector FROM n"""


@query("document_vectors", vector_sql())
def document_vectors(spark, d):
    vector = R.embedding(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(vector, lambda x: F.floor(x * 100000 + 0.5).cast("long").cast("string")), ",").alias("vector"))


@query(
    "keyword_ranking",
    """SELECT item_id, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'ing'))::INT + (contains(lower(text), 'ble'))::INT + (contains(lower(text), 'oner'))::INT AS score
       FROM benchmark ORDER BY score DESC, item_id LIMIT 10""",
)
def keyword_ranking(spark, d):
    """The ten best are the feature."""
    low = F.lower("text")
    score = sum((F.contains(low, F.lit(w)).cast("int") for w in ("the", "ing", "ble", "oner")), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", score.alias("score")).orderBy(F.desc("score"), "item_id").limit(10)


@query("document_chunks")
def document_chunks(spark, d):
    return R.chunk_rows(table(spark, d, "documents"), "doc_id", "text")


@query("retrieval_context")
def retrieval_context(spark, d):
    """Search over the chunks of all documents, neighbours merged, repeats left out, packed into one context."""
    chunks = R.chunk_rows(table(spark, d, "documents"), "doc_id", "text").withColumn("vector", R.embedding(F.col("content")))
    keyed = chunks.withColumn("key", F.struct("doc_id", "chunk_index"))
    wanted = spark.range(1).select(R.embedding(F.lit("quality of the data")).alias("v")).first()["v"]
    hits = R.search(keyed, F.array(*map(F.lit, wanted)), "vector", "key", 12)
    items = R.without_repeats(R.merged(hits, "doc_id", "chunk_index", "content"), "content", [F.desc("best"), F.col("doc_id"), F.col("first")])
    ordered = items.select(F.lit(0).alias("query"), (-F.col("best")).alias("order"), "doc_id", "first", "content")
    return R.packed(ordered, "query", ["order", "doc_id", "first"], "content")


@query(
    "ingest_versions",
    """SELECT n.doc_id, CASE WHEN n.c IS NULL THEN 'skipped' WHEN o.c = n.c THEN 'noop' WHEN o.c IS NULL THEN 'created' ELSE 'replaced' END AS action,
         CASE WHEN o.c IS NOT NULL AND o.c <> n.c THEN 2 ELSE 1 END AS version
       FROM (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) <> '' THEN sha256(replace(text, 'license', 'licence')) END AS c FROM documents) n
       LEFT JOIN (SELECT doc_id, sha256(text) AS c FROM documents WHERE lang <> 'es') o USING (doc_id)""",
)
def ingest_versions(spark, d):
    docs = table(spark, d, "documents")
    new = docs.select("doc_id", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.sha2(F.replace(F.col("text"), F.lit("license"), F.lit("licence")), 256)).alias("checksum"))
    stored = docs.filter("lang <> 'es'").select("doc_id", F.sha2("text", 256).alias("checksum"), F.lit(1).alias("version"))
    return R.ingest_plan(new, stored, "doc_id", "checksum")
