"""The numbered queries over the driver's tables; each is a thin layer over an operator of this subpackage."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, bpe, divergence, jaccard, jpeg, language, lm, mixing, pii, simhash, token_files, topk, toxicity
from tessera.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = pii.train(docs)
    found = docs.select("doc_id", pii.spans_column(docs, field, F.col("text")).alias("s")).select("doc_id", "s.base", "s.added")
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    spans = pii.written(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, ~held_out(F.col("doc_id"), 7, 2), public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary_score", "mixed_score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)

    def digest(doc_id, start, ids):
        return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return token_files.documents(spark, manifest, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocab = bpe.vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    both = docs.select("doc_id", bpe.round_trip_column(vocab, F.col("text")).alias("b")).select("doc_id", "b.ids", "b.decoded")
    joined = F.array_join(F.col("ids"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


OP5_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
  SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    size = F.col("mix_size")
    return mixed.select("doc_id", size.alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (size * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"), F.col("mix_rate").alias("rate"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~held_out(F.col("doc_id"), 5, 0))
    found = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), language.predict_column(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.langs").alias("langs"), F.col("p.shares").alias("shares"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Every pair of documents that shares a shingle, and the closure of the links by recursion.
OP8_SQL = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  t AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
  s AS (SELECT rid, len(s) AS n, unnest(s) AS shingle FROM t),
  links AS (SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  reach AS (SELECT rid, rid AS other FROM t UNION SELECT r.rid, l.b FROM reach r JOIN links l ON r.other = l.a)
  SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
  FROM t JOIN reach r ON t.rid = r.rid JOIN t o ON o.rid = r.other GROUP BY t.rid, t.doc_id, len(t.s)"""


def op9_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    media = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), jpeg.media_column(F.col("text")).alias("media"))
    f = media.select("doc_id", "n_bytes", jpeg.features_column(F.col("media")).alias("f"))
    feature = F.concat_ws(":", F.concat(F.col("f.width"), F.lit("x"), F.col("f.height")), F.col("f.thumb_hash"), F.sha1(F.col("f.thumb")))
    return f.select("doc_id", "n_bytes", "f.payload_bytes", "f.payload_sha256", "f.tail_crc32", "f.media_bytes", "f.media_sha256", feature.alias("feature"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), toxicity.score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=lambda groups: F.sha2(groups, 256))
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("n_a") > 0, F.col("groups")).otherwise("").alias("groups_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


#: Every pair of sources by every kept term, in integers of 128 bits.
OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
  kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
  groups AS (SELECT DISTINCT lang, source FROM d),
  v AS (SELECT lang, count(term)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
  own AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
  size AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM own GROUP BY lang, source),
  p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + 1000000000 * (coalesce(o.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p, 1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q
    FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN size s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
  f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
  parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
  SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_lattice": op2_lattice,
        "op3_token_files": op3_token_files,
        "op4_bpe": op4_bpe,
        "op5_balltree": op5_balltree,
        "op6_mixing": op6_mixing,
        "op7_language": op7_language,
        "op8_jaccard": op8_jaccard,
        "op9_jpeg": op9_jpeg,
        "op10_toxicity": op10_toxicity,
        "op11_alignment": op11_alignment,
        "op12_simhash": op12_simhash,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_balltree": OP5_SQL, "op8_jaccard": OP8_SQL, "op13_divergence": OP13_SQL}
