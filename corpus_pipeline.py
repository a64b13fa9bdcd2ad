"""A training corpus from the documents table, in five stages.

Toxic documents go, one document of each group of near copies stays (five-word shingles, similarity of
0.8 or more), personal data is replaced by its kind, the sources are mixed to target weights, and the
texts are encoded. Every stage but the last returns the columns it was given; ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, mixing, pii, toxicity
from tessera.llm.common import fresh_dir, word_count

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below one half; texts without words are kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    return docs.filter((toxicity.score_column(docs, model) < 0.5) | (word_count(F.col("text")) == 0))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each component of near copies, and every document without words."""
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; n_chars follows the text."""
    found = pii.redacted_rows(docs, pii.train(docs))
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source comes to its target; as many rows as copies."""
    mixed = mixing.mix(docs, keep=True).filter("mix_copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text, their number, and the text that they decode to."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path(TOKENIZER))
    return bpe.round_trip(docs.select("doc_id", "source", "text"), vocab)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier, the field and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        where = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
