import random

import public_tokenizers
from pyspark.sql import functions as F
from tests.llm.test_queries import brute_components

from tessera.llm import alignment, jaccard


def joined_rows(df):
    """Rows made by each join of a DataFrame that has run."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def edited_copies(copies, edits):
    """One text's copies with edits that few others have, most of them too many for any two to be similar."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    made = []
    for i in range(copies):
        words = list(base)
        for k in range(edits if i % 10 else 1):
            own = rng.randrange(copies // 4)
            words[k * 24 + own % 8] = f"own{own}x{k}"
        made.append((i, " ".join(words)))
    return made


def test_copies_with_own_edits_meet_only_where_they_can_link(spark, monkeypatch):
    rows, seen, pairs = edited_copies(400, 7), [], jaccard.group_pairs

    def spied(live, f):
        found = pairs(jaccard.checkpoint(live), f)
        found.collect()
        seen.extend(joined_rows(found))
        return found

    monkeypatch.setattr(jaccard, "group_pairs", spied)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in jaccard.jaccard_components(docs, 5, 80, 100).collect())
    assert seen and max(seen) < 100 * len(rows)
    assert got == sorted(r[:3] for r in brute_components(rows, 5, 80, 100))


def test_alignment_labels_every_text_once(spark, table_dir):
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    watched = docs.withColumn("text", F.udf(counted, "string").asNondeterministic()("text"))
    got = alignment.align(watched, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), told=50)
    assert len(got.collect()) == docs.count() == seen.value
