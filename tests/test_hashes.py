"""Hashes of texts: words and pairs that are not within the radius never become rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import documents as D


def _rows(df, kind: str) -> int:
    """Rows that leave all nodes of a kind, once df has run."""
    plan, found = df._jdf.queryExecution(), 0
    plan.executedPlan().execute().count()
    todo = [plan.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if kind in node.nodeName():
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_pairs_beyond_the_radius_are_no_rows(spark):
    # All hashes agree on 43 of their bits, so they crowd on every value that those bits hold.
    hashes = [f"{(int.from_bytes(hashlib.sha256(str(k).encode()).digest()[:3], 'big') << 40 | 0xABCDEF1234):016x}" for k in range(600)]
    df = spark.createDataFrame([("s", k, h) for k, h in enumerate(hashes)], "g string, doc_id long, simhash string")
    found = D.near_pairs(df, "g", "doc_id", 3)
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    kinds = sorted(set(hashes))
    want = {(a, b) for a in kinds for b in kinds if a < b and bits(a, b) <= 3}
    assert {(r.left_hash, r.right_hash) for r in found.collect()} == want
    assert _rows(found, "Join") < len(kinds) * 3


def test_votes_of_a_text_are_one_row(spark, monkeypatch):
    texts = [(1, "Ab  cd ab"), (1, "Éf"), (2, None), (3, " \t "), (4, " ".join(f"w{k % 97}" for k in range(3000)))]
    df = spark.createDataFrame(texts, "id long, t string")
    held = {}
    for k, t in texts:
        held.setdefault(k, []).extend((t or "").lower().split())
    value = lambda w: int.from_bytes(hashlib.sha256(w.encode()).digest()[24:], "big")
    want = {k: f"{sum(1 << b for b in range(64) if 2 * sum(value(w) >> b & 1 for w in words) >= len(words)):016x}" for k, words in held.items()}
    votes = D.word_votes(df, "id", "t")
    assert {r.id: r.simhash for r in votes.collect()} == want
    assert _rows(votes, "Generate") == 0
    known: dict[bytes, bytes] = {}
    whole = D._ones(texts[-1][1].encode(), known)
    monkeypatch.setattr(D, "PIECE", 100)
    monkeypatch.setattr(D, "KNOWN", 5)
    cut = D._ones(texts[-1][1].encode(), {})
    assert whole[0] == cut[0] == 3000 and (whole[1] == cut[1]).all()
    assert spark.range(3).select(F.col("id"), F.lit("x").alias("t")).transform(lambda d: D.word_votes(d, "id", "t")).select("simhash").distinct().count() == 1


def test_blocks_that_meet_are_not_taken_together_by_their_few_bytes(spark):
    hashed = spark.range(50).select(F.lit("s").alias("person"), F.xxhash64("id").alias("h"), "id", F.lit(True).alias("own"))
    plan = D.nearest_hashes(hashed, "person", "id", 7)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_texts_of_white_space_alone_have_no_versions(spark, tmp_path):
    from tessera.plans import registry

    texts = [(1, "a b", "s"), (2, None, "s"), (3, " \t  \n", "s"), (4, "a c", "s"), (5, "", "s")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()["document_best_versions"](spark, str(tmp_path))
    assert {r.doc_id: r.previous for r in found.collect()} == {1: 4, 4: 1}


#: Texts without words, white space that only some engines know, and capitals whose lower case hangs on their place or has two characters.
ODD = [None, "", " \t  \n", "\x1c \x1f", "a\x1cb", "a b", "ΑΣ ΣΑΣ", "ας", "İstanbul I", "istanbul i", "　", "ß ẞ"]
ODD += [" ".join(f"w{k}" for k in range(60)) + end for end in (" ΑΣ", " ΑΣ\x1dx")]


def _compared(spark, where: str, name: str) -> list[tuple]:
    """Rows of a query over odd texts, held against its SQL."""
    import duckdb

    from tessera.plans import registry

    rows = [(k, t, "s") for k, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{where}/documents.parquet")
    found = registry.queries()[name](spark, where)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{where}/documents.parquet/*.parquet')")
    told = base.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    want, got = told.fetchall(), [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("name", ["document_simhash", "near_duplicate_hashes", "first_of_copies"])
def test_odd_texts_have_the_hashes_of_the_sql(spark, tmp_path, name):
    assert len(_compared(spark, str(tmp_path), name)) > 0


def test_versions_pass_over_texts_without_words(spark, tmp_path):
    previous = {r[0]: r[1] for r in _compared(spark, str(tmp_path), "document_versions")}
    assert previous == {5: 4, 6: 5, 7: 6, 8: 7, 9: 8, 11: 9, 12: 11, 13: 12}


@pytest.mark.parametrize("made", [X.completeness, X.workplace_type, X.normalize_url])
def test_white_space_is_found_once_for_all_steps(spark, made):
    plan = spark.createDataFrame([("A  b",)], "t string").select(made(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("(?U)[\\s") <= 2
