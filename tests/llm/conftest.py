import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # Columns whose names the operators use themselves.
    + [T.StructField(c, T.StringType()) for c in ("score", "word", "cid", "row", "h", "mix_size", "jaccard_id", "ids", "base", "key")]
)
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
EN = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie über schön".split()
BAD = "vile nasty rotten".split()


def rows():
    rng = random.Random(5)
    made = []
    for i in range(120):
        words = EN if i % 3 else DE
        text = " ".join(rng.choice(words) for _ in range(rng.randint(8, 60)))
        if i % 10 == 7:
            text += " " + " ".join(rng.choices(BAD, k=3))
        if i % 17 == 0:
            text += f" +1 (555) 123-{1000 + i} mail a.b{i}@x{i}.example.com 10.0.{i}.7 4111 1111 1111 1111"
        made.append([i, text, "en" if i % 3 else "de", f"s{i % 5}", len(text)])
    long = " ".join(rng.choice(EN) for _ in range(6000))
    made += [
        [200, made[3][1], "en", "s1", 1], [201, made[3][1] + " extra", "en", "s1", 1], [202, made[3][1].upper(), None, None, None], [203, made[3][1], "en", "s2", None],
        [204, long, "en", "s0", 5], [205, long + " more words", "en", "s0", 5], [206, "x" * 30_000, "en", "s0", 5], [207, "1 2 3 4 5 6 7 8 9 " * 800, None, "s0", 5],
        [208, "", "en", "s0", 0], [209, None, "de", "s0", None], [210, " \t\n\x0b\x0c\r ", None, "s1", 3], [211, "one", None, "é", 3], [212, "one", None, "é", 3],
        [213, "Σίσυφος ΑΣ naïve café ﬁn 日本語 ½ ²  I'll don't <|endoftext|> x y\x1cz", None, "", 1], [214, "ip 999.1.1.1 and 1.2.3.4.5.6.7.8 @ a@b a@b.c +1 2", None, "z", 1],
        [None, "no id here but words that are the same", None, None, None], [None, "no id here but words that are the same", None, None, None], [215, "no id here but words that are the same", None, None, None],
        [216, "twice the same row in one table of rows", "en", "s3", 2], [216, "twice the same row in one table of rows", "en", "s3", 2], [216, "another text of the same id as before", "en", "s3", 2],
        [-5, "a negative id is an id too", "en", "s4", 1], [None, None, None, None, None],
    ]
    return [tuple(r) + ("x",) * 10 for r in made]


@pytest.fixture(scope="session")
def table_dir(spark, tmp_path_factory):
    """Small tables with every edge case; written as the driver's tables are."""
    where = str(tmp_path_factory.mktemp("tables"))
    docs = rows()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(r[0], 1, int(any(w in (r[1] or "") for w in BAD))) for r in docs[:120]] + [(None, 1, 1), (3, None, None), (204, 0, 0), (999, 1, 1), (5, 1, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{where}/labels.parquet")
    rng = random.Random(3)
    same = [0.5, -0.25, 1.0, 0.0]
    vectors = [(i, same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(160)]
    vectors += [(300, None, 0), (350, [1.0, None, 0.0, 0.0], 0), (400, [float("nan"), 0.0, 0.0, 0.0], 0), (450, [float("inf"), 0.0, 0.0, 0.0], 0), (None, same, 0), (500, [1.0, 2.0], 0), (501, [3.0, 4.0], 1), (550, [], 0), (600, [3e9, 1.0, 0.0, -1.0], 0), (50, [0.1, 0.2, 0.3, 0.4], 0)]
    spark.createDataFrame(vectors, VECTORS).write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", SCHEMA), ("labels", LABELS), ("embeddings", VECTORS)):
        spark.createDataFrame([], schema).write.parquet(f"{where}/{name}.parquet")
    return where


@pytest.fixture(scope="session")
def documents():
    return [r[:5] for r in rows()]
