"""Findings, redacted texts and offsets against plain Python."""

import hashlib
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import redaction as R

CASES = [
    ("Ada Byron\r\n12 Baker Street, London\nada.byron@mail.example.com, +44 20 7946 0958\nhttps://www.linkedin.com/in/ada?x=1 and https://github.com/ada", "ada byron"),
    ("Sürücü Sokak 5; call 0 1 2\nAve. 7\nave.x 7\na weg\nb weg 1\nc platz 2\nd road 3", None),
    ("https://stackoverflow.com/users/7/x https://LINKEDIN.com/IN/q https://plain.example", "x"),
    ("a@b.co in 4 Long road, call 020 7946 0958 now", "a@b.co in 4"),
    ("𝒳𝒴 ada@x.org 𝒵 ada@x.org", None),
    ("", "Ada Byron"),
    (None, "Ada Byron"),
    ("nothing to see", "no such name"),
]


def rows(spark, links=False):
    frame = spark.createDataFrame([(i, t, n, "mine") for i, (t, n) in enumerate(CASES)], "id int, text string, name string, findings string")
    return frame.withColumn("r", R.redaction(F.col("text"), F.col("name"), links)).orderBy("id")


def test_findings_and_texts(spark):
    got = [r.r for r in rows(spark).collect()]
    assert got[0].redacted == "[REDACTED_NAME]\r\n[REDACTED_ADDRESS]\n[REDACTED_EMAIL], [REDACTED_PHONE]\nhttps://www.linkedin.com/in/[REDACTED_PROFILE] and https://github.com/[REDACTED_PROFILE]"
    assert got[1].redacted == "[REDACTED_ADDRESS]\nAve. 7\n[REDACTED_ADDRESS]\na weg\n[REDACTED_ADDRESS]\nc platz 2\nd road 3"
    assert got[2].redacted == "https://stackoverflow.com/users/[REDACTED_PROFILE] [REDACTED_PROFILE] https://plain.example"
    # The shorter of two that begin at one place is applied, what overlaps it is not.
    assert [(f.kind, f.applied) for f in got[3].findings] == [("email", True), ("full_name", False), ("address", False), ("phone_number", True)]
    assert got[4].redacted == "𝒳𝒴 [REDACTED_EMAIL] 𝒵 [REDACTED_EMAIL]"
    assert (got[5].redacted, got[5].findings, got[6].redacted, got[6].findings, got[7].redacted) == ("", [], None, [], "nothing to see")
    assert rows(spark, links=True).collect()[2].r.redacted == "[REDACTED_URL] [REDACTED_URL] [REDACTED_URL]"


def test_maps_keep_each_raw_text_once(spark):
    got = [r[0] for r in rows(spark).select(R.redaction_map(F.col("r.findings"))).collect()]
    assert got[4] == {"email": ["ada@x.org"]} and got[5] == {} and got[6] == {}
    assert got[1]["address"] == ["Sürücü Sokak 5; call 0 1 2", "ave.x 7", "b weg 1"]


def test_offsets_go_both_ways_for_every_finding_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").cast("int").alias("id"), "text", F.lit(None).cast("string").alias("name"))
    found = docs.withColumn("r", R.redaction(F.col("text"), F.col("name"))).unionByName(rows(spark).drop("findings"))
    each = found.select("text", "r", F.explode("r.findings").alias("f")).filter("f.applied")
    there = {n: R.to_redacted(F.col("r.findings"), F.col(f"f.{n}")) for n in ("start_offset", "end_offset")}
    back = {n: R.to_original(F.col("r.findings"), F.col(f"f.{n}")) for n in ("new_start", "new_end")}
    got = each.select("text", "r.redacted", "f.*", there["start_offset"].alias("s"), there["end_offset"].alias("e"), back["new_start"].alias("bs"), back["new_end"].alias("be")).collect()
    assert len(got) > 100
    for r in got:
        assert r.text[r.start_offset : r.end_offset] == r.raw and r.redacted[r.new_start : r.new_end] == r.replacement
        assert (r.s, r.e, r.bs, r.be) == (r.new_start, r.new_end, r.start_offset, r.end_offset)


def test_texts_come_back_from_their_findings(spark):
    for r in rows(spark).collect():
        text = r.r.redacted
        for f in reversed([f for f in r.r.findings if f.applied]):
            text = text[: f.new_start] + f.raw + text[f.new_end :]
        assert text == r.text


def test_a_long_text_with_many_findings(spark):
    text = "mail a@b.co or c " * 100_000
    got = spark.createDataFrame([(text,)], "t string").select(R.redaction(F.col("t")).alias("r")).select(F.size("r.findings"), F.length("r.redacted")).first()
    assert tuple(got) == (100_000, len(text) + 100_000 * (len("[REDACTED_EMAIL]") - 6))


def test_a_batch_is_held_as_python_objects_a_few_texts_at_a_time():
    texts = pa.array(["ada@x.org " * 40 + str(i) for i in range(2000)] + [None])
    names = pa.nulls(len(texts), pa.string())
    tracemalloc.start()
    found = R._folded(texts, names, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2001 and len(found[1999]["findings"]) == 40 and found[2000].as_py() == {"findings": [], "redacted": None}
    assert peak < 8 << 20  # all findings as objects at once take more than 20 MB
    assert R._folded(texts.slice(0, 0), names.slice(0, 0), False).type == found.type


@pytest.mark.parametrize("name", ["redaction_findings", "redacted_documents", "redaction_maps"])
def test_queries_take_every_line_that_is_an_address(spark, tmp_path, name):
    import duckdb

    from tessera.plans import registry

    lines = [f"{k} Baker Street, London" if k % 3 else f"nothing {k}" for k in range(40)]
    texts = [(1, "\n".join(lines)), (2, "\n".join(lines[1:5])), (3, None), (4, ""), (5, "call 020 7946 0958\nc platz 2; x\n" * 9), (6, "\n".join(f"{k} a road" for k in range(7)))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()[name](spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = base.execute(registry.oracle_sql()[name])
    got = sorted(map(tuple, found.select(*[c[0] for c in told.description]).collect()), key=str)
    assert got == sorted(told.fetchall(), key=str)
    if name == "redaction_findings":
        assert found.filter("kind = 'address'").groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 26), (2, 3), (5, 9), (6, 7)]
    if name == "redaction_maps":
        assert found.filter("kind = 'address'").select("doc_id", "n_values").orderBy("doc_id").collect() == [(1, 26), (2, 3), (5, 1), (6, 7)]
    if name == "redacted_documents":
        assert (6, 7, 7, hashlib.sha256("\n".join(["[REDACTED_ADDRESS]"] * 7).encode()).hexdigest()) in got


def test_the_number_of_address_lines_is_asked_for(spark):
    frame = spark.createDataFrame([("1 a road\n" * 30,)], "t string")
    kept = lambda **more: frame.select(R.redaction(F.col("t"), **more)["findings"].alias("f")).select(F.size("f")).first()[0]
    assert [kept(), kept(address_lines=0), kept(address_lines=5), kept(address_lines=None)] == [R.ADDRESS_LINES, 0, 5, 30]
