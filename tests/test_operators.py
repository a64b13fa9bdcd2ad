"""Scenarios for operators beside the registered queries, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, vocabulary
from tessera.functions import text as X
from tessera.operators import analytics as A
from tessera.operators import documents, sections
from tessera.operators import documents as D
from tessera.operators import matching as M
from tessera.operators import merge as U
from tessera.operators import retrieval as R
from tessera.sources import postings as P
from tessera.streaming import events as S


def values(spark, col, *rows, schema="a string"):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(col).collect()]


def test_url_rules(spark):
    given = [("HTTP://Ex.Com//a//b/?q=1#x",), ("//h/p/",), ("a.b/c",), ("",), (None,), ("https://h",)]
    assert values(spark, X.normalize_url(F.col("a")), *given) == ["http://ex.com/a/b", "https://h/p", "https:///a.b/c", "", "", "https://h/"]


def test_seniority_and_location(spark):
    pairs = [("Head of Data", None), ("Engineer", "a senior role"), ("Engineer", "x"), (None, None), ("Jr. dev", "chief of all")]
    got = spark.createDataFrame(pairs, "t string, d string").select(X.seniority(F.col("t"), F.col("d"))).collect()
    assert [r[0] for r in got] == ["director", "senior", "mid", None, "junior"]
    places = [("Berlin, Germany",), ("Remote - EU",), ("Hybrid",), ("A / B",), ("",), ("Paris - hybrid",)]
    assert values(spark, X.location_city(F.col("a")), *places) == ["Berlin", "Remote", "Hybrid", "A", None, "Paris"]


def test_years_and_keywords(spark):
    texts = [("At least 3+ years, or 5-7 years",), ("2 years",), ("10+ years or minimum of 4 years",), (None,)]
    assert values(spark, X.years_of_experience(F.col("a")), *texts) == [3, None, 4, None]
    assert values(spark, X.keywords(F.col("a")), ("<b>C++</b> and -node.js. the 42 C++",)) == [["c++", "node.js"]]


def test_freshness(spark):
    t = dt.datetime(2024, 5, 1)
    day = dt.timedelta(days=1)
    rows = [(t, t, t), (t, t - 5 * day, t - 40 * day), (t, t, None), (t, None, t - 2 * day), (None, t, t), (t, None, None)]
    got = spark.createDataFrame(rows, "n timestamp, s timestamp, p timestamp").select(X.freshness(F.col("n"), F.col("s"), F.col("p"))).collect()
    assert [r[0] for r in got] == [1.0, round(0.42 * 0.7 + 0.88 * 0.3, 4), round(0.3 + 0.35 + 0.05, 4), round(0.95 * 0.7, 4), 0.5, 0.5]


def test_page_bounds_and_empty_lists(spark):
    assert A.page_bounds("x", None) == (25, 0) and A.page_bounds(3, 500) == (100, 200) and A.page_bounds(-1, 0) == (25, 0) and A.page_bounds(5000, 10) == (10, 9990)
    rows = spark.createDataFrame([("a_b", 1), ("axb", 2), ("c\\d", 3)], "s string, n int")
    assert A.where_all(rows, within={"s": []}).count() == 3
    assert {r.s for r in A.where_all(rows, search="A_B", search_in=["s"]).collect()} == {"a_b", "axb"}
    assert A.where_all(rows, search="c\\d", search_in=["s"]).count() == 1


def test_nothing_seen_deactivates_everything(spark):
    rows = spark.createDataFrame([(1, True), (2, False)], "id int, live boolean")
    assert [r.live for r in U.tombstone(rows, rows.limit(0).select("id"), ["id"], "live").orderBy("id").collect()] == [False, False]


def python_chunks(text, size):
    """Paragraph ranges, written out as a loop."""
    parts = [p.strip() for p in text.split("\n\n") if p.strip()]
    out, first = [], 0
    for i in range(len(parts)):
        if i > first and len("\n\n".join(parts[first : i + 1])) > size:
            out.append((first, i - 1))
            first = i - 1
    return [*out, (first, len(parts) - 1)] if parts else []


def test_chunks(spark):
    rng = random.Random(4)
    texts = ["\n\n".join("w" * rng.randint(1, 70) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", "   ", "a\r\n\r\nb", "x" * 500]
    got = values(spark, R.chunks(F.col("a"), 100), *[(t,) for t in texts])
    for t, ranges in zip(texts, got, strict=True):
        want = python_chunks(t.replace("\r\n", "\n"), 100)
        assert [(r["first"], r["last"]) for r in ranges] == want or all(len(p) > 100 for p in t.split("\n\n"))


def test_embedding_and_cosine(spark):
    import hashlib
    import math

    text = "some text"
    raw = [int(hashlib.sha256(f"{i // 8}:{text}".encode()).hexdigest()[8 * (i % 8) : 8 * (i % 8) + 8], 16) / 0xFFFFFFFF * 2 - 1 for i in range(16)]
    norm = math.sqrt(sum(x * x for x in raw))
    assert values(spark, R.embedding(F.col("a")), (text,))[0] == pytest.approx([x / norm for x in raw])
    assert values(spark, R.embedding(F.col("a")), ("  ",))[0] == [0.0] * 16
    pairs = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in pairs.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, None, pytest.approx(1.0)]


def test_runs_repeats_and_packing(spark):
    hits = spark.createDataFrame([(1, i, 0.5 + i / 100, f"part {i} " + "x" * 40) for i in (0, 1, 3, 4, 9)], "doc int, chunk int, similarity double, content string")
    runs = R.merged(hits, "doc", "chunk", "content").orderBy("first").collect()
    assert [(r["first"], r["chunks"]) for r in runs] == [(0, 2), (3, 2), (9, 1)]
    items = spark.createDataFrame([(1, k, "word " * n) for k, n in enumerate((400, 400, 400, 400, 5, 5, 5))], "q int, place int, content string")
    packed = R.packed(items, "q", ["place"], "content").collect()
    assert len(packed) == 5 or sum(len(r.content) for r in packed) <= R.CHARACTERS
    assert all(len(r.content) <= R.PER_ITEM for r in packed) and sum(int(len(r.content.split()) * 1.25) for r in packed) <= R.TOKENS + 2


def test_shared_text_of_neighbours_stands_once(spark):
    shared = "a paragraph of more than thirty-two characters"
    pairs = [("x " + shared + " \n", "  " + shared + "\n\ny"), ("one", "two"), ("", " b"), ("a ", ""), ("Same  text", "same text"), ("ab" * 10, "ab" * 10 + "c"), ("q" + "z" * 300, "z" * 300 + "r")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(R.joined_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["x " + shared + "\n\ny", "one\n\ntwo", "b", "a", "Same  text", "ab" * 10 + "\n\n" + "ab" * 10 + "c", "q" + "z" * 360 + "r"]


def test_simhash_forms_agree(spark):
    import hashlib

    text = "The quick  brown fox the end"
    votes = [0] * 64
    for w in text.lower().split():
        h = int.from_bytes(hashlib.sha256(w.encode()).digest(), "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    want = f"{sum(1 << b for b in range(64) if votes[b] >= 0):016x}"
    docs = spark.createDataFrame([(1, text), (2, "")], "id int, t string")
    assert {r.id: r.simhash for r in D.word_votes(docs, "id", "t").collect()} == {1: want, 2: "f" * 16}
    assert [r[0] for r in docs.orderBy("id").select(D.simhash(D.tokens(F.col("t")))).collect()] == [want, "f" * 16]


def test_component_scores(spark):
    base = {"skills": ["a", "b", "c"], "required_skills": ["a", "b", "x", "y", "z"], "preferred_skills": ["c"], "evidence_terms": ["a"] * 20 + ["b"], "ownership_signals": ["architecture"], "impact_signals": ["m"], "scope": "architect"}
    schema = "p struct<skills:array<string>,evidence_terms:array<string>,ownership_signals:array<string>,impact_signals:array<string>,scope:string,seniority:string,manages:boolean>, j struct<skills:array<string>,required_skills:array<string>,preferred_skills:array<string>,scope:string>"
    row = ((base["skills"], base["evidence_terms"], base["ownership_signals"], base["impact_signals"], None, "lead", True), ([], base["required_skills"], base["preferred_skills"], "architect"))
    df = spark.createDataFrame([row], schema)
    p, j = (lambda n: F.col(f"p.{n}")), (lambda n: F.col(f"j.{n}"))
    first, second = M.common(p, j)
    w = lambda n: first[n] if n in first else second[n](lambda m: first[m])
    skill, scope = df.select(M.skill(p, j, w), M.scope(p, j)).first()
    assert skill == pytest.approx(0.30)  # three required skills are missing: the ceiling holds
    assert scope == pytest.approx(0.82)  # a manager by seniority, one above an architect


def test_posting_links_and_json(spark):
    html = '<a href="/careers/1?x=1">Data <b>Engineer</b></a><a href="/about">About us</a><a href="https://o.com/jobs/2">Ops</a><a href="careers/1">Again here</a>'
    pages = spark.createDataFrame([(1, "https://Ex.com/list", html), (2, "https://e.com", None)], "id int, url string, html string")
    got = {(r.target, r.title) for r in P.posting_links(pages, "id", "url", "html").collect()}
    assert got == {("https://ex.com/careers/1", "Data Engineer")}
    body = '{"jobs": [{"id": 7, "title": " Dev ", "location": {"name": "Berlin"}, "absolute_url": "u"}, {"id": 8}, "x"]}'
    payloads = spark.createDataFrame([(1, body), (2, "{broken"), (3, None), (4, '[{"text": "Op"}]')], "id int, body string")
    got = {(r.id, r.external_id, r.title, r.location) for r in P.json_postings(payloads, "id", "body").collect()}
    assert got == {(1, "7", "Dev", "Berlin"), (4, None, "Op", None)}


def python_limits(rows, limit, seconds):
    out, state = {}, {}
    for user, event, t in sorted(rows, key=lambda r: (r[2], r[1])):
        end, n = state.get(user, (0.0, 0))
        if end <= t:
            state[user], out[event] = (t + seconds, 1), 0
        elif n >= limit:
            out[event] = max(1, int(end - t))
        else:
            state[user], out[event] = (end, n + 1), 0
    return out


def test_rate_limits_batch_and_stream(spark, tmp_path):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(rng.randint(1, 3), k, rng.randint(0, 600)) for k in range(120)]
    rows = [(u, k, float(t)) for (u, k, _), t in zip(rows, sorted(r[2] for r in rows), strict=True)]
    epoch = start.timestamp()
    df = spark.createDataFrame([(u, k, start + dt.timedelta(seconds=t)) for u, k, t in rows], "user_id long, event_id long, ts timestamp")
    want = python_limits([(u, k, epoch + t) for u, k, t in rows], 3, 60)
    assert {r.event_id: r.wait for r in S.rate_limited_batch(df, 3, 60).collect()} == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = S.rate_limited(S.source(spark, f"{tmp_path}/in", df.schema), 3, 60)
    q = stream.writeStream.format("memory").queryName("limits").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id: r.wait for r in spark.sql("SELECT * FROM limits").collect()} == want


def test_digest_cursor_moves_on(spark, tmp_path):
    df = spark.createDataFrame([(1, "view", dt.datetime(2024, 1, 1)), (2, "click", dt.datetime(2024, 1, 2))], "event_id long, event_type string, ts timestamp")
    got = []
    deliver = lambda rows, epoch: got.extend((r.event_type, r.items) for r in rows.collect())
    for _ in range(2):
        df.write.mode("append").parquet(f"{tmp_path}/in")
        S.digest(S.source(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/c", deliver).awaitTermination()
    assert sorted(got) == [("click", 1), ("click", 1), ("view", 1), ("view", 1)]


def test_csv_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, True, {"b": 1, "a": 2})], "id int, t string, f boolean, m map<string,int>")
    P.write_csv(rows, f"{tmp_path}/out", ["id", "t", "f", "m"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["id", "t", "f", "m"]


RANGES = [
    ("Jan 2020 - March 2021", "en", (2020, 1, 2021, 3, False, 0.9)), ("03/2019 – Present", "en", (2019, 3, None, None, True, 0.91)), ("2018 to 2020", "en", (2018, None, 2020, None, False, 0.7)),
    ("2018", "en", (2018, None, None, None, False, 0.7)), ("Mar 2020 bis heute", "de", (2020, 3, None, None, True, 0.92)), ("Mai 2020 bis Okt 2021", "de", (2020, 5, 2021, 10, False, 0.9)),
    ("Şubat 2019 - devam ediyor", "tr", (2019, 2, None, None, True, 0.92)), ("October 2020", "en", (2020, 10, None, None, False, 0.9)), ("03-2019", "en", (2019, 3, None, None, False, 0.88)),
    ("• 2015 — halen |", "tr", (2015, None, None, None, True, 0.82)), ("January 12019", "en", None), ("none", "en", None), ("", "en", None), (None, "en", None), ("Mayıs 2020", "fr", (2020, None, None, None, False, 0.7)), ("today", None, (None, None, None, None, True, 0.94)),
]


def test_date_ranges_in_every_notation(spark):
    rows = spark.createDataFrame([(k, t, x) for k, (t, x, _) in enumerate(RANGES)], "k int, t string, x string").select("k", dates.date_range(F.col("t"), F.col("x")).alias("r")).orderBy("k").collect()
    assert [r.r and tuple(r.r) for r in rows] == [want for *_, want in RANGES]


def test_month_intervals(spark):
    row = spark.sql("SELECT 1").select(*[dates.month_interval(dates.date_range(F.lit(t), F.lit("en")), F.lit(2022 * 12)).alias(f"c{k}") for k, t in enumerate(("2018 to 2018", "Jan 2020 - Mar 2020", "2021 - now", "May 2020", "2020 - 2018", "now"))]).first()
    assert [r and tuple(r) for r in row] == [(2018 * 12, 2019 * 12), (2020 * 12, 2020 * 12 + 3), (2021 * 12, 2022 * 12 + 1), (2020 * 12 + 4, 2020 * 12 + 5), None, None]


PAPER = """Jane Roe
jane@example.com

EXPERIENCE

Built things at Acme
2019 - 2021

Education:
Some school

TECHNICAL SKILS
python, sql
I like to write about code and people, every day of the week."""


def plain_sections(text, language):
    """The rules of a section, line by line: no bound on the comparison, no running counts."""
    from difflib import SequenceMatcher

    out, current, before = [], None, []
    for line in ([" ".join(x.split()) for x in text.split("\n")] if text else []):
        if not line:
            if current and current[3]:
                current[3].append("")
            continue
        p, best, found = sections.plain(line), 0.0, None
        words = {w for w in sections.SPLIT.split(p) if w}
        for section, aliases in sections.ALIASES.get(language, sections.ALIASES["en"]).items():
            for a in map(sections.plain, aliases):
                own = {w for w in sections.SPLIT.split(a) if w}
                near = 0.0 if not p else 1.0 if p == a else 0.95 if a in p else max(SequenceMatcher(a=p, b=a).ratio(), len(words & own) / max(len(own), 1))
                if near > best:
                    best, found = near, section
        n, letters = len(line.split()), [c for c in line if c.isalpha()]
        score = 0.62 * best + 0.22 * (sum(c.isupper() for c in letters) / len(letters) if letters else 0) + 0.08 * (min(1.0, 0.45 + (7 - n) / 7) if n <= 7 else 0)
        score = min(1.0, score + 0.05 * (0.25 if line[-1] in ":;.," else 1) + 0.03 * (1.0 if n == 1 else 0.9 if n == 2 else 0.7 if n <= 4 else 0.45 if n <= 6 else 0.1))
        if found and best >= 0.72 and score >= 0.58:
            current = [found, line, round(score, 6), []]
            out.append(current)
        elif current is None:
            before.append(line)
        else:
            current[3].append(line)
    for s in out:
        while s[3] and not s[3][-1]:
            s[3].pop()
    if not out:
        return [(0, "other", None, 0.35, before)] if before else []
    head = [(0, "header", None, 0.82, before)] if before else []
    return head + [(k, *s) for k, s in enumerate(out, 1)]


def test_sections_equal_the_rules_line_by_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs] + [(-1, PAPER, "en"), (-2, None, "en"), (-3, "", "de"), (-4, "\n\n", None), (-5, "BERUFSERFAHRUNG\n\nx\n\n\ny\n\nSprachen\nDeutsch", "de"), (-6, "Skills\nSkills\nSkills", "fr"), (-7, "Profil özeti:\nmetin", "tr")]
    got = sections.sections(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()
    want = [(k, *s) for k, t, x in rows for s in plain_sections(t, x or "en")]
    assert sorted([(r.doc_id, r.place, r.section, r.heading, r.confidence, r.lines) for r in got]) == sorted(want)
    assert [r[2] for r in sorted(want) if r[0] == -1] == ["header", "experience", "education", "skills", "summary"]


@pytest.mark.parametrize("meet", [2048, 3])
def test_near_pairs_are_all_pairs_within_the_radius(spark, meet):
    import random

    rng, rows = random.Random(3), []
    for g in ("a", "b"):
        for _ in range(6):
            seed = rng.getrandbits(64)
            for _ in range(20):
                h = seed
                for _ in range(rng.randint(0, 5)):
                    h ^= 1 << rng.randrange(64)
                rows += [(g, len(rows), f"{h:016x}")] * rng.randint(1, 2)
    got = documents.near_pairs(spark.createDataFrame(rows, "g string, doc_id long, simhash string"), "g", "doc_id", 5, meet).collect()
    kinds = sorted({(g, h) for g, _, h in rows})
    want = {(g, a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for g, a in kinds for o, b in kinds if g == o and a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 5}
    assert len(got) == len(want) and {(r.g, r.left_hash, r.right_hash, r.distance) for r in got} == want
    count = lambda g, h: sum(x == (g, h) for x in ((g_, h_) for g_, _, h_ in rows))
    assert all(r.document_pairs == count(r.g, r.left_hash) * count(r.g, r.right_hash) and r.left_doc == min(d for g, d, h in rows if (g, h) == (r.g, r.left_hash)) for r in got)


def test_lenient_times(spark):
    texts = ["2024-01-01T10:00", "2024-01-01T10:00Z", "2024-01-01 10:00:30", "2024-01-01T10:00:30.5+02:00", "2024-01-01T10:00+0200", "2024-01-01", " 2024-01-01 ", "x", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", vocabulary.lenient_time(F.col("t")).cast("string").alias("v")).orderBy("k").collect()
    assert [r.v for r in rows] == ["2024-01-01 10:00:00"] * 2 + ["2024-01-01 10:00:30", "2024-01-01 08:00:30.5", "2024-01-01 08:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00", None, None, None]


def test_skills_in_order_with_both_rules_of_graphql(spark):
    row = spark.sql("SELECT 1").select(vocabulary.skills(F.lit("html rest api apollo")).alias("a"), vocabulary.skills(F.lit("graphql")).alias("b"), vocabulary.skills(F.lit("graphql html"), limit=2).alias("c")).first()
    assert (row.a, row.b, row.c) == (["html", "rest api", "graphql"], ["graphql", "graphql"], ["graphql", "html"])


@pytest.mark.parametrize("overlap", [0, 1, 2, 3])
def test_chunks_repeat_the_last_paragraphs(spark, overlap):
    rng = random.Random(overlap)
    texts = ["\n\n".join("x" * rng.randint(1, 60) for _ in range(rng.randint(0, 25))) for _ in range(40)]

    def plain(text):
        out, current, first = [], [], 0
        for k, p in enumerate([p for p in text.split("\n\n") if p]):
            if current and len("\n\n".join([*current, p])) > 100:
                out.append((first, k - 1))
                current = current[-overlap:] if overlap else []
                first = k - len(current)
            current.append(p)
        return out + [(first, first + len(current) - 1)] * bool(current)

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", R.chunks(F.col("t"), 100, overlap).alias("c")).orderBy("k").collect()
    assert [[tuple(x) for x in r.c] for r in rows] == [plain(t) for t in texts]
