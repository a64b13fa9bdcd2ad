"""Skills of texts, by scenarios and against the plain rules alias by alias; the query compares all orders with its SQL."""

import random
import re

from tessera.operators import skills as K


def resolve(spark, *rows):
    """rows: (key, place, section, text)."""
    made = spark.createDataFrame([(*r, "mine") for r in rows], "id int, at int, part string, body string, skill string")
    return {(r.id, r.skill): r for r in K.resolve(made, ["id"], "at", "part", "body").collect()}


def plain(text, section):
    """{skill: (matched, confidence)} by trying every alias in turn."""
    found = {}
    context = re.compile(rf"\b(?:{'|'.join(K.CONTEXT)})\b", re.I)
    for name, own, _, ambiguous in K.CATALOGUE:
        for a in own:
            edge = r"\w" if re.fullmatch("[A-Za-z0-9]+", a) else "[A-Za-z0-9]"
            for m in re.finditer(rf"(?<!{edge}){re.escape(a)}(?!{edge})", text, re.I) if len(a) > 1 else ():
                if ambiguous and section not in ("skills", "projects") and not context.search(text[max(m.start() - 48, 0) : m.end() + 48]):
                    continue
                sure = 0.62 + 0.12 + K.BOOSTS.get(section, 0) + 0.08 * bool(context.search(text)) - 0.2 * ambiguous
                found.setdefault(name, (m.group(), round(max(0, min(1, sure)), 4)))
    return found


def test_common_words_need_context_and_the_best_section_stays(spark):
    got = resolve(
        spark,
        (1, 0, "summary", "Built APIs with FastAPI, PostgreSQL and Docker."),
        (2, 0, "summary", "We react to market changes quickly and align roadmap decisions."),
        (3, 0, "experience", "Built services with Python and FastAPI."),
        (3, 1, "Skills", "Python\nFastAPI\nDocker"),
        (4, 0, None, "go"),
        (5, 0, "skills", "go"),
        (6, 0, "skills", None),
        (7, 0, "skills", ""),
    )
    assert got[1, "FastAPI"].category == "backend_frameworks" and got[1, "FastAPI"].level == "high"
    assert (got[3, "FastAPI"].section, got[3, "FastAPI"].confidence, got[3, "FastAPI"].matched) == ("skills", 1.0, "FastAPI")
    assert {k for k in got if k[0] in (2, 4, 6, 7)} == set() and got[5, "Go"].confidence == 0.89
    assert {s for i, s in got if i == 3} == {"Python", "FastAPI", "Docker"}


def test_against_every_alias_in_turn(spark):
    rng = random.Random(5)
    bits = [a for _, own, _, _ in K.CATALOGUE for a in own] + list(K.CONTEXT) + ["x", "é", "_", "İ", "ß", "word words", "a" * 60]
    rows = []
    for i in range(300):
        text = "".join(rng.choice((str.upper, str.lower, str.title))(rng.choice(bits)) + rng.choice((" ", " ", ", ", ".", "", "-", "_", "\n")) for _ in range(rng.randrange(1, 25)))
        rows.append((i, 0, rng.choice(("skills", "projects", "experience", "summary", "header", "other")), text))
    got = resolve(spark, *rows)
    want = {(i, s): v for i, _, section, text in rows for s, v in plain(text, section).items()}
    assert {k: (r.matched, r.confidence) for k, r in got.items()} == want


def test_long_texts_stay_linear(spark):
    got = resolve(spark, (1, 0, "other", "go with python " * 40_000))
    assert set(s for _, s in got) == {"Go", "Python"} and got[1, "Go"].matched == "go"
