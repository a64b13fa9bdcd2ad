"""Skills that a text names, by a catalogue of aliases, with how sure each is.

A helper walks a text once, with all aliases as one trie, and returns what it met; the rest are
expressions and one grouping. An alias counts where no letter or digit touches it (no word character at
all, if the alias has letters and digits only). A skill whose alias is also a common word needs a section of skills or
projects, or a word of context within 48 characters. A row keeps, for each skill, its best section.

Edge cases: texts that are null or empty name nothing; sections that are null count as ``other``; equal
confidence keeps the earlier section, alias and place in the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Skills with their aliases, category and whether an alias is also a common word, in order.
CATALOGUE: tuple[tuple[str, tuple[str, ...], str, bool], ...] = (
    ("Python", ("python",), "programming_languages", False),
    ("Java", ("java",), "programming_languages", False),
    ("JavaScript", ("javascript", "js"), "programming_languages", False),
    ("TypeScript", ("typescript", "ts"), "programming_languages", False),
    ("Go", ("go", "golang"), "programming_languages", True),
    ("Rust", ("rust",), "programming_languages", False),
    ("C", ("c",), "programming_languages", True),
    ("C++", ("c++", "cpp"), "programming_languages", False),
    ("C#", ("c#", "csharp"), "programming_languages", False),
    ("PHP", ("php",), "programming_languages", False),
    ("Ruby", ("ruby",), "programming_languages", False),
    ("Swift", ("swift",), "programming_languages", True),
    ("Kotlin", ("kotlin",), "programming_languages", False),
    ("SQL", ("sql",), "databases", False),
    ("PostgreSQL", ("postgresql", "postgres", "postgre sql"), "databases", False),
    ("MySQL", ("mysql",), "databases", False),
    ("MongoDB", ("mongodb", "mongo"), "databases", False),
    ("Redis", ("redis",), "databases", False),
    ("Elasticsearch", ("elasticsearch", "elastic search"), "databases", False),
    ("Docker", ("docker",), "devops", False),
    ("Kubernetes", ("kubernetes", "k8s"), "devops", False),
    ("Terraform", ("terraform",), "devops", False),
    ("Ansible", ("ansible",), "devops", False),
    ("Git", ("git",), "developer_tools", False),
    ("GitHub Actions", ("github actions",), "devops", False),
    ("GitLab CI", ("gitlab ci",), "devops", False),
    ("Jenkins", ("jenkins",), "devops", False),
    ("Linux", ("linux",), "platforms", False),
    ("AWS", ("aws", "amazon web services"), "cloud_platforms", True),
    ("Azure", ("azure",), "cloud_platforms", False),
    ("Google Cloud", ("google cloud", "gcp"), "cloud_platforms", False),
    ("FastAPI", ("fastapi",), "backend_frameworks", False),
    ("Django", ("django",), "backend_frameworks", False),
    ("Flask", ("flask",), "backend_frameworks", False),
    ("Spring Boot", ("spring boot",), "backend_frameworks", False),
    ("Node.js", ("node.js", "nodejs", "node"), "backend_frameworks", True),
    ("Express", ("express",), "backend_frameworks", True),
    ("NestJS", ("nestjs", "nest js"), "backend_frameworks", False),
    ("React", ("react", "reactjs", "react.js"), "frontend_frameworks", True),
    ("Next.js", ("next.js", "nextjs"), "frontend_frameworks", False),
    ("Vue.js", ("vue", "vue.js", "vuejs"), "frontend_frameworks", True),
    ("Angular", ("angular",), "frontend_frameworks", False),
    ("Svelte", ("svelte",), "frontend_frameworks", False),
    ("HTML", ("html", "html5"), "frontend_core", False),
    ("CSS", ("css", "css3"), "frontend_core", False),
    ("Tailwind CSS", ("tailwind", "tailwind css"), "frontend_frameworks", False),
    ("GraphQL", ("graphql",), "api_design", False),
    ("REST API", ("rest api", "restful api", "rest apis"), "api_design", False),
    ("gRPC", ("grpc",), "api_design", False),
    ("Prisma", ("prisma",), "backend_frameworks", False),
    ("tRPC", ("trpc", "t-rpc"), "api_design", False),
    ("LangChain", ("langchain",), "ai_ml", False),
    ("OpenAI", ("openai",), "ai_ml", False),
    ("Machine Learning", ("machine learning", "ml"), "ai_ml", True),
    ("Deep Learning", ("deep learning",), "ai_ml", False),
    ("PyTorch", ("pytorch",), "ai_ml", False),
    ("TensorFlow", ("tensorflow",), "ai_ml", False),
    ("Pandas", ("pandas",), "data_engineering", False),
    ("NumPy", ("numpy",), "data_engineering", False),
    ("dbt", ("dbt",), "data_engineering", False),
    ("Airflow", ("airflow",), "data_engineering", False),
    ("Spark", ("spark", "apache spark"), "data_engineering", True),
    ("Kafka", ("kafka", "apache kafka"), "messaging", False),
    ("RabbitMQ", ("rabbitmq",), "messaging", False),
    ("Microservices", ("microservices", "micro services"), "architecture", False),
    ("CI/CD", ("ci/cd", "cicd", "ci cd"), "devops", False),
    ("Pytest", ("pytest",), "quality_engineering", False),
    ("Unit Testing", ("unit testing",), "quality_engineering", False),
    ("Integration Testing", ("integration testing",), "quality_engineering", False),
    ("Communication", ("communication", "iletişim", "kommunikation"), "soft_skills", False),
    ("Leadership", ("leadership", "liderlik", "führung"), "soft_skills", False),
    ("Problem Solving", ("problem solving", "problem çözme", "problemlösung"), "soft_skills", False),
)
# Words of context, how far from an alias they may stand, sections that need none, the shortest alias.
CONTEXT = (
    "using", "with", "built", "developed", "experience", "worked", "stack", "tooling", "framework", "backend", "frontend", "api", "cloud", "database", "microservice", "testing",
    "automation",
)
WINDOW, PLAIN_SECTIONS, LEAST_LENGTH, SOFT = 48, ("skills", "projects"), 2, "soft_skills"
# The parts of the confidence and its levels.
BASE, NAMED, SIGNAL, COMMON = 0.62, 0.12, 0.08, 0.2
BOOSTS = {"skills": 0.35, "projects": 0.18, "experience": 0.12, "summary": 0.08, "header": 0.05}
HIGH, MEDIUM = 0.82, 0.58


def aliases() -> list[tuple[int, int, str]]:
    """(place of the skill in the catalogue, running number, alias) of every alias that is long enough."""
    own = [(i, a) for i, (_, names, _, _) in enumerate(CATALOGUE) for a in names if len(a) >= LEAST_LENGTH]
    return [(i, n, a) for n, (i, a) in enumerate(own)]


def _trie(words: list[str]) -> str:
    """An expression that matches the words, each beginning walked once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = "|".join(re.escape(c) + _trie(rest) for c, rest in heads.items())
    return "" if not heads else f"(?:{branches}){'?' if '' in words else ''}"


@lru_cache(maxsize=1)
def _patterns():
    own = aliases()
    edge = lambda a: r"\w" if re.fullmatch("[A-Za-z0-9]+", a) else "[A-Za-z0-9]"
    tests: dict[str, list[tuple[int, int, re.Pattern]]] = {}
    for i, n, a in own:
        tests.setdefault(a[0], []).append((i, n, re.compile(rf"(?<!{edge(a)}){re.escape(a)}(?!{edge(a)})", re.I)))
    anywhere = re.compile(rf"(?<![A-Za-z0-9])(?={_trie([a for _, _, a in own])})", re.I)
    return anywhere, tests, [t for own in tests.values() for t in own], re.compile(rf"\b(?:{'|'.join(CONTEXT)})\b", re.I)


def _met(text: str | None) -> list[dict]:
    anywhere, tests, every, context = _patterns()
    found = []
    for at in anywhere.finditer(text or ""):
        start = at.start()
        for i, n, pattern in tests.get(text[start].lower(), every):
            m = pattern.match(text, start)
            if m:
                near = not CATALOGUE[i][3] or context.search(text[max(start - WINDOW, 0) : m.end() + WINDOW]) is not None
                found.append({"skill": i, "alias": n, "start": start, "matched": m.group(), "near": near})
    return found


def mentions(text: Column) -> Column:
    """array of struct(skill, alias, start, matched, near): every alias met, near where no context is missing."""

    @F.pandas_udf("array<struct<skill: int, alias: int, start: int, matched: string, near: boolean>>")
    def met(texts: pd.Series) -> pd.Series:
        return texts.map(_met)

    return met(text)


def resolve(rows: DataFrame, keys: list[str], place: str, section: str, text: str) -> DataFrame:
    """(keys, skill, category, kind, section, matched, ambiguous, confidence, level): the skills that the sections of each key name.

    place: a column that orders the sections of a key.
    """
    name = F.lower(F.coalesce(F.col(section), F.lit("other")))
    signal = F.coalesce(F.col(text).rlike(rf"(?iU)\b(?:{'|'.join(CONTEXT)})\b"), F.lit(False))
    own = rows.select(F.struct(*keys).alias("k"), F.col(place).alias("place"), name.alias("section"), signal.alias("signal"), mentions(F.col(text)).alias("m"))
    met = own.select("k", "place", "section", "signal", F.explode("m").alias("m")).filter(F.col("m.near") | F.col("section").isin(*PLAIN_SECTIONS))
    known = F.element_at(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(x).alias("ambiguous")) for n, _, c, x in CATALOGUE]), F.col("m.skill") + 1)
    boost = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in BOOSTS.items() for v in pair]), F.col("section")), F.lit(0.0))
    sure = F.lit(BASE) + NAMED + boost + F.when(F.col("signal"), SIGNAL).otherwise(0.0) - F.when(F.col("known.ambiguous"), COMMON).otherwise(0.0)
    scored = met.withColumn("known", known).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 4))
    first = F.struct((-F.col("confidence")).alias("less"), "place", F.col("m.alias"), F.col("m.start"), "section", "confidence", F.col("m.matched"))
    best = scored.groupBy("k", "known").agg(F.min(first).alias("b"))
    level = F.when(F.col("b.confidence") >= HIGH, "high").when(F.col("b.confidence") >= MEDIUM, "medium").otherwise("low")
    kind = F.when(F.col("known.category") == SOFT, "soft_skill").otherwise("hard_skill")
    return best.select(
        "k.*", F.col("known.name").alias("skill"), "known.category", kind.alias("kind"), "b.section", "b.matched", "known.ambiguous", "b.confidence", level.alias("level")
    )
