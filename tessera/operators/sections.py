"""Sections of a document: lines that are headings by a score, and the lines that stand under each.

A line's score weighs how close it comes to a known name of a section, its capitals, its length, its last
character and its number of words. Lines are rows; a line belongs to the last heading before it, which a
running count of headings within the document tells, so long documents cost no more than their lines.
Only the comparison with the names, for lines short enough to matter, is Python (an Arrow batch at a time).

Edge cases: a text that is null or without lines has no sections; one without headings is a single section
``other``; lines before the first heading are the ``header``; empty lines at either end of a section go.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of sections by language, in the order in which they are compared (the first of the closest counts).
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "en": {
        "header": ("personal information", "contact information", "profile details"),
        "summary": ("summary", "professional summary", "profile", "about", "about me", "executive summary"),
        "experience": ("experience", "work experience", "professional experience", "employment history", "career history"),
        "education": ("education", "academic background", "academic history", "qualifications"),
        "skills": (
            "skills", "technical skills", "core skills", "tools", "skills and tools", "competencies", "tech stack", "techstack", "techstack & skills", "tech stack & skills",
            "techstack and skills", "tech stack and skills", "technical stack", "my stack", "stack", "technologies", "expertise",
        ),
        "languages": ("languages", "language skills", "linguistic skills"),
        "projects": ("projects", "selected projects", "project experience"),
        "certifications": ("certifications", "certificates", "licenses", "licenses and certifications"),
        "links": ("links", "online profiles", "profiles", "portfolio"),
    },
    "tr": {
        "header": ("kişisel bilgiler", "iletişim bilgileri", "profil bilgileri"),
        "summary": ("özet", "profil özeti", "hakkımda", "kariyer özeti", "profesyonel özet"),
        "experience": ("deneyim", "iş deneyimi", "profesyonel deneyim", "çalışma deneyimi", "kariyer geçmişi"),
        "education": ("eğitim", "eğitim bilgileri", "akademik geçmiş", "öğrenim durumu"),
        "skills": ("yetenekler", "beceriler", "teknik beceriler", "uzmanlıklar", "araçlar ve teknolojiler"),
        "languages": ("diller", "yabancı diller", "dil bilgisi", "dil yetkinlikleri"),
        "projects": ("projeler", "seçilmiş projeler", "proje deneyimi"),
        "certifications": ("sertifikalar", "sertifika", "sertifikasyonlar", "lisanslar ve sertifikalar"),
        "links": ("bağlantılar", "çevrimiçi profiller", "portföy", "profiller"),
    },
    "de": {
        "header": ("persönliche daten", "kontaktinformationen", "profilinformationen"),
        "summary": ("zusammenfassung", "profil", "über mich", "kurzprofil", "berufliches profil"),
        "experience": ("berufserfahrung", "erfahrung", "arbeitserfahrung", "professionelle erfahrung", "laufbahn"),
        "education": ("ausbildung", "bildung", "akademischer hintergrund", "qualifikationen"),
        "skills": ("fähigkeiten", "kenntnisse", "technische kenntnisse", "kompetenzen", "tools und technologien"),
        "languages": ("sprachen", "sprachkenntnisse", "fremdsprachen"),
        "projects": ("projekte", "ausgewählte projekte", "projekterfahrung"),
        "certifications": ("zertifikate", "zertifizierungen", "lizenzen", "lizenzen und zertifikate"),
        "links": ("links", "online profile", "portfolio", "profile"),
    },
}
# Weights of the score, what a heading needs at least, and how sure the other sections are.
NAME, CAPITALS, SHORT, ENDING, SHAPE = 0.62, 0.22, 0.08, 0.05, 0.03
LEAST_NAME, LEAST_SCORE, MOST_WORDS, HOLDS = 0.72, 0.58, 7, 0.95
HEADER_SURE, OTHER_SURE = 0.82, 0.35
SPLIT = re.compile(r"[\s/&,+|·•:;()\[\]{}\\-]+")


def plain(value: str) -> str:
    """Lower case without accents, punctuation as spaces, white space collapsed."""
    low = value
    if not value.isascii():
        low = unicodedata.normalize("NFKD", value)
        for c in set(low):
            if c > "\x7f" and unicodedata.combining(c):
                low = low.replace(c, "")
    low = low.lower()
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s/&,+|·•-]", " ", low)).strip()


@lru_cache(maxsize=8)
def names(language: str) -> list[tuple[str, str, frozenset[str]]]:
    """(section, plain name, its words) in order; languages without a table use the English one."""
    table = ALIASES.get(language, ALIASES["en"])
    return [(section, plain(a), frozenset(filter(None, SPLIT.split(plain(a))))) for section, own in table.items() for a in own]


@lru_cache(maxsize=8)
def by_word(language: str) -> tuple[dict[str, list[int]], int]:
    """The places of the names that hold each word; the length from which no line is like any name."""
    places: dict[str, list[int]] = {}
    for k, (_, _, own) in enumerate(names(language)):
        for w in own:
            places.setdefault(w, []).append(k)
    return places, int(max(len(name) for _, name, _ in names(language)) * (2 - LEAST_NAME) / LEAST_NAME) + 1


@lru_cache(maxsize=50_000)
def closest(line: str, language: str) -> tuple[str | None, float]:
    """The section whose name comes closest to a line, and how close; (None, 0) where none comes near enough to matter."""
    text = plain(line)
    if not text:
        return None, 0.0
    words, best, found = set(filter(None, SPLIT.split(text))), 0.0, None
    every, (places, long) = names(language), by_word(language)
    if len(text) > long:
        # Too long to be like a name: only those that it holds, or some words of, come near.
        near_by = {k for w in places.keys() & words for k in places[w]}.union(k for k, (_, name, _) in enumerate(every) if name in text)
        every = [every[k] for k in sorted(near_by)]
    for section, name, own in every:
        if text == name:
            near = 1.0
        elif name in text:
            near = HOLDS
        else:
            near = len(words & own) / max(len(own), 1)
            likeness = 2 * min(len(text), len(name)) / (len(text) + len(name))  # a bound of the ratio
            if likeness >= LEAST_NAME and likeness > max(best, near):
                near = max(near, SequenceMatcher(a=text, b=name).ratio())
        if near > best:
            best, found = near, section
    return (found, best) if best >= LEAST_NAME else (None, 0.0)


def named(line: Column, language: Column) -> Column:
    """struct(section, name): what ``closest`` finds."""

    @F.pandas_udf("section string, name double")
    def found(lines: pd.Series, languages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([closest(t, x) for t, x in zip(lines, languages, strict=True)], columns=["section", "name"]).astype({"section": object, "name": float})

    return found(line, language)


def heading_score(line: Column, name: Column) -> Column:
    words = F.regexp_count(line, F.lit(r"(?U)\S+"))
    letters, capitals = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Lu}"))
    short = F.when((words > 0) & (words <= MOST_WORDS), F.least(F.lit(1.0), 0.45 + (MOST_WORDS - words) / MOST_WORDS)).otherwise(0.0)
    ending = F.when(line == "", 0.0).when(F.right(line, F.lit(1)).isin(":", ";", ".", ","), 0.25).otherwise(1.0)
    shape = F.when(words == 1, 1.0).when(words == 2, 0.9).when(words <= 4, 0.7).when(words <= 6, 0.45).otherwise(0.1)
    upper = F.when(letters > 0, capitals / F.greatest(letters, F.lit(1))).otherwise(0.0)
    return F.least(F.lit(1.0), NAME * name + CAPITALS * upper + SHORT * short + ENDING * ending + SHAPE * shape)


def sections(docs: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, place, section, heading, confidence, lines): a row for each section of each document, in order.

    key: columns of docs that name a row; lines: the section's lines without its heading.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(language), F.lit("en")).alias("language"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    own = own.withColumn("line", F.trim(F.regexp_replace("line", r"(?U)\s+", " ")))
    scored = own.withColumn("n", named(F.col("line"), F.col("language")))
    # Letters and words are counted only in lines that come near a name.
    scored = scored.withColumn("score", F.when(F.col("n.name") >= LEAST_NAME, heading_score(F.col("line"), F.col("n.name"))))
    is_heading = F.coalesce((F.col("line") != "") & (F.col("n.name") >= LEAST_NAME) & (F.col("score") >= LEAST_SCORE), F.lit(False))
    marked = scored.select("key", "at", "line", F.when(is_heading, F.struct(F.col("n.section").alias("section"), F.col("line").alias("heading"), F.col("score").alias("score"))).alias("h"))
    order = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("place", F.count("h").over(order))
    text_at = F.when(F.col("h").isNull() & (F.col("line") != ""), F.col("at"))
    groups = placed.groupBy("key", "place").agg(
        F.max("h").alias("h"), F.min(text_at).alias("first"), F.max(text_at).alias("last"), F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("at", "line")))).alias("lines")
    )
    groups = groups.withColumn("headings", F.max("place").over(Window.partitionBy("key"))).filter("h is not null or first is not null")
    inner = F.filter("lines", lambda x: F.when(F.col("place") == 0, x["line"] != "").otherwise(x["at"].between(F.col("first"), F.col("last"))))
    section = F.when(F.col("headings") == 0, "other").when(F.col("place") == 0, "header").otherwise(F.col("h.section"))
    sure = F.when(F.col("headings") == 0, OTHER_SURE).when(F.col("place") == 0, HEADER_SURE).otherwise(F.round("h.score", 6))
    kept = F.transform(F.coalesce(inner, F.array().cast("array<struct<at:int,line:string>>")), lambda x: x["line"])
    return groups.select(F.col("key").alias(key), F.col("place").cast("int").alias("place"), section.alias("section"), F.col("h.heading").alias("heading"), sure.alias("confidence"), kept.alias("lines"))
