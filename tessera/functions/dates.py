"""Ranges of dates as people write them: month names in three languages, numbers, years alone, and what is still going on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vocabulary import bound

# Month names by language, in the order in which they are looked up (the first that a text holds counts).
MONTHS: dict[str, dict[str, int]] = {
    "en": {
        "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
        "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
    },
    "tr": {
        "oca": 1, "ocak": 1, "sub": 2, "subat": 2, "mar": 3, "mart": 3, "nis": 4, "nisan": 4, "may": 5, "mayis": 5, "haz": 6, "haziran": 6, "tem": 7, "temmuz": 7,
        "agu": 8, "agustos": 8, "eyl": 9, "eylul": 9, "eki": 10, "ekim": 10, "kas": 11, "kasim": 11, "ara": 12, "aralik": 12,
    },
    "de": {
        "jan": 1, "januar": 1, "feb": 2, "februar": 2, "mar": 3, "maerz": 3, "apr": 4, "april": 4, "mai": 5, "jun": 6, "juni": 6, "jul": 7, "juli": 7,
        "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "okt": 10, "oktober": 10, "nov": 11, "november": 11, "dez": 12, "dezember": 12,
    },
}
# What says that something goes on (folded), and how sure each notation is.
PRESENT = ("present", "current", "ongoing", "now", "today", "devam", "devam ediyor", "halen", "su an", "guncel", "bugun", "heute", "bis heute", "aktuell", "laufend", "gegenwart")
SURE_PRESENT, SURE_NUMERIC, SURE_MONTH, SURE_YEAR = 0.94, 0.88, 0.9, 0.7
YEAR = r"(?<!\d)(19\d{2}|20\d{2})(?!\d)"
MONTH_YEAR = r"(?<!\d)(0?[1-9]|1[0-2])[./-](19\d{2}|20\d{2})(?!\d)"
BETWEEN = r"(?i)\s*(?:-|–|—|to|until|through|bis)\s*"


def bare(text: Column) -> Column:
    """Bullets and bars as spaces, white space collapsed, no separators at either end."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[•|]", " "), r"(?U)\s+", " "), F.lit(" ,;:/"))


def folded(text: Column) -> Column:
    """Lower case without the marks of Turkish and German letters."""
    return F.trim(F.lower(F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), "şŞıİğĞüÜöÖçÇäÄ", "ssiigguuooccaa")))


def month_in(low: Column, language: Column) -> Column:
    """Number of the first month name, in the table's order, that is a word of a folded text; null without one."""

    def of(words: Column) -> Column:
        tables = F.create_map(*[x for name, months in MONTHS.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in months.items()]))])
        own = F.coalesce(tables[language], tables["en"])
        return F.get(F.filter(own, lambda m: F.array_contains(words, m["k"])), F.lit(0))["v"]

    return bound(F.regexp_extract_all(low, F.lit(r"(?U)(\w+)")), of)


def fragment(text: Column, language: Column) -> Column:
    """struct(year, month, present, confidence) of one date; null where the text holds none."""
    made = lambda y, m, p, c: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), F.lit(p).alias("present"), F.lit(c).alias("confidence"))
    group = lambda t, pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).cast("int")

    def parts(t: Column) -> Column:
        low = folded(t)
        return F.struct(low.isin(*PRESENT).alias("present"), group(t, MONTH_YEAR, 2).alias("numeric"), group(t, MONTH_YEAR, 1).alias("number"), month_in(low, language).alias("month"), group(t, YEAR, 1).alias("year"))

    def chosen(x: Column) -> Column:
        none, year = F.lit(None), x["year"]
        return (
            F.when(x["present"], made(none, none, True, SURE_PRESENT))
            .when(x["numeric"].isNotNull(), made(x["numeric"], x["number"], False, SURE_NUMERIC))
            .when(x["month"].isNotNull() & year.isNotNull(), made(year, x["month"], False, SURE_MONTH))
            .when(year.isNotNull(), made(year, none, False, SURE_YEAR))
        )

    return bound(bound(bare(text), parts), chosen)


def date_range(text: Column, language: Column) -> Column:
    """struct(start_year, start_month, end_year, end_month, present, confidence); null where the text holds no date.

    The text is cut at dashes and words such as "to"; the first two parts are read, else the whole text as one date.
    A second part that says "present" is a date of its own, so an open range is one of both parts.
    language: en, tr or de; others are read as en. Every value is bound once, so the expression stays small.
    """
    spoken = F.coalesce(language, F.lit("en"))
    none = F.lit(None).cast("int")
    made = lambda s, end_year, end_month, present, sure: F.struct(s["year"].alias("start_year"), s["month"].alias("start_month"), end_year.alias("end_year"), end_month.alias("end_month"), present.alias("present"), F.round(F.least(F.lit(1.0), sure), 4).alias("confidence"))

    def read(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, BETWEEN), lambda p: F.trim(p)), lambda p: p != "")
        # The first two parts and the whole text, each read by the one expression.
        return F.transform(F.concat(F.slice(F.concat(parts, F.array(F.lit(None), F.lit(None)).cast("array<string>")), 1, 2), F.array(t)), lambda p: F.when(p.isNotNull(), fragment(p, spoken)))

    def chosen(found: Column) -> Column:
        first, second, one = (F.get(found, F.lit(k)) for k in range(3))
        both = first.isNotNull() & second.isNotNull()
        return F.when(both, made(first, second["year"], second["month"], second["present"], (first["confidence"] + second["confidence"]) / 2)).when(one.isNotNull(), made(one, none, none, one["present"], one["confidence"]))

    return bound(bound(bare(text), read), chosen)


def month_interval(dates: Column, now_month: Column) -> Column:
    """struct(first, last): months since year 0 that a range covers, the last one not included; null where it has no start or ends before it.

    A start without a month is January, an end without one December; what still goes on ends with now_month.
    """

    def ends(r: Column) -> Column:
        first = r["start_year"] * 12 + F.coalesce(r["start_month"], F.lit(1)) - 1
        stated = r["end_year"] * 12 + F.coalesce(r["end_month"], F.lit(12))
        single = F.when(r["start_month"].isNull(), first + 12).otherwise(first + 1)
        return F.struct(first.alias("first"), F.when(r["present"], now_month + 1).otherwise(F.coalesce(stated, single)).alias("last"))

    return bound(bound(dates, ends), lambda i: F.when(i["last"] > i["first"], i))
