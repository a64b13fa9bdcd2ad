"""Postings and links from HTML pages and JSON payloads, and table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tessera.functions.text import normalize, normalize_url, strip_html

# Where payloads keep their list of postings, and each field of one.
LIST_KEYS = ("jobs", "data", "results", "items", "postings")
FIELDS = {"external_id": ("id", "jobId", "external_id"), "title": ("title", "text", "name"), "location": ("location.name", "categories.location", "location"), "url": ("absolute_url", "hostedUrl", "url", "apply_url"), "description": ("content", "description", "descriptionPlain")}
POSTING_PATHS = ("job", "jobs", "career", "careers", "position", "positions", "opening", "openings", "vacancy")


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, href, label) of every anchor of a page, in order."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r'(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    found = pages.select(key, F.posexplode(tags).alias("place", "tag"))
    return found.select(key, "place", F.regexp_extract("tag", r'href="([^"]*)"', 1).alias("href"), F.coalesce(strip_html(F.col("tag")), F.lit("")).alias("label"))


def absolute(base: Column, href: Column) -> Column:
    """A link as seen from its page."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat_ws("/", folder, href))


def posting_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Anchors that look like postings: a label of 4 to 140 characters with a letter, and a path that names one; each address once."""
    found = links(pages.select(key, url, html), key, html).join(pages.select(key, url), key)
    target = normalize_url(absolute(F.col(url), F.col("href")))
    path = F.lower(F.regexp_replace(target, r"^[a-z]+://[^/]*", ""))
    wanted = F.exists(F.split(path, "[/_.-]+"), lambda p: p.isin(*POSTING_PATHS))
    label = normalize(F.col("label"))
    kept = found.select(key, "place", target.alias("target"), label.alias("title"), wanted.alias("_w")).filter(F.col("_w") & F.length("title").between(4, 140) & F.col("title").rlike("[A-Za-z]"))
    return kept.groupBy(key, "target").agg(F.min(F.struct("place", "title")).alias("_f")).select(key, "target", "_f.place", "_f.title")


def json_postings(payloads: DataFrame, key: str, body: str, fields: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """One row for each posting of a JSON payload; broken or unknown payloads give none. fields: paths tried in turn for each column."""
    names = FIELDS | (fields or {})
    lists = F.coalesce(*[F.get_json_object(F.col(body), f"$.{k}") for k in LIST_KEYS], F.when(F.trim(F.col(body)).startswith("["), F.col(body)))
    items = F.from_json(lists, "array<string>", {"mode": "PERMISSIVE"})
    rows = payloads.select(key, F.posexplode(items).alias("place", "_item")).filter(F.col("_item").isNotNull())
    text = lambda path: F.get_json_object("_item", f"$.{path}")
    plain = lambda v: F.when(~v.startswith("{") & ~v.startswith("["), F.nullif(F.trim(v), F.lit("")))
    return rows.select(key, "place", *[F.coalesce(*[plain(text(p)) for p in paths]).alias(name) for name, paths in names.items()]).filter(F.col("title").isNotNull())


def fresh(cache: DataFrame, requests: DataFrame, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(cached rows that have not expired, requests that must be fetched again)."""
    alive = cache.filter(F.col("expires_at") > now)
    return alive.join(requests.select(key), key, "left_semi"), requests.join(alive.select(key), key, "left_anti")


def sorted_keys(value: Column, kind: DataType) -> Column:
    """A nested value with the keys of its maps and the fields of its structs in order, at every depth."""
    if isinstance(kind, StructType):
        fields = [sorted_keys(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k, sorted_keys(value[k], kind.valueType))))
    return value


def payload_json(value: Column, kind: DataType) -> Column:
    """Compact JSON of a nested value with sorted keys, nulls written out."""
    return F.to_json(sorted_keys(value, kind), {"ignoreNullFields": "false"})


def payload_hash(value: Column, kind: DataType) -> Column:
    """sha256 of a payload's JSON with sorted keys, so that the order of keys does not count; null for a null payload."""
    return F.sha2(payload_json(value, kind), 256)


def write_csv(df: DataFrame, where: str, columns: Sequence[str]) -> None:
    """CSV with a header: null as empty, booleans as true and false, nested values as JSON with sorted keys."""
    kinds = {f.name: f.dataType for f in df.schema}
    cell = lambda c: payload_json(F.col(c), kinds[c]) if isinstance(kinds[c], StructType | ArrayType | MapType) else F.col(c).cast("string")
    df.select(*[F.coalesce(cell(c), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(where)
