"""Personal data of a text with its offsets, the redacted text, and offsets of the one in the other.

A text is read once, by the task that holds it; findings, their places in the redacted text and that
text come out of one ordered pass, so that long texts and texts with many findings cost linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.documents import EMAIL, PHONE, URL

# Kinds in their order, confidences and replacements.
KINDS = ("full_name", "email", "phone_number", "address", "social_profile", "url")
CONFIDENCE = {"full_name": 0.98, "email": 0.99, "phone_number": 0.92, "address": 0.83, "social_profile": 0.95, "url": 0.85}
REPLACEMENT = {
    "full_name": "[REDACTED_NAME]",
    "email": "[REDACTED_EMAIL]",
    "phone_number": "[REDACTED_PHONE]",
    "address": "[REDACTED_ADDRESS]",
    "social_profile": "[REDACTED_PROFILE]",
    "url": "[REDACTED_URL]",
}
# Digits that a phone number has, letters that a name has, lines taken as addresses where no other number is asked for.
PHONE_DIGITS, NAME_LETTERS, ADDRESS_LINES = (7, 16), 4, 3
# Words of a street; a dot at the end must be followed by a letter or digit.
STREETS = ("street", "st.", "avenue", "ave.", "road", "rd.", "boulevard", "blvd.", "sokak", "sk.", "cadde", "caddesi", "cd.", "mahallesi", "mah.", "strasse", "straße", "weg", "platz")
# Hosts of profiles, and what of a profile's link stays.
PROFILES = ("linkedin.com/in/", "github.com/", "stackoverflow.com/users/")
HANDLES = ("/in/", "github.com/", "stackoverflow.com/users/")

SCHEMA = """struct<findings: array<struct<kind: string, start_offset: int, end_offset: int, raw: string, replacement: string,
    confidence: double, applied: boolean, new_start: int, new_end: int>>, redacted: string>"""
_FINDING = pa.struct([("kind", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("raw", pa.string()), ("replacement", pa.string()), ("confidence", pa.float64()), ("applied", pa.bool_()), ("new_start", pa.int32()), ("new_end", pa.int32())])
_ROW = pa.struct([("findings", pa.list_(_FINDING)), ("redacted", pa.string())])
#: Texts whose findings are Python objects at one time; a batch of Spark's has thousands.
PIECE = 64

_email, _phone, _url = (re.compile(p) for p in (EMAIL, PHONE, URL))
_street = re.compile(rf"\b(?:{'|'.join(map(re.escape, STREETS))})\b", re.IGNORECASE)


def _handle_hidden(link: str) -> str:
    cut = next((h for h in HANDLES if h in link), None)
    return link.split(cut)[0] + cut + REPLACEMENT["social_profile"] if cut else REPLACEMENT["social_profile"]


def _spans(text: str, name: str | None, links: bool, address_lines: int | None) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, place of the kind, replacement)."""
    if name and len(name.strip()) >= NAME_LETTERS:
        yield from ((*m.span(), 0, REPLACEMENT["full_name"]) for m in re.finditer(re.escape(name), text, re.IGNORECASE))
    yield from ((*m.span(), 1, REPLACEMENT["email"]) for m in _email.finditer(text))
    for m in _phone.finditer(text):
        if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= PHONE_DIGITS[1]:
            yield (*m.span(), 2, REPLACEMENT["phone_number"])
    at, left = 0, address_lines
    for line in text.splitlines(keepends=True):
        if left == 0:
            break
        if _street.search(line) and ("," in line or ";" in line or any(c.isdigit() for c in line)):
            yield at, at + len(line.splitlines()[0]), 3, REPLACEMENT["address"]
            left = None if left is None else left - 1
        at += len(line)
    for m in _url.finditer(text):
        if links:
            yield (*m.span(), 5, REPLACEMENT["url"])
        elif any(p in m[0].lower() for p in PROFILES):
            yield (*m.span(), 4, _handle_hidden(m[0]))


def _redacted(text: str | None, name: str | None, links: bool, address_lines: int | None) -> dict:
    if text is None:
        return {"findings": [], "redacted": None}
    found, end, moved, out = [], 0, 0, []
    for a, z, k, new in sorted(_spans(text, name, links, address_lines)):
        applied = a >= end
        if applied:
            out += text[end:a], new
        kind = KINDS[k]
        places = (a + moved, a + moved + len(new)) if applied else (None, None)
        found.append({"kind": kind, "start_offset": a, "end_offset": z, "raw": text[a:z], "replacement": new, "confidence": CONFIDENCE[kind], "applied": applied, "new_start": places[0], "new_end": places[1]})
        if applied:
            end, moved = z, moved + len(new) - (z - a)
    return {"findings": found, "redacted": "".join([*out, text[end:]])}


def _folded(texts: pa.Array, names: pa.Array, links: bool, address_lines: int | None = ADDRESS_LINES) -> pa.Array:
    """Findings and redacted texts of a batch, a few texts at a time, so that memory follows the batch's bytes."""
    parts = [pa.array([], _ROW)]
    for at in range(0, len(texts), PIECE):
        own = zip(texts.slice(at, PIECE).to_pylist(), names.slice(at, PIECE).to_pylist(), strict=True)
        parts.append(pa.array([_redacted(t, n, links, address_lines) for t, n in own], _ROW))
    return pa.concat_arrays(parts)


def redaction(text: Column, name: Column | None = None, links: bool = False, address_lines: int | None = ADDRESS_LINES) -> Column:
    """struct(findings, redacted) of a text.

    findings: kind, offsets in code points (end exclusive), raw text, replacement, confidence, whether it was
    applied, and the replacement's offsets in the redacted text; by start, then end, then kind. Where findings
    overlap, the first in this order is applied. name: whose literal name is sought, in any case. With links,
    every link goes; otherwise links to profiles lose their handles. address_lines: how many of a text's lines are
    taken as addresses, the first ones; None: all. A null text has no findings and stays null.
    """

    @F.arrow_udf(SCHEMA)
    def fold(texts: pa.Array, names: pa.Array) -> pa.Array:
        return _folded(texts, names, links, address_lines)

    return fold(text, F.lit(None).cast("string") if name is None else name)


def redaction_map(findings: Column) -> Column:
    """map(kind, its different raw texts): by start, the longer first."""
    longer_first = F.array_sort(F.transform(findings, lambda f: F.struct(f["start_offset"], -f["end_offset"], f["kind"].alias("kind"), f["raw"].alias("raw"))))
    kinds = F.array_distinct(F.transform(findings, lambda f: f["kind"]))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.array_distinct(F.transform(F.filter(longer_first, lambda f: f["kind"] == k), lambda f: f["raw"]))))


def _moved(findings: Column, offset: Column, start: str, end: str, to_start: str, to_end: str) -> Column:
    before = F.filter(findings, lambda f: f["applied"] & (f[start] <= offset))
    last = F.try_element_at(before, F.lit(-1))
    return F.when(last.isNull(), offset).when(offset >= last[end], offset - last[end] + last[to_end]).otherwise(last[to_start])


def to_redacted(findings: Column, offset: Column) -> Column:
    """Where an offset of the text lies in the redacted text; what was replaced lies where its replacement begins."""
    return _moved(findings, offset, "start_offset", "end_offset", "new_start", "new_end")


def to_original(findings: Column, offset: Column) -> Column:
    """Where an offset of the redacted text lies in the text; a replacement lies where that which it replaces begins."""
    return _moved(findings, offset, "new_start", "new_end", "start_offset", "end_offset")
