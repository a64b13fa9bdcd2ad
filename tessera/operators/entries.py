"""Entries of a section: runs of lines that belong to one position or school.

The lines are those of one section, without its heading. What a line can begin is told by expressions over the line alone; only these marks, one number for each
line, go through an ordered fold, whose state is whether an entry is open, has a year, and has a second line.

A line begins an entry if none is open. An open entry with a year also ends before a line with a year, a
line that names a role, company or school (no bullet, contact or long line), or a short line with a pipe;
but a line ``year company`` continues an entry that has a single line ``year role``. A blank line ends
an entry without a year and is passed over within others. Null or empty texts have no entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vocabulary import bound

# Words of roles, of schools, of companies, and places after which a line names a company.
ROLES = (
    "engineer", "developer", "analyst", "manager", "coordinator", "co-ordinator", "scientist", "architect", "assistant", "consultant", "specialist", "lead", "administrator",
    "designer", "intern", "technician", "researcher", "mühendis", "muhendis", "miihendis", "mühendisi", "muhendisi", "geliştirici", "analist", "uzman", "yönetici", "koordinatör",
    "koordinator", "koordinatörü", "koordinatoru", "tasarımcı", "praktikant", "ingenieur", "entwickler", "berater", "leiter", "spezialist", "forscher",
)
SCHOOLS = (
    "university", "universite", "üniversite", "universität", "universitat", "college", "kolej", "koleji", "institute", "institut", "school", "faculty", "academy", "lycee", "lycée",
    "high school", "lise", "lisesi", "okul", "okulu", "technical university",
)
COMPANIES = ("gmbh", "llc", "inc", "corp", "corporation", "ltd", "limited", "tic", "sanayi", "company", "co")
PLACES = ("istanbul", "ankara", "izmir", "mugla", "turkey")
# Lengths of lines that name something, that hold a pipe, and that follow a place.
NAMED, PIPED, PLACED = 80, 120, 100
# Patterns of years, bullets and contacts, and what stands around a line.
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)|(?i)(?:19|20)\d{2}\s*(?:-|–|—|to)\s*(?:(?:19|20)\d{2}|present|current|ongoing|heute|devam)"
BULLET = "^\\s*[•·*+«»<>\\-¢®©]\\s+"
CONTACT = r"(?i)[\w.+-]+@[\w.-]+\.[a-z]{2,}|https?://|www\.|linkedin|github"
PHONE = r"\+?[\d(][\d \t().-]{6,}\d"
AROUND = "•·|-–—,:;/"
#: Letters with marks and those that stand for them where words are compared.
MARKED, BARE = "şŞİğĞüÜöÖçÇäÄâÂàéÉèÈêÊîÎûÛôÔñ", "ssigguuooccaaaaaeeeeeeiiuuoon"
BLANK, DATED, BEGINS, TITLE, COMPANY = 1, 2, 4, 8, 16
#: Lines, and bytes of lines, of the rows that are marked together, about; a row beyond them goes by itself.
LINES, BYTES = 1 << 17, 4 << 20


def folded(line: Column) -> Column:
    return F.lower(F.replace(F.translate(line, MARKED, BARE), F.lit("ß"), F.lit("ss")))


def _bare(words: Iterable[str]) -> list[str]:
    return sorted({w.translate(str.maketrans(MARKED, BARE)) for w in words})


def _whole(words: Iterable[str]) -> str:
    return rf"(?U)(?<!\w)(?:{'|'.join(_bare(words))})(?!\w)"


def marks(lines: Column) -> Column:
    """What each line can begin or continue, as a sum of marks.

    Step by step over the whole array, so that what several tests need is computed once for a line.
    """
    step = lambda some, **more: F.transform(some, lambda x: F.struct(*[x[c].alias(c) for c in more.get("keep", ())], *[f(x).alias(c) for c, f in more.items() if c != "keep"]))
    rest = lambda low, begin: F.regexp_extract(low, rf"^(?:{begin})\s*[-–—]?\s+(.+)$", 1)
    clean = lambda line: F.regexp_replace(F.btrim(F.btrim(line, F.lit(" \t\r\n\x0b\x0c")), F.lit(AROUND)), r"\s+", " ")
    one = step(lines, line=lambda x: x, clean=clean, dated=lambda x: x.rlike(YEAR))
    two = step(one, keep=("line", "clean", "dated"), low=lambda x: folded(x["clean"]), phone=lambda x: F.trim(F.regexp_extract(x["clean"], PHONE, 0)))
    three = step(
        two,
        keep=("line", "clean", "dated", "low", "phone"),
        before=lambda x: F.when(F.length(x["clean"]) <= PLACED, F.regexp_replace(x["low"], rf"(?U)(?s)(?<!\w)(?:{'|'.join(PLACES)})(?!\w).*", "")),
        title=lambda x: rest(x["low"], r"(?:19|20)\d{2}"),
        company=lambda x: rest(x["low"], r"(?:19|20)\d{2}|present|current|ongoing|heute|devam"),
    )
    return F.transform(three, _mark)


def _mark(x: Column) -> Column:
    line, clean, low, dated, phone, before = (x[c] for c in ("line", "clean", "low", "dated", "phone", "before"))
    long_words, short_words = [w for w in _bare(SCHOOLS) if len(w) > 4], [w for w in _bare(SCHOOLS) if len(w) <= 4]
    school = low.rlike("|".join(long_words)) | low.rlike(_whole(short_words))
    placed = F.coalesce((before != low) & F.btrim(before, F.lit(" ,")).rlike(r"\S\s+\S"), F.lit(False))
    contact = ((phone != "") & ~phone.rlike(rf"^(?:{YEAR})$")) | clean.rlike(CONTACT)
    told = low.rlike(_whole(ROLES)) | school | low.rlike(_whole(COMPANIES)) | placed
    names = ~dated & (clean != "") & (F.length(clean) <= NAMED) & told & ~line.rlike(BULLET) & ~contact
    piped = (F.length(clean) <= PIPED) & F.contains(clean, F.lit("|"))
    flag = lambda c, n: F.when(c, n).otherwise(0)
    follows = (x["company"] != "") & ~x["company"].rlike(_whole(ROLES))
    every = flag(dated, DATED) + flag(dated | piped | names, BEGINS) + flag((x["title"] != "") & x["title"].rlike(_whole(ROLES)), TITLE) + flag(follows, COMPANY)
    return F.when(F.trim(line) == "", BLANK).otherwise(every)


def _cut(codes: Iterable[int] | None) -> list[dict[str, int]]:
    spans, first, last, size, dated, titled = [], None, 0, 0, False, False
    for at, c in enumerate(() if codes is None else codes):
        closes = not dated if c & BLANK else dated and c & BEGINS and not (size == 1 and titled and c & COMPANY)
        if first is not None and closes:
            spans.append({"first": first, "last": last})
            first = None
        if c & BLANK:
            continue
        if first is None:
            first, size, dated = at, 0, False
        last, size, dated = at, size + 1, dated or bool(c & DATED)
        titled = size == 1 and bool(c & TITLE)
    return spans if first is None else [*spans, {"first": first, "last": last}]


def spans(codes: Column) -> Column:
    """array of struct(first, last): the entries of lines with these marks, by the places of their lines."""

    @F.pandas_udf("array<struct<first: int, last: int>>")
    def fold(every: pd.Series) -> pd.Series:
        return every.map(_cut)

    return fold(codes)


def entries(lines: Column) -> Column:
    """array of arrays of lines: the entries of a section's lines, without blank ones."""
    both = F.struct(lines.alias("lines"), spans(marks(lines)).alias("spans"))
    return bound(both, lambda b: F.transform(b["spans"], lambda s: F.filter(F.slice(b["lines"], s["first"] + 1, s["last"] - s["first"] + 1), lambda x: F.trim(x) != "")))


def _pieces(sizes: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of runs of rows with at most LINES lines and BYTES bytes, a row at least."""
    lines, weight = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, weights))
    at = 0
    while at < len(sizes):
        end = min(np.searchsorted(lines, lines[at] + LINES, "right"), np.searchsorted(weight, weight[at] + BYTES, "right")) - 1
        end = max(at + 1, int(end))
        yield at, end
        at = end


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for many: their keys, the numbers of their lines, the different lines, and which of these each line is."""
    for b in batches:
        keys, every = b.columns
        sizes, flat = pc.list_value_length(every).fill_null(0).to_numpy(), every.flatten()
        begins = np.concatenate([[0], np.cumsum(sizes)])
        bytes_to = np.concatenate([[0], np.cumsum(pc.binary_length(flat).fill_null(0).to_numpy(), dtype=np.int64)])
        for at, end in _pieces(sizes, np.diff(bytes_to[begins])):
            coded = flat.slice(begins[at], begins[end] - begins[at]).dictionary_encode(null_encoding="encode")
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            places, counts = coded.indices.to_numpy().astype(np.int32), sizes[at:end].astype(np.int32)
            yield pa.RecordBatch.from_arrays([one(keys.slice(at, end - at)), pa.array([counts.tobytes()]), pa.array([places.tobytes()]), one(coded.dictionary)], ["keys", "counts", "places", "words"])


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _cut_all(codes: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each row, lines of each entry, places of these lines among all.

    codes: marks of the lines of all rows; held: lines that entries keep. Rows whose marks are alike are cut once.
    """
    both = (codes | np.where(held, 0, 32)).astype(np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(both)]).dictionary_encode()
    kept, lengths, n_kept, n_entries = [], [], [], []
    for like in rows.dictionary:
        like = np.frombuffer(like.as_py(), np.uint8)
        found = [[k for k in range(s["first"], s["last"] + 1) if like[k] < 32] for s in _cut((like & 31).tolist())]
        kept += (k for own in found for k in own)
        lengths += map(len, found)
        n_kept.append(sum(map(len, found)))
        n_entries.append(len(found))
    kind = rows.indices.to_numpy()
    n_kept, n_entries, kept, lengths = (np.array(x, np.int64) for x in (n_kept, n_entries, kept, lengths))
    first = lambda n: (np.cumsum(n) - n)[kind]
    places = kept[_ragged(first(n_kept), n_kept[kind])] + np.repeat(begins[:-1], n_kept[kind])
    return n_entries[kind], lengths[_ragged(first(n_entries), n_entries[kind])], places


def _unpacked(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    for b in batches:
        for row in range(b.num_rows):
            keys, words, marked = (b.column(c)[row].values for c in ("keys", "words", "marks"))
            counts, places = (np.frombuffer(b.column(c)[row].as_buffer(), np.int32) for c in ("counts", "places"))
            marked = marked.to_numpy()
            held = (marked & BLANK == 0) & words.is_valid().to_numpy(zero_copy_only=False)
            n_entries, n_lines, kept = _cut_all(marked[places], counts, held[places])
            own = pa.ListArray.from_arrays(offsets(n_lines), words.take(pa.array(places[kept])))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets(n_entries), own)], [key, "entries"])


def entry_rows(df: DataFrame, key: str, lines: str) -> DataFrame:
    """(key, entries) of rows (key, array of lines), entries as in ``entries``; rows without lines have none.

    For many rows that share lines: rows near each other are packed, their different lines are marked once,
    and rows whose marks are alike are cut once. Nothing is remembered beyond a pack, and no row is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    packed = df.select(key, lines).mapInArrow(_packed, f"keys array<{kind}>, counts binary, places binary, words array<string>")
    return packed.withColumn("marks", marks(F.col("words"))).mapInArrow(lambda batches: _unpacked(batches, key), f"`{key}` {kind}, entries array<array<string>>")
