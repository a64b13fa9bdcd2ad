"""Personal data by a semi-Markov conditional random field over candidate segments.

Two parts give the spans of a whole text. Fixed patterns (``base_spans``) find e-mail addresses, IPv4
addresses, card and phone numbers in their plain forms. The random field adds what is written
otherwise (phone numbers without a plus, spelled-out or bracketed e-mail addresses, cards and
addresses with other separators): features of whole spans (digit groups, shape, Luhn sum, octets,
separators, neighbours) score every admissible segment, and a dynamic program over segments of at
most ``MAX_TOKENS`` tokens (of an address: between any of its possible beginnings and ends) chooses borders
and kinds together. Text that cannot belong to an admissible
segment can only be outside, at score 0, so the program runs over the regions that can; regions that
overlap are one lattice, so it is exact for the whole text. Added spans never overlap base spans.

Learning: generated values in many notations between the words of at most ``SAMPLE`` documents, alone or
next to each other, and at most ``OWN`` regions of those documents themselves with their base
matches; weights maximise the conditional likelihood by forward-backward over the segment lattice.

Edge cases: a null text is an empty one, without spans; offsets are code points, ends exclusive;
equal texts have equal spans; extra columns are not looked at; an empty table trains on generated
values alone.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, hashed_sample

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
MAX_TOKENS = 15
#: The fewest digits of an admissible segment; those of an address of four octets.
LEAST_DIGITS = 4
#: Places at which an address can begin or end that are offered, besides the outermost one.
BORDERS = 12
#: Distinct texts that the field is trained on at most, those with the lowest hashes.
SAMPLE = 300
#: Generated lines that the field is trained on, and regions of the sampled texts at most (drawn evenly).
LINES, OWN = 1200, 600
#: Texts that a worker holds as strings at a time while it redacts.
TEXTS = 256

# The plain forms. Possessive where the written form cannot profit from giving back.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the plain forms; leftmost and without overlaps within a kind."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.groups()):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


#: Where admissible segments of numbers, and of e-mail addresses, can lie.
NUMBERS = re.compile(r"[0-9+(\[](?:[0-9 ().+/\[\]-]*+)")
DOT = r" ?(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]| (?:dot|DOT) ) ?"
ADDRESS = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]++) ?(?:@|[\[({] ?(?:at|AT) ?[\])}]| (?:at|AT) ) ?(?P<first>[A-Za-z0-9-]++)(?:" + DOT + "[A-Za-z0-9-]++)+"
)
LABEL = re.compile(f"({DOT})([A-Za-z0-9-]+)")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)


@dataclass(frozen=True)
class Region:
    """A stretch in which segments can lie; numbers and addresses: the parts of it where segments of numbers, and an e-mail address, can."""

    text: str
    start: int
    end: int
    numbers: tuple[tuple[int, int], ...]
    addresses: tuple[tuple[int, int], ...]


def regions(text: str) -> list[Region]:
    """In text order; stretches that overlap are one region."""
    found = [(*m.span(), True) for m in NUMBERS.finditer(text) if sum(map(str.isdigit, m[0])) >= LEAST_DIGITS]
    if "@" in text or " at " in text or " AT " in text or "at" in text.lower() and ("[" in text or "(" in text or "{" in text):
        found += [(*m.span(), False) for m in ADDRESS.finditer(text)]
    out: list[list[tuple[int, int, bool]]] = []
    end = 0
    for s in sorted(found):
        if out and s[0] < end:
            out[-1].append(s)
        else:
            out.append([s])
        end = max(end, s[1])
    pick = lambda some, kind: tuple(s[:2] for s in some if s[2] == kind)
    return [Region(text, some[0][0], max(s[1] for s in some), pick(some, True), pick(some, False)) for some in out]


def address_borders(text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Where an address in a stretch can begin, nearest to its at-sign last, and where it can end: after its second label, its third and so on."""
    m = ADDRESS.match(text, start)
    stop = m.end("local")
    begins = [p for p in range(start, stop) if text[p].isalnum() and (p == start or text[p - 1] in "._%+-")] or [start]
    ends = [x.end() for x in LABEL.finditer(text, m.end("first"), end)]
    return begins[:1] + begins[1:][-BORDERS:], ends[:BORDERS] + ends[BORDERS:][-1:]


def char_class(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() or not c else "p"


def span_features(kind: int, s: str, left: str, right: str) -> list[str]:
    """What a whole segment looks like, for one kind."""
    k = KINDS[kind]
    if kind == 0:
        at = "@" if "@" in s else "br" if re.search(r"[\[({] ?at ?[\])}]", s, re.I) else "w"
        labels = LABEL.findall(s, ADDRESS.match(s).end("first"))
        dots = ["br" if re.search(r"[\[({]", d) else "w" if d[-2:-1].lower() == "t" else d for d, _ in labels]
        tail = labels[-1][1]
        case = "T" if tail[0].isupper() and not tail.isupper() else "U" if tail.isupper() else "l"
        after = "".join(c if c in ".,[(" else char_class(c) for c in right[:2])
        out = [f"{k}|1", f"{k}|at={at}", f"{k}|dot={dots[0]}", f"{k}|at={at},dot={dots[0]}", f"{k}|tail={min(len(tail), 7)},{tail.isalpha()}", f"{k}|gap={' @' in s or '@ ' in s}"]
        out += [f"{k}|case={case}", f"{k}|last={dots[-1]},{case}", f"{k}|last={dots[-1]},{min(len(tail), 7)}", f"{k}|mixed={len(set(dots)) > 1}", f"{k}|labels={min(len(labels), 5)}", f"{k}|R={after}", f"{k}|L={left if left in '._%+-' else char_class(left)}"]
        return out + [f"{k}|word={tail.lower()}"] * (len(tail) < 6)
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    n = len(digits)
    inner = re.sub("[0-9]+", "#", s)
    seps = "".join(sorted(set(inner) - {"#"}))
    out = [f"{k}|1", f"{k}|n={min(n, 20)}", f"{k}|seps={seps}", f"{k}|groups={min(len(groups), 6)}", f"{k}|L={char_class(left)}", f"{k}|R={char_class(right)}", f"{k}|form={inner[:24]}", f"{k}|lens={','.join(str(len(g)) for g in groups[:6])}"]
    if kind == 1:
        octets = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
        out += [f"{k}|octets={octets}", f"{k}|octets={octets},form={inner[:24]}"]
    elif kind == 2:
        ok = 12 <= n <= 19 and luhn(digits)
        out += [f"{k}|luhn={ok}", f"{k}|luhn={ok},groups={min(len(groups), 6)}", f"{k}|luhn={ok},seps={seps}"]
    else:
        out += [f"{k}|lead={s[0] if not s[0].isdigit() else min(len(groups[0]), 5)}", f"{k}|split={len(groups) > 2}", f"{k}|n={min(n, 20)},split={len(groups) > 2}"]
    return out


def lattice(r: Region) -> tuple[int, list[tuple[int, int, int, list[str]]], list[int]]:
    """Number of tokens, admissible segments (first token, end token, kind, features), and the tokens' places in the text."""
    t = r.text
    s = t[r.start : r.end].rstrip()
    places = [r.start + m.start() for m in TOKEN.finditer(s)] + [r.start + len(s)]
    n, at = len(places) - 1, {p: i for i, p in enumerate(places)}
    segs = [(i, i + 1, OUTSIDE, ["O|" + char_class(t[places[i]])]) for i in range(n)]
    for a, z in r.addresses:
        first, last = address_borders(t, a, z)
        segs += [(at[x], at[y], 0, span_features(0, t[x:y], t[x - 1] if x else "", t[y : y + 2])) for x in first for y in last]
    for low, high in r.numbers:
        i = at[low]
        while i < n and places[i] < high:
            a = places[i]
            digits = 0
            if (t[a] in "+([" or t[a].isdigit()) and not (a and t[a - 1].isalnum() and t[a].isdigit()):
                for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                    z = places[j]
                    if z > high:
                        break
                    if not t[z - 1].isdigit():
                        continue
                    digits += z - places[j - 1]
                    if digits > 19:
                        break
                    if digits >= LEAST_DIGITS and not (z < len(t) and t[z].isalnum()):
                        left, right = t[a - 1] if a else "", t[z] if z < len(t) else ""
                        segs += [(i, j, k, span_features(k, t[a:z], left, right)) for k in (1, 2, 3) if (LEAST_DIGITS, 12, 7)[k - 1] <= digits <= (12, 19, 15)[k - 1]]
            i += 1
    return n, sorted(segs), places


@dataclass(frozen=True)
class SpanField:
    """Weights of span features; a feature that was never seen weighs nothing."""

    weights: dict[str, float]

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum([w.get(f, 0.0) for f in features])

    def best(self, r: Region) -> list[tuple[int, int, int]]:
        """The highest-scoring segmentation's entities."""
        n, segs, places = lattice(r)
        top, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for i, j, k, f in segs:  # in the order of their first tokens
            v = top[i] + self.score(f)
            if v > top[j]:
                top[j], back[j] = v, (i, k)
        out = []
        while n:
            i, k = back[n]
            if k != OUTSIDE:
                out.append((places[i], places[n], k))
            n = i
        return out[::-1]

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and the spans that the field adds."""
        text = text or ""
        base = base_spans(text)
        taken = iter(sorted((a, z) for a, z, _ in base))
        free, held, reach = [], next(taken, None), 0
        for a, z, k in (s for r in regions(text) for s in self.best(r)):  # in text order, without overlaps
            while held and held[0] < z:
                reach, held = max(reach, held[1]), next(taken, None)
            if reach <= a:
                free.append((a, z, k))
        return base, free


def gradient(r: Region, gold: list[tuple[int, int, int]], weights: dict[str, float]) -> dict[str, float]:
    """Of the log-likelihood of the gold segmentation, by forward-backward over the segments."""
    n, segs, places = lattice(r)
    field = SpanField(weights)
    scores = [field.score(s[3]) for s in segs]
    at = {p: i for i, p in enumerate(places)}
    entities = {(at[a], at[z], k) for a, z, k in gold if a in at and z in at}
    inside = {t for i, j, _ in entities for t in range(i, j)}
    if len(entities) != len(gold) or not entities <= {s[:3] for s in segs}:
        return {}
    log_sum = lambda x: (m := max(x)) + math.log(sum(math.exp(v - m) for v in x))
    fwd = [0.0] * (n + 1)
    by_end = [[] for _ in range(n + 1)]
    by_start = [[] for _ in range(n + 1)]
    for q, (i, j, _, _) in enumerate(segs):
        by_end[j].append(q)
        by_start[i].append(q)
    for j in range(1, n + 1):
        fwd[j] = log_sum([fwd[segs[q][0]] + scores[q] for q in by_end[j]])
    bwd = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bwd[i] = log_sum([bwd[segs[q][1]] + scores[q] for q in by_start[i]])
    out: dict[str, float] = {}
    for q, (i, j, k, f) in enumerate(segs):
        p = math.exp(fwd[i] + scores[q] + bwd[j] - fwd[n])
        want = (i, j, k) in entities if k != OUTSIDE else i not in inside
        if abs(want - p) > 1e-4:
            for x in f:
                out[x] = out.get(x, 0.0) + want - p
    return out


def card_number(rng: random.Random, good: bool) -> str:
    head = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
    check = next(d for d in "0123456789" if luhn(head + d))
    return head + (check if good else str((int(check) + rng.randint(1, 9)) % 10))


def example(rng: random.Random, words: list[str]) -> tuple[str, int | None]:
    """A value in some notation, and its kind; None for one that is no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    a, b, c = str(rng.randint(200, 999)), d(3), d(4)
    card, not_card = card_number(rng, True), card_number(rng, False)
    four = lambda x, sep: sep.join(x[k : k + 4] for k in range(0, 16, 4))
    highest = rng.choice((9, 99, 255))
    o = [str(rng.randint(0, highest)) for _ in range(4)]
    who = rng.choice(words) + rng.choice(["", ".", "_"]) + rng.choice(words)
    host = rng.choice(["", "", "", "mail.", rng.choice(words) + "."]) + rng.choice(words) + "." + rng.choice(["com", "com", "com", "org", "net", "de", "fr", "es", "it", "eu", "io", "edu", "info", "co.uk"])
    forms: list[tuple[str, int | None]] = [
        (f"+1 ({a}) {b}-{c}", 3), (f"({a}) {b}-{c}", 3), (f"{a}-{b}-{c}", 3), (f"{a}.{b}.{c}", 3), (f"{a} {b} {c}", 3), (f"001 {a} {b} {c}", 3), (f"1-{a}-{b}-{c}", 3), (f"+{a[:2]} {b} {c}{b}", 3), (f"({a}){b}-{c}", 3),
        (card, 2), (four(card, " "), 2), (four(card, "-"), 2), (four(card, "."), 2), (four(card, "/"), 2),
        (".".join(o), 1), ("[.]".join(o), 1), (f"{o[0]}.{o[1]}.{o[2]}[.]{o[3]}", 1), ("(.)".join(o), 1),
        (f"{who}@{host}", 0), (f"{who} [at] {host}", 0), (f"{who}(at){host}", 0), (f"{who} at {host.replace('.', ' dot ')}", 0), (f"{who} [at] {host.replace('.', ' [dot] ')}", 0), (f"{who} @ {host}", 0),
        (not_card, None), (four(not_card, " "), None), (four(not_card, "."), None), (f"20{d(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", None), (f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/20{d(2)}", None),
        (d(4), None), (d(5), None), (d(6), None), (f"{d(2)}.{d(2)}", None), (f"{d(1)}.{d(1)}.{d(2)}", None), (f"({d(4)})", None), (f"{d(2)} {d(2)} {d(2)}", None), (f"{o[0]} [{o[1]}] {o[2]} [{o[3]}]", None), (f"[{o[0]}] {o[1]} [{o[2]}] {o[3]}", None), (f"{o[0]} ({o[1]}) {o[2]} ({o[3]})", None), (d(7), None), (d(8), None), (d(9), None), (d(10), None), (d(11), None), (d(13), None), (d(20), None), (f"{d(2)} {d(3)} {d(2)} {d(2)} {d(3)}", None), (" ".join(d(rng.randint(1, 4)) for _ in range(8)), None),
        (f"{d(1)}.{d(3)}.{d(3)}", None), (f"{d(3)}.{d(3)}.{d(3)}.{d(2)}", None), (f"{o[0]}.{o[1]}.{d(4)}.{o[3]}", None), (f"{o[0]}-{o[1]}-{o[2]}-{o[3]}", None), (f"{o[0]} {o[1]} {o[2]} {o[3]}", None), (f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", None), (f"{d(4)}-{d(4)}", None), (f"{d(5)}-{d(4)}", None),
        (f"{rng.choice(words)} at {rng.choice(words)}. {rng.choice(words)}", None), (f"{rng.choice(words)} at {rng.choice(words)}.{rng.choice(words).title()}", None),
    ]
    value, kind = rng.choice(forms)
    if kind is None and luhn(re.sub("[^0-9]", "", value) or "1") and 12 <= sum(map(str.isdigit, value)) <= 19:
        return example(rng, words)
    return value, kind


def line(rng: random.Random, words: list[str]) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of sampled words around a value, or two that stand next to each other, with their gold spans."""
    before, after = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) for _ in range(2)]
    after = after[:1].upper() + after[1:] if rng.random() < 0.5 else after
    text, gold = before + (rng.choice([" ", " ", " ", ": ", "\n"]) if before else ""), []
    for k in range(rng.choice((1, 1, 2))):
        value, kind = example(rng, words)
        text += rng.choice([" ", " ", ", ", " / ", ". ", " and "]) * k
        if kind is not None:
            gold.append((len(text), len(text) + len(value), kind))
        text += value
    return text + rng.choice([" ", " ", ". ", ". ", ".\n", ", ", "### ", "\n", ") "]) + after, gold


def doubtful(r: Region, gold: list[tuple[int, int, int]]) -> bool:
    """Whether a valid card or address number lies apart from all plain matches: the patterns take digits before it along, so they say nothing about it."""
    n, segs, places = lattice(r)
    valid = [(places[i], places[j]) for i, j, _, f in segs if "card|luhn=True" in f or "ip|octets=True" in f]
    return any(all(z <= x or a >= y for x, y, _ in gold) for a, z in valid)


def fit(texts: list[str], seed: int = 7, lines: int = LINES, own: int = OWN, epochs: int = 4) -> SpanField:
    """Train on values in many notations between the words of the given texts, and on the regions of those texts themselves."""
    rng = random.Random(seed)
    words = sorted({w for t in texts for w in re.findall("[A-Za-z]{2,12}", t)} - {"at", "dot"}) or ["the", "of", "and", "was", "with"]
    data, found = [], []
    for _ in range(lines):
        text, gold = line(rng, words)
        data += [(r, [g for g in gold if r.start <= g[0] and g[1] <= r.end]) for r in regions(text)]
    for t in texts:
        base = base_spans(t)
        for r in regions(t):
            inside = [s for s in base if r.start <= s[0] and s[1] <= r.end]
            if all(x[1] <= y[0] for x, y in zip(inside, inside[1:], strict=False)) and not doubtful(r, inside):
                found.append((r, inside))
    data += rng.sample(found, min(len(found), own))
    weights: dict[str, float] = {}
    square: dict[str, float] = {}
    for _ in range(epochs):
        rng.shuffle(data)
        for r, gold in data:
            for f, g in gradient(r, gold, weights).items():
                square[f] = square.get(f, 1e-3) + g * g
                weights[f] = weights.get(f, 0.0) * (1 - 1e-5) + 0.5 * g / math.sqrt(square[f])
    return SpanField({f: w for f, w in weights.items() if abs(w) > 1e-3})


def train(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> SpanField:
    """Fit on at most so many distinct texts, those whose hashes are lowest."""
    texts = hashed_sample(docs.select(F.col(text).alias("text")).filter(F.length(text) > 0), sample)
    field = fit(sorted(r["text"] for r in texts.collect()))
    give_back()
    return field


def spans_column(docs: DataFrame, field: SpanField, text: Column) -> Column:
    """struct(base, added): arrays of struct(start, finish, kind) in text order, for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = "array<struct<start:int,finish:int,kind:string>>"

    @F.pandas_udf(f"base {kind}, added {kind}")
    def found(texts: pd.Series) -> pd.DataFrame:
        f = shared.value
        named = lambda spans: [{"start": a, "finish": z, "kind": KINDS[k]} for a, z, k in spans]
        rows = [f.spans(t) for t in texts]
        return pd.DataFrame({"base": [named(b) for b, _ in rows], "added": [named(x) for _, x in rows]}, columns=["base", "added"])

    return found(F.coalesce(text, F.lit("")))


def of_kind(kind: str):
    """Condition on a span, for the higher-order functions."""
    return lambda span: span["kind"] == kind


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["finish"].alias("finish"), s["kind"].alias("kind"))
    return F.array_sort(F.transform(spans, rank))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["finish"])), ",")


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each stretch of (start, end, kind), overlapping ones taken together, replaced by the kind of its first span in brackets."""
    parts, end = [], 0
    for a, z, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])) if text else ():
        if a >= end:
            parts += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, z)
    return text if text is None else "".join(parts) + text[end:]


def redact_column(text: Column, spans: Column) -> Column:
    """The text with the given spans, an array of struct(start, finish, kind), replaced by their kinds."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series, found: pd.Series) -> pd.Series:
        own = [[] if some is None else [(s["start"], s["finish"], KINDS.index(s["kind"])) for s in some] for some in found]
        return pd.Series([redact(t, some) for t, some in zip(texts, own, strict=True)], dtype="object")

    return redacted(text, spans)


def redacted_batches(field: SpanField, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches with all spans of the whole texts replaced by their kinds, at most TEXTS rows at a time; null for null."""
    for whole in batches:
        at_text = whole.schema.get_field_index(text)
        for at in range(0, whole.num_rows, TEXTS):
            b = whole.slice(at, TEXTS)
            made = [redact(t, [s for some in field.spans(t) for s in some]) for t in b.column(at_text).to_pylist()]
            columns = [pa.array(made, pa.string()) if k == at_text else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, whole.schema.names)
            del b, made, columns
        del whole
        give_back()


def redacted_rows(docs: DataFrame, field: SpanField, text: str = "text") -> DataFrame:
    """docs with all spans of each whole text replaced by their kinds, found and replaced in one Python evaluation; null for null.

    A worker holds the strings of a few texts at a time; as a column those of a whole Arrow batch (10,000 rows by
    default) would be held at once, before and after.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.mapInArrow(lambda batches: redacted_batches(shared.value, batches, text), docs.schema)
