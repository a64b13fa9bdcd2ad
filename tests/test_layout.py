"""Columns and reading order by scenarios and against a plain walk; the queries compare all pages with their SQL."""

import random

from tessera.operators import layout as L

SCHEMA = "doc int, page int, width double, x0 double, y0 double, x1 double, y1 double, n int, words string, column int, place string"


def ordered(spark, rows):
    made = spark.createDataFrame([(*r, 9, "mine") for r in rows], SCHEMA)
    return L.reading_order(made, ["doc", "page"], "width", ("x0", "y0", "x1", "y1"), "n", "words")


def walk(width, blocks):
    """[(number, column, sidebar)] in reading order by the plain rules; blocks: (number, x0, y0, x1)."""
    gap, clusters = max(width * 0.14, 36.0), []
    for b in sorted(blocks, key=lambda b: ((b[1] + b[3]) / 2, b[2], b[0])):
        mean = sum((x[1] + x[3]) / 2 for x in clusters[-1]) / len(clusters[-1]) if clusters else None
        if mean is None or (abs((b[1] + b[3]) / 2 - mean) > gap and len(clusters) < 3):
            clusters.append([])
        clusters[-1].append(b)
    clusters.sort(key=lambda c: min(b[1] for b in c))
    side = [(max(b[3] for b in c) - min(b[1] for b in c)) / width <= 0.35 for c in clusters]
    down = lambda b: (b[2], b[1], b[0])
    wide = {b[0] for b in blocks if (b[3] - b[1]) / width >= 0.68}
    places = {b[0]: (i, side[i]) for i, c in enumerate(clusters) for b in c}
    order = [b for b in sorted(blocks, key=down) if b[0] in wide]
    for late in (False, True):
        for c, s in zip(clusters, side, strict=True):
            if (s and not all(side)) == late:
                order += [b for b in sorted(c, key=down) if b[0] not in wide]
    return [(b[0], *places[b[0]]) for b in order]


def test_main_columns_come_before_sidebars(spark):
    rows = [
        (1, 0, 600.0, 20.0, 10.0, 560.0, 60.0, 0, "Alice Example"),
        (1, 0, 600.0, 20.0, 80.0, 150.0, 200.0, 1, " Python\nSQL "),
        (1, 0, 600.0, 210.0, 90.0, 550.0, 120.0, 2, "Senior Backend Engineer"),
        (1, 0, 600.0, 210.0, 130.0, 550.0, 220.0, 3, "ACME Corp\n2021 - Present"),
        (1, 1, 600.0, 50.0, 10.0, 300.0, 20.0, 0, "  "),
        (2, 0, 600.0, 20.0, 10.0, 150.0, 20.0, 0, None),
    ]
    got = {(r.doc, r.page, r.n): r for r in ordered(spark, rows).collect()}
    assert [n for _, n in sorted((r.place, n) for (d, p, n), r in got.items() if d == 1 and p == 0)] == [0, 2, 3, 1]
    assert got[1, 0, 1].sidebar and not got[1, 0, 2].sidebar and got[1, 0, 0].wide and got[1, 0, 0].columns == 3 and got[1, 1, 0].columns == 1
    texts = {r.doc: r for r in L.reading_text(ordered(spark, rows), ["doc"], "page", "words").collect()}
    assert texts[1].words == "Alice Example\n\nSenior Backend Engineer\n\nACME Corp\n2021 - Present\n\nPython\nSQL" and texts[1].pages == 2 and texts[1].multi_column
    assert (texts[2].words, texts[2].multi_column) == ("", False)


def test_against_a_plain_walk(spark):
    rng, rows, want = random.Random(3), [], {}
    for doc in range(120):
        width = rng.choice((600.0, 200.0, 850.0))
        blocks = []
        for n in range(rng.randrange(1, 14)):
            x0 = float(rng.randrange(0, int(width)))
            blocks.append((n, x0, float(rng.randrange(0, 5) * 10), x0 + rng.randrange(0, int(width * 0.9))))
        rows += [(doc, 0, width, x0, y0, x1, y0 + 5, n, f"t{n}") for n, x0, y0, x1 in blocks]
        want[doc] = walk(width, blocks)
    got = {}
    for r in sorted(ordered(spark, rows).collect(), key=lambda r: (r.doc, r.place)):
        got.setdefault(r.doc, []).append((r.n, r.column, r.sidebar))
    assert got == want


def test_nothing_and_missing_places(spark):
    assert ordered(spark, []).count() == 0
    got = ordered(spark, [(1, 0, None, None, None, None, None, 0, "a"), (1, 0, None, 5.0, None, 9.0, None, 1, "b"), (1, 0, None, 5.0, None, 9.0, None, 1, "b")]).collect()
    assert sorted((r.n, r.place, r.wide) for r in got) == [(0, 2, False), (1, 0, True), (1, 1, True)]
