"""The methods themselves against exhaustive or independent computations."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, jaccard, jpeg, language, lm, pii, topk, toxicity


@pytest.fixture(scope="module")
def field():
    return pii.fit(["Some plain words of a text that trains the field, with numbers 12 and 345."])


def test_semi_markov_best_path_is_the_best_of_all(field):
    for text in ("(743) 555-3824", "10.1.2.3 4111.1111.1111.1111", "+1 22 333 444 55"):
        for r in pii.regions(text):
            n, segs, places = pii.lattice(r)
            starts = {}
            for s in segs:
                starts.setdefault(s[0], []).append(s)

            def paths(i):
                if i == n:
                    yield 0.0, ()
                for s in starts.get(i, ()):
                    for v, rest in paths(s[1]):
                        yield v + field.score(s[3]), ((places[s[0]], places[s[1]], s[2]), *rest)

            want = max(paths(0))[0]
            got = field.best(r)
            kept = [p for p in paths(0) if [x for x in p[1] if x[2] != pii.OUTSIDE] == got]
            assert max(p[0] for p in kept) == pytest.approx(want)


def test_gradient_is_that_of_the_likelihood():
    text, gold = "(743) 555-3824", [(0, 14, 3)]
    r = pii.regions(text)[0]
    n, segs, places = pii.lattice(r)
    rng = random.Random(1)
    weights = {f: rng.gauss(0, 0.3) for s in segs for f in s[3]}

    def likelihood(w):
        f = pii.SpanField(w)
        total = [0.0] + [-math.inf] * n
        for i, j, _, feats in segs:
            total[j] = np.logaddexp(total[j], total[i] + f.score(feats))
        want = next(s for s in segs if (places[s[0]], places[s[1]], s[2]) == gold[0])
        return f.score(want[3]) - total[n]

    g = pii.gradient(r, gold, weights)
    for name in rng.sample(sorted(g), 8):
        up, down = dict(weights), dict(weights)
        up[name] += 1e-5
        down[name] -= 1e-5
        assert g[name] == pytest.approx((likelihood(up) - likelihood(down)) / 2e-5, abs=1e-3)


def test_added_spans(field):
    found = lambda t: [(pii.KINDS[k], t[a:z]) for a, z, k in field.spans(t)[1]]
    assert found("call (743) 555-3824 now") == [("phone", "(743) 555-3824")]
    assert found("card 4111.1111.1111.1111 x") == [("card", "4111.1111.1111.1111")]
    assert found("write bob [at] example.com") == [("email", "bob [at] example.com")]
    for clean in ("we met at noon. It rained", "in 2021-03-04 and 1999", "id 1234567890", "4111 1111 1111 1112", "", None):
        assert field.spans(clean)[1] == []


@pytest.fixture(scope="module")
def pieces():
    return lm.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_lattice_sums_all_segmentations(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for word in ("the", "reading", "naïve", "x", "日本", "qzxj", "ऄa"):
        chars = "▁" + word
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(chars) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(chars)]
            p = 0.0
            for a, z in itertools.pairwise(edges):
                s = chars[a:z]
                if s in known:
                    p += pieces.logp[known[s]]
                elif len(s) == 1:
                    p += sum(pieces.logp[pieces.byte[b]] for b in s.encode())
                else:
                    p = -math.inf
            total += math.exp(p)
        assert lm.marginals([word], pieces)[0][0] == pytest.approx(math.log10(total))


def test_expected_uses_and_long_words(pieces):
    words = ["reading", "the", "r"]
    uses = lm.expected(words, np.array([2.0, 3.0, 1.0]), pieces)
    assert uses.min() >= 0 and 6.0 <= uses.sum() <= 2 * 8 + 3 * 4 + 2
    assert np.isfinite(lm.marginals(["ab" * 5000, "z"], pieces)[0]).all()


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.PrefixEncoder(f.read())


def test_prefix_encoder_equals_the_library(encoder):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefinorstuABZ  '.,!?-09éßΣİñ日½\n\t\x1c\x85　") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 2000, "aab" * 700, "I'LL they've <|endoftext|><|startoftext|>x", "👩‍👩‍👧 ok", "é Å"]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = encoder.encode(t)
        assert ids == e.ids, t
        assert encoder.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def scalar_jpeg(blocks, width, height, dc, ac, restart=0):
    """A plain encoder of grey blocks (zigzag order) with given code tables: for each length, the symbols."""

    def codes(table):
        out, code = {}, 0
        for n, symbols in enumerate(table, 1):
            for s in symbols:
                out[s] = format(code, f"0{n}b")
                code += 1
            code <<= 1
        return out

    def value(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    dcc, acc, out, bits, last = codes(dc), codes(ac), b"", "", 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for k, block in enumerate(blocks):
        if restart and k and k % restart == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
            bits, last = "", 0
        n, b = value(int(block[0]) - last)
        last = int(block[0])
        bits += dcc[n] + b
        run = 0
        end = max([i for i in range(1, 64) if block[i]], default=0)
        for i in range(1, end + 1):
            if not block[i]:
                run += 1
                continue
            while run > 15:
                bits += acc[0xF0]
                run -= 16
            n, b = value(int(block[i]))
            bits += acc[run << 4 | n] + b
            run = 0
        if end < 63:
            bits += acc[0]
    out += flush(bits)
    table = lambda kind, t: bytes([kind]) + bytes(len(s) for s in t) + bytes(x for s in t for x in s)
    head = b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\0") + jpeg.segment(0xDB, b"\0" + bytes(range(1, 65)))
    head += jpeg.segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\0")
    head += jpeg.segment(0xC4, table(0, dc) + table(0x10, ac)) + (jpeg.segment(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    return head + jpeg.segment(0xDA, b"\x01\x01\0\0\x3f\0") + out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_decoder_reads_other_baseline_files(restart):
    rng = np.random.default_rng(3)
    blocks = np.zeros((12, 64), dtype=int)
    blocks[:, 0] = rng.integers(-500, 500, 12)
    for b in blocks:
        for i in rng.integers(1, 64, rng.integers(0, 9)):
            b[i] = rng.integers(-60, 60)
    dc = [[], [], list(range(6)), [6], [7], [8], [9], [10], [11]] + [[]] * 7
    symbols = [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 8)]
    ac = [[], [], [], [0], [0xF0]] + [[]] * 4 + [symbols[2:10]] + [[]] * 2 + [symbols[10:]] + [[]] * 3
    data = scalar_jpeg(blocks, 30, 22, dc, ac, restart)
    pic, coefs = jpeg.decode([data])[0]
    assert (pic.width, pic.height) == (30, 22) and (coefs[0] == blocks).all()
    thumb = jpeg.thumbnail(pic, coefs[0])
    assert thumb.shape == (3, 4) and (thumb == np.clip(np.rint(blocks[:, 0].reshape(3, 4) / 8 + 128), 0, 255)).all()
    assert len(jpeg.thumb_hash(thumb)) == 16


def test_media_round_trip_and_errors():
    rng = random.Random(2)
    payloads = [rng.randbytes(64 * n) for n in (1, 2, 7, 8192, 300)] + [b"\xff" * 640, bytes(64)]
    media = [jpeg.encode(p) for p in payloads]
    for p, got in zip(payloads, jpeg.decode(media), strict=True):
        assert jpeg.stored(got[0], got[1][0]) == p
    bad = [None, b"", b"no", media[0][:30], media[0].replace(b"\xff\xc0", b"\xff\xc2", 1), media[2][:-200]]
    assert all(isinstance(x, str) for x in jpeg.decode(bad))
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_shingle_hashes_and_prefixes():
    a, b = "One two  three\tfour five", "x one TWO three four"
    assert len(jaccard.shingles(a, 4)) == 2 and len(np.intersect1d(jaccard.shingles(a, 4), jaccard.shingles(b, 4))) == 1
    assert len(jaccard.shingles("a b", 4)) == 1 and len(jaccard.shingles(" \n", 4)) == 0
    assert not len(np.intersect1d(jaccard.shingles("a b c", 4), jaccard.shingles("a b c d", 4)))
    assert jaccard.needed(100, 85, 100) == 85 and jaccard.needed(7, 85, 100) == 6
    long = "word " * 200_000 + "end"
    assert len(jaccard.shingles(long, 4)) == 2


def test_tree_search_is_exact():
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(size=(700, 6)) * 256)
    points[:300] = points[0]
    order, nodes = topk.tree(points)
    points, ids = points[order], np.arange(700)[order]
    centres = np.array([points[a:z].mean(axis=0) for a, z, _, _ in nodes])
    radii = np.array([np.sqrt(((points[a:z] - c) ** 2).sum(axis=1)).max() for (a, z, _, _), c in zip(nodes, centres, strict=True)])
    shard = {"points": points, "ids": ids, "nodes": nodes, "centres": centres, "radii": radii}
    for q in rng.normal(size=(30, 6)) * 200:
        q = np.floor(q)
        want = sorted((-int(s), int(i)) for s, i in zip(points @ q, ids, strict=True))[:5]
        got = topk.search(q, 5, -np.inf, -1, shard)
        assert [(-s, i) for s, i in got] == want
        assert topk.search(q, 5, float(-want[2][0]), -1, shard)[:3] == got[:3]


def test_mixture_finds_both_languages():
    en, de = "the cat and the dog were in the garden of the house ", "der hund und die katze sind nicht in dem garten des hauses "
    table = np.full((2, 1 << language.BITS), language.SMOOTHING)
    for k, t in enumerate((de, en)):
        table[k] += np.bincount(language.trigrams(t * 20), minlength=1 << language.BITS)
    m = language.LanguageModel(("de", "en"), (table / table.sum(axis=1, keepdims=True)).astype(np.float32))
    assert m.infer(en)[0] == "en" and m.infer(en)[2] == ["en"]
    both = m.infer((en * 3 + de) * 3)
    assert both[0] == "en" and both[2] == ["en", "de"] and sum(both[3]) == pytest.approx(1, abs=1e-3)
    assert m.infer("12 34 !")[0] == "und" and m.infer(None)[:2] == ("und", 0.0) and m.infer("日本語")[0] in ("de", "en")


def test_classifier_learns_from_either_class_alone():
    assert toxicity.fit([("a", 0), ("b", 0)]).score("anything") < 0.01 and toxicity.fit([]).score(None) < 0.01
    model = toxicity.fit([("you vile thing " + "x" * k, 1) for k in range(20)] + [("you good thing " + "y" * k, 0) for k in range(40)])
    assert model.score("so vile") > 0.5 > model.score("so good") and 0 <= model.score(None) <= 1


def test_most_frequent_keeps_the_top_within_its_bound(spark):
    from tessera.llm.common import most_frequent

    counted = spark.createDataFrame([(f"w{k}", k) for k in range(200)], "word string, n long")
    for most in (0, 1, 7, 50, 199, 1000):
        kept = {r.n for r in most_frequent(counted, "n", most).collect()}
        assert len(kept) <= most and kept == set(range(200 - len(kept), 200))
    assert len(most_frequent(counted, "n", 1000).collect()) == 199


def test_broken_files_become_reasons(spark):
    from pyspark.sql import functions as F

    whole = jpeg.encode(bytes(range(64)) * 3)
    quant = whole.index(b"\xff\xdb")
    frame = whole.index(b"\xff\xc0")
    files = [
        whole,
        whole[:quant] + whole[quant + 69 :],  # no quantisation table
        whole.replace(b"payload 192", b"payload xxx", 1),
        whole.replace(b"payload 192", b"payload 999", 1),
        whole[: frame + 11] + b"\0" + whole[frame + 12 :],  # sampling factors 0
        whole[: frame + 5] + b"\0\0" + whole[frame + 7 :],  # no height
        whole[:-40], b"", None,
    ]
    got = [r["f"] for r in spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, media binary").coalesce(1).select("i", jpeg.features_column(F.col("media")).alias("f")).orderBy("i").collect()]
    assert got[0]["error"] is None and got[0]["payload_bytes"] == 192
    assert got[2]["error"] is None and got[2]["payload_bytes"] is None and got[2]["width"] == got[0]["width"]
    assert all(got[k]["error"] and got[k]["width"] is None for k in (1, 3, 4, 5, 6, 7, 8))


def test_segments_are_decoded_some_at_a_time(monkeypatch):
    payloads = [random.Random(k).randbytes(64 * n) for k, n in enumerate((1, 50, 7, 200))]
    monkeypatch.setattr(jpeg, "LANES", 16)
    for p, got in zip(payloads, jpeg.decode([jpeg.encode(p) for p in payloads]), strict=True):
        assert jpeg.stored(got[0], got[1][0]) == p


def test_toxicity_scores_equal_a_dense_recomputation():
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "vile", "rotten"]
    sample = [(" ".join(rng.choices(words[:4], k=9)) + (" vile rotten" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(90)]
    model = toxicity.fit(sample, 1 / 3)

    def dense(text):
        codes = [ord(c) for c in text.lower()]
        z, mask = model.bias, (1 << 32) - 1
        for n in toxicity.ORDERS:
            seen = set()
            for i in range(len(codes) - n + 1):
                h = codes[i]
                for c in codes[i + 1 : i + n]:
                    h = (h * 0x01000193 + c) & mask
                h = ((h + n) & mask) * 0x9E3779B1 & mask
                h ^= h >> 15
                seen.add((h * 0x85EBCA77 & mask) >> (32 - toxicity.BITS))
            z += sum(float(model.weights[k]) for k in seen)
        return 1 / (1 + math.exp(-z))

    for text in ("alpha vile beta", "gamma", "", "rotten rotten rotten"):
        assert model.score(text) == pytest.approx(dense(text), rel=1e-6)
    assert model.score("alpha vile rotten") > 0.5 > model.score("alpha beta gamma") and toxicity.fit([("a", 1)]).score("a") == 0.0


def test_mixture_equals_an_independent_expectation_maximisation():
    rng = np.random.default_rng(4)
    p = rng.random((3, 40)).astype(np.float64)
    p /= p.sum(axis=1, keepdims=True)
    count = rng.integers(1, 9, 40).astype(np.float64)
    share, like = language.mixture(p, count, np.full(3, 1 / 3))
    own = [1 / 3] * 3
    for _ in range(language.ROUNDS):
        new = [0.0] * 3
        for g in range(40):
            total = sum(own[k] * p[k, g] for k in range(3))
            for k in range(3):
                new[k] += count[g] * own[k] * p[k, g] / total
        own = [x / count.sum() for x in new]
    assert share == pytest.approx(own) and like == pytest.approx(sum(count[g] * math.log(sum(own[k] * p[k, g] for k in range(3))) for g in range(40)))


def test_multipliers_solve_each_source_as_bisection_does(spark):
    from tessera.llm import mixing

    rng = random.Random(2)
    hist = [(f"s{k}", size, rng.randint(1, 30)) for k in range(4) for size in rng.sample(range(1, 2000), 40)]
    words = {f"s{k}": sum(z * d for s, z, d in hist if s == f"s{k}") for k in range(4)}
    goal = {"s0": 0.2, "s1": 1.0, "s2": 2.5, "s3": 3.0}
    made = mixing.multipliers(spark.createDataFrame(hist, "key string, size long, docs long"), spark.createDataFrame([(k, w, goal[k] * w) for k, w in words.items()], "key string, words long, target double"))
    for r in made.collect():
        own = [(z, d) for s, z, d in hist if s == r["key"]]
        got = lambda lam: sum(z * d * min(3.0, math.exp(min(50.0, lam * z / r["scale"]))) for z, d in own)  # noqa: B023, E731
        if r["key"] == "s3":
            assert r["lam"] is None
            continue
        low, high = -1e3, 1e3
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if got(middle) < goal[r["key"]] * words[r["key"]] else (low, middle)
        assert got(r["lam"]) == pytest.approx(goal[r["key"]] * words[r["key"]], rel=1e-6) and r["lam"] == pytest.approx(low, rel=1e-4, abs=1e-4)
