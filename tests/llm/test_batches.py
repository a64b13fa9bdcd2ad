"""Results of encoding leave a worker a few texts at a time, and are those of whole texts."""

import public_tokenizers
import pyarrow as pa

from tessera.llm import bpe


def test_round_trips_are_handed_on_in_small_batches(spark):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = bpe.PrefixEncoder(f.read())
    texts = [("" if k % 9 == 0 else f"Text {k} of Über-größe, {k * 7919}") for k in range(700)]
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(700)), "text": texts})
    made = list(bpe.round_trips(enc, iter([whole]), "text"))
    assert max(b.num_rows for b in made) <= bpe.TEXTS and len(made) > 2
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in rows] == [(k, len(enc.encode(t)), enc.encode(t), enc.decode(enc.encode(t))) for k, t in enumerate(texts)]
    vocab = bpe.vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(0, None, "s"), (1, texts[1], None)], "doc_id int, text string, source string")
    got = {r.doc_id: (r.source, r.n_tokens, r.ids, r.decoded) for r in bpe.round_trip(df, vocab).collect()}
    assert got == {0: ("s", 0, [], ""), 1: (None, len(enc.encode(texts[1])), enc.encode(texts[1]), enc.decode(enc.encode(texts[1])))}


def test_new_chunks_are_encoded_as_one_text():
    import random

    from tokenizers import Tokenizer

    from tessera.llm import token_files

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    rng, tok = random.Random(5), Tokenizer.from_str(spec)
    alphabet = ["a", "the", "É", "ß", "7", "'s", ".", "\n", "\t", " ", "  ", "　", "漢", "🙂", "***", "<", "|>", "<|endoftext|>", "\r\n", "x" * 70]
    texts = ["", " ", "a ", *[" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 30))) for _ in range(400)]]
    encoder, asked = token_files.ChunkEncoder(spec, 2), []
    library = encoder.tok.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, some, **kw):
            asked.append(len(some))
            return library(some, **kw)

    encoder.tok = Counted()
    got = encoder.encode(texts)
    want = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert [list(memoryview(g).cast({2: "H", 4: "I"}[encoder.width])) for g in got] == [[*w, 2] for w in want]
    assert sum(asked) < len(texts) + len(encoder.known) / 50


def test_redacted_rows_leave_a_worker_in_small_batches(spark):
    from tessera.llm import pii

    field = pii.fit([])
    texts = [None if k % 11 == 0 else f"Write to user{k}@example.org or +49 170 12345{k:02d} now, {k}" for k in range(600)]
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": texts, "source": [None if k % 2 else "s" for k in range(600)]})
    made = list(pii.redacted_batches(field, iter([whole]), "text"))
    assert max(b.num_rows for b in made) <= pii.TEXTS and len(made) > 2
    want = [pii.redact(t, [s for some in field.spans(t) for s in some]) for t in texts]
    assert want[0] is None and "[EMAIL]" in want[1] and "[PHONE]" in want[1]
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["doc_id"], r["text"], r["source"]) for r in rows] == [(k, w, None if k % 2 else "s") for k, w in enumerate(want)]
    df = spark.createDataFrame([(k, texts[k], "s") for k in range(12)], "doc_id long, text string, source string")
    out = pii.redacted_rows(df, field)
    assert out.schema == df.schema and {r.doc_id: r.text for r in out.collect()} == dict(enumerate(want[:12]))


def test_an_encoder_is_small(monkeypatch):
    """What an encoder of 49,406 tokens holds for merging: chains in arrays and one number a merge, not a list of parts a token."""
    import sys

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = bpe.PrefixEncoder(f.read())
    seen: set[int] = set()

    def held(x) -> int:
        if id(x) in seen:
            return 0
        seen.add(id(x))
        inner = [*x, *x.values()] if isinstance(x, dict) else x if isinstance(x, (list, tuple, set)) else ()
        return sys.getsizeof(x) + sum(map(held, inner))

    apart = {"automaton", "table", "cache", "pieces", "fits"}
    assert sum(held(v) for k, v in vars(enc).items() if k not in apart) < 12_000_000
    given = []
    monkeypatch.setattr(bpe, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a"]})
    assert len(list(bpe.round_trips(enc, iter([batch, batch]), "text"))) == len(given) == 2
