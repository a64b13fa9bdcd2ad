"""Every stage of the corpus pipeline on its own input, and the whole."""

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_queries import BAD_WORDS, brute_components, key, plain_spans

NAMES = [n for n, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def steps(spark, table_dir, tmp_path_factory):
    """(input rows, output rows) of each stage."""
    docs, out = spark.read.parquet(f"{table_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        where = str(tmp_path_factory.mktemp(name)) + "/rows"
        stage(spark, docs, table_dir).write.parquet(where)
        made = spark.read.parquet(where)
        out[name] = (docs.collect(), made.collect(), docs.columns, made.columns)
        docs = made
    return out


def test_order_and_columns(steps):
    assert NAMES == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "bpe"]
    for n in NAMES[:-1]:
        assert steps[n][2] == steps[n][3]


def test_toxic_documents_go(steps):
    before, after, *_ = steps["toxicity"]
    bad = lambda r: any(w in (r.text or "") for w in BAD_WORDS)
    assert not any(bad(r) for r in after)
    assert sorted((key(r[:2]) for r in after)) == sorted(key(r[:2]) for r in before if not bad(r))


def test_one_of_each_group_stays(steps):
    before, after, *_ = steps["ngram_jaccard_join"]
    comps = brute_components([tuple(r) for r in before], 5, 80, 100)
    groups = {label for _, n, _, label in comps if n}
    assert len(after) == len(groups) + sum(1 for _, n, _, _ in comps if not n)
    text_of = {}
    for r, (_, n, _, label) in zip(before, comps, strict=True):
        if n:
            text_of.setdefault(r.text, label)
    assert sorted(text_of[r.text] for r in after if r.text in text_of) == sorted(groups)


def test_personal_data_is_replaced(steps):
    before, after, *_ = steps["pii"]
    assert len(before) == len(after)
    assert all(not plain_spans(r.text or "") for r in after)
    clean = {r.text for r in before if not any(c.isdigit() or c == "@" for c in r.text or "")}
    assert clean <= {r.text for r in after}


def test_copies(steps):
    before, after, *_ = steps["mixing"]
    have = Counter((r.doc_id, r.text) for r in after)
    given = Counter((r.doc_id, r.text) for r in before)
    assert set(have) <= set(given) and all(n <= 3 * given[k] for k, n in have.items())


def test_ids(steps):
    before, after, *_ = steps["bpe"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in before]
    assert sorted(((r.doc_id, tuple(r.ids)) for r in after), key=lambda x: (key(x[:1]), x[1])) == sorted(want, key=lambda x: (key(x[:1]), x[1]))
    assert all(r.n_tokens == len(r.ids) and r.decoded == tok.decode(r.ids, skip_special_tokens=False) for r in after)


def test_whole_and_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
