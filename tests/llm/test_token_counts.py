import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oncekeep.llm import token_counts as tc

from .helpers import DOCS, awkward_docs

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "don't we'll THEY'RE 'tis ''s", "café e ́x", "İstanbul ΣΑΣ ß", "x\u0085y z ",
    "1²½٣", "ªº µ×÷", "a\x00b\x1cc\x7f", "日本語 🎉🎉", "w" * 500, "가", "!" * 40 + "'s",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(library):
    count = tc.PreTokens(FILE).counter({})
    r = random.Random(5)
    alphabet = "ab'sStTreREvé É ß́İΣσς \u0085\x1c\x0b\x00<|>1²½٣ﬁ　日🎉.,!-\n\t×÷ªµ"
    texts = ODD + [t or "" for _, t, *_ in awkward_docs()] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    assert [count(t) for t in texts] == [library(t) for t in texts]


def test_other_files_are_left_to_the_library():
    other = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, counter = Tokenizer.from_file(other), tc.PreTokens(other)
    assert not counter.plain
    assert [counter.counter({})(t) for t in ODD] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in ODD]


@pytest.mark.parametrize("table", [0, 5, 65_536])
def test_documents(spark, library, table):
    rows = awkward_docs() + [(100 + i, t, None, None, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    frequent = tc.frequent_lengths(docs, FILE, table=table) if table else ("", b"")
    assert len(frequent[1]) <= table
    got = tc.count_tokens(docs, FILE, frequent, limit=100).collect()
    want = [(i, len((t or "").encode()), library(t or "")) for i, t, *_ in rows]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_full_memo_and_empty_tables(spark, monkeypatch, library):
    monkeypatch.setattr(tc, "MEMO", 3)
    count = tc.PreTokens(FILE).counter({})
    text = "alpha beta gamma delta epsilon alpha beta"
    assert count(text) == count(text) == library(text)
    assert tc.count_tokens(spark.createDataFrame([], DOCS), FILE).collect() == []
