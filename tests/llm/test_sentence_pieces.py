import random

import public_tokenizers
import pytest
import sentencepiece

from oncekeep.llm import sentence_pieces as sp

from .helpers import DOCS, awkward_docs

FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "  a  b\n\n c ", "▁x▁▁y", "ﬁ Ⅳ\u3000x\x00y", "hello world " * 50, "日本語のテキスト 🎉🎉 mixed", "    def f(x):\n        return x\t# hi\n",
    "a" * 40, "1234567890 3.14159", "Ünïcödé Straße", "\n", "mississippi banana bandana", "           ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def test_ids_equal_the_library(library):
    encode, decode = sp.batch_encoder(FILE), sp.decoder(FILE)
    texts = [t or "" for _, t, *_ in awkward_docs()] + ODD
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert decode(ids) == library.decode(ids.tolist())
        assert decode(ids) == text.replace("▁", " ")


def test_random_words_equal_the_library(library):
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 12))) for _ in range(2000)]
    assert [x.tolist() for x in sp.batch_encoder(FILE)(words)] == [library.encode(w) for w in words]


def test_unigram_has_the_best_sum():
    viterbi = sp.SharedPrefixViterbi(sp.Pieces(FILE), "unigram")
    scores, worst = viterbi.pieces.scores, viterbi.pieces.least - sp.UNKNOWN_PENALTY

    def best(word):
        if not word:
            return 0.0
        return max(best(word[:i]) + scores.get(word[i:], worst if i == len(word) - 1 else -1e18) for i in range(len(word)))

    words = sorted({"▁hello", "▁help", "▁he", "▁hex", "zzz", "▁banana", "▁band", "語▁"})
    for word, parts in viterbi.segment(words):
        assert "".join(parts) == word and sum(scores.get(p, worst) for p in parts) == best(word)


def test_documents(spark, library):
    rows = awkward_docs()
    got = sp.encode_and_decode(spark.createDataFrame(rows, DOCS), FILE).collect()
    assert sorted(map(str, (tuple(r.ids) for r in got))) == sorted(str(tuple(library.encode(t or ""))) for _, t, *_ in rows)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert sp.encode_and_decode(spark.createDataFrame([], DOCS), FILE).count() == 0


def test_decoding_of_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in sp.decode_documents(rows, FILE).orderBy("doc_id").collect()] == [None, ""]


def test_forgotten_words_come_back_the_same(library, monkeypatch):
    """Generations far smaller than a batch, so that words are forgotten, taken over and worked out again."""
    monkeypatch.setattr(sp, "MEMO", 40)
    r = random.Random(5)
    words = ["".join(r.choice("etaoin") for _ in range(r.randint(1, 6))) for _ in range(60)]
    encode = sp.BatchEncoder(FILE, "bpe")
    for _ in range(30):
        texts = [" ".join(r.choices(words, k=r.randint(0, 25))) for _ in range(3)]
        assert [x.tolist() for x in encode(texts)] == [library.encode(t) for t in texts]
