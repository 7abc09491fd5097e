import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oncekeep.llm import packing

from .helpers import DOCS, awkward_docs, prose

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(30))
def test_rounds_are_best_fit_document_by_document(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 16, 64, 1024])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 400))]
    placed, ranks = defaultdict(list), Counter()
    for length, rank, n, first, each, offset in packing.best_fit_rounds(Counter(lengths), capacity):
        for j in range(n):
            placed[first + j // each].append((offset + j % each * length, length))
            ranks[length, rank + j] += 1
    assert len(ranks) == len(lengths) and set(ranks.values()) <= {1}
    for rows in placed.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        insort(gaps, gap - length)
    assert len(placed) == opened


def test_encoder_equals_tokenizer():
    tokenizer, encode = Tokenizer.from_file(FILE), packing.encoder(FILE)
    odd = ["", " ", "  ", "a  b\n c   d ", "\n \n", "it's  he'll\t x", "a<|endoftext|> b <|endoftext|>c", "x\u00a0 y \u3000z", "日本 語", "1 2 33", "\u200b a \u180e b"]
    for text in [*odd, *(t for _, t, *_ in awkward_docs() if t), prose(9, 500)]:
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_pieces_and_places(spark):
    rows = awkward_docs()
    tokenizer = Tokenizer.from_file(FILE)
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), FILE).collect()
    assert Counter(tuple(r[:5]) for r in got) == expected
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for rows_ in places.values():
        at = 0
        for offset, length in sorted(rows_):
            assert offset == at
            at += length
        assert at <= 1024


def test_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = packing.tokenize(docs, FILE, with_ids=True).first()
    assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length
    assert packing.pack_documents(spark.createDataFrame([], DOCS), FILE).count() == 0


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000)], "id long, length long"), ["id"])
