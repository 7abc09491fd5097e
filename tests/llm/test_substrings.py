import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oncekeep.llm import substring_arrays as arrays
from oncekeep.llm import substring_automata as automata
from oncekeep.llm import winnow

from .helpers import DOCS, awkward_docs, prose


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_and_prefixes(seed):
    r = random.Random(seed)
    x = [r.randint(0, r.choice([1, 2, 5, 200])) for _ in range(r.randint(1, 90))]
    if seed % 3 == 0:
        x = x * 3
    sa = arrays.suffix_array(np.array(x)).tolist()
    assert sa == sorted(range(len(x)), key=lambda i: x[i:])
    shared = arrays.permuted_prefixes(np.array(x, dtype=np.uint16), np.array(sa), 20)
    for a, b in zip(sa, sa[1:], strict=False):
        n = next((k for k in range(20) if x[a + k : a + k + 1] != x[b + k : b + k + 1] or a + k >= len(x)), 20)
        assert shared[b] == n


@pytest.mark.parametrize("seed", range(40))
def test_shard_flags(seed, monkeypatch):
    r = random.Random(seed)
    contents = [bytes(r.choice(b"ab") for _ in range(r.randint(3, 14))) for _ in range(7)]
    counts, groups, seen = np.array([len(c) - 2 for c in contents]), np.zeros(7, int), set()
    for c, flags in zip(contents, arrays.repeated_windows(contents, groups, counts, 3), strict=True):
        for i, flag in enumerate(flags):
            assert flag == (c[i : i + 3] in seen)
            seen.add(c[i : i + 3])
    monkeypatch.setattr(automata, "SHARD_WORDS", r.choice([4, 20, 1000]))
    every = Counter(c[i : i + 3] for c in contents for i in range(len(c) - 2))
    words = [b" ".join(bytes([b]) for b in c) for c in contents]
    for c, flags in zip(contents, automata.repeated_windows(words, groups, counts, 3), strict=True):
        assert [bool(f) for f in flags] == [every[c[i : i + 3]] > 1 for i in range(len(c) - 2)]


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(1)
    part = r.integers(0, 256, 300, dtype=np.uint8)
    shape = winnow.Windows(100, 24)

    def anchored(data):
        values = (winnow.byte_values(data, 0), winnow.byte_values(data, 1))
        anchor, _, first, count, lead = winnow.runs(values, np.array([len(data)]), shape)
        return {int(f) + k: (int(a), int(lead_) - k) for a, f, n, lead_ in zip(anchor, first, count, lead, strict=True) for k in range(n)}

    one = anchored(part)
    two = anchored(np.concatenate([r.integers(0, 256, 57, dtype=np.uint8), part]))
    assert set(one) == set(range(201)) and all(one[i] == two[i + 57] for i in one)


def docs_with_passages():
    rows = awkward_docs()
    line, long_ = "a common line of words that is shorter than any window but stands everywhere in the table", prose(50, 200)
    for k in range(60):
        words = long_.split()
        words[3 * k % 190] = f"edit{k}"
        rows.append((200 + k, f"{prose(60 + k, 30)} {line}\n{' '.join(words[k : k + 120])} {line} {prose(160 + k, 25)}", "en", "s", 1))
    rows.append((300, "tick tock " * 400, "en", "s", 1))
    return rows


def plain_words(rows, window):
    texts = [(t or "").encode().split() for _, t, *_ in rows]
    every = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    for row, w in zip(rows, texts, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if every[tuple(w[i : i + window])] > 1 for k in range(window)}
        yield row[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def test_passages_equal_brute_force(spark, monkeypatch):
    rows = docs_with_passages()
    monkeypatch.setattr(automata, "SHARD_BYTES", 5_000)
    frame = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({"n_words": F.lit("clash"), "row": F.lit(1), "runs": F.lit("x")})
    path = f"{spark.conf.get('spark.checkpoint.dir')}/passages"
    frame.write.mode("overwrite").parquet(path)
    got = automata.remove_repeated_passages(spark.read.parquet(path)).collect()
    words = [(r.doc_id, r.n_words, r.n_removed, b" ".join((r.text or "").encode().split()).decode()) for r in got]
    assert sorted(words, key=str) == sorted(plain_words(rows, 35), key=str)
    assert all(r.text is None for r in got if r.n_chars == 0 and r.doc_id == 0)
    originals = Counter(t for _, t, *_ in rows)
    assert all(originals[r.text] for r in got if not r.n_removed)


def plain_bytes(rows, window):
    seen, order = set(), sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    for k in order:
        data = (rows[k][1] or "").encode()
        gone = np.zeros(len(data) + 1, dtype=int)
        for i in range(len(data) - window + 1):
            if data[i : i + window] in seen:
                gone[i] += 1
                gone[i + window] -= 1
            seen.add(data[i : i + window])
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        yield rows[k][0], len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()


def test_bytes_equal_brute_force(spark):
    rows = docs_with_passages()
    # Rows of one id count in the order of the table, so the table is kept in one piece here.
    frame = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = arrays.remove_repeated_bytes(frame).withColumn("sha", F.sha2("kept", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "sha")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(plain_bytes(rows, 100), key=str)


def test_long_documents_are_taken_in_pieces(spark, monkeypatch):
    text = prose(8, 1500)
    rows = [(1, text, "en", "s", 1), (2, f"{prose(9, 50)} {text[2000:6000]} {text[100:3000]}", "en", "s", 1)]
    for module in (winnow, automata, arrays):
        monkeypatch.setattr(module, "CHUNK", 700)
    words = [w.encode() for w in text.split()]
    one, two = automata.word_values(text.encode())
    assert len(one) == len(words) == len(two) and len(set(one.tolist())) == len(set(words))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert automata.remove_repeated_passages(empty).count() == 0 and arrays.remove_repeated_bytes(empty).count() == 0
