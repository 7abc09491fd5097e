"""Near copies against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

import corpus_pipeline
from oncekeep.llm import near_copies, pipeline, simhash

from .helpers import DOCS, awkward_docs, components, prose

NEAR = dict(corpus_pipeline.STAGES)["simhash_dedup"]


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(texts):
    sets = [plain_set(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return sum(root == i for i, root in enumerate(components(len(sets), linked)))


def edited(seed, family, words, edits):
    r, out = random.Random(seed), prose(family, words).split()
    for k in r.sample(range(words), edits):
        out[k] = f"new{seed}"
    return " ".join(out)


@pytest.mark.parametrize("listed", [near_copies.LISTED, 0])
def test_groups_equal_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(near_copies, "LISTED", listed)
    texts = [r[1] for r in awkward_docs()] + [edited(k, k % 5, 150, k % 7) for k in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = [r.text for r in NEAR(spark, docs, "").collect()]
    assert len(kept) == plain_kept(texts)
    assert plain_kept(kept) == len(kept)


def test_sketches_differ_in_no_more_bits_than_sets():
    r = random.Random(1)
    for n in (0, 1, 40, 500, 5000):
        one = {r.getrandbits(64) for _ in range(n)}
        for edits in (0, 1, n // 10, n):
            two = set(list(one)[edits:]) | {r.getrandbits(64) for _ in range(edits)}
            a, b = (near_copies.parity_sketch(np.array(sorted(x), dtype=np.uint64)) for x in (one, two))
            apart = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
            assert apart <= len(one ^ two) and (len(one ^ two) + apart) % 2 == 0


def test_close_fingerprints_alone_drop_nothing(spark):
    """Two texts at a similarity of about 0.65 whose fingerprints lie within the radius; both stay."""
    for seed in range(1000, 2000):
        one, two = prose(3, 150), edited(seed, 3, 150, 7)
        a, b = plain_set(one), plain_set(two)
        if len(a & b) < 0.7 * len(a | b) and (simhash.fingerprint_of(one, 5) ^ simhash.fingerprint_of(two, 5)).bit_count() <= pipeline.hamming_radius(0.8):
            break
    else:
        raise AssertionError("no such pair")
    docs = spark.createDataFrame([(1, one, "en", "s", 1), (2, two, "en", "s", 1)], DOCS)
    assert NEAR(spark, docs, "").count() == 2


def test_stage_groups_fingerprints_first(spark, monkeypatch):
    found, groups = [], near_copies.simhash_groups

    def watched(*args, **kwargs):
        out = groups(*args, **kwargs)
        found.append(out.filter("id != component_id").count())
        return out

    monkeypatch.setattr(near_copies, "simhash_groups", watched)
    texts = [prose(k, 400) + (f" end{k}" if again else "") for k in range(6) for again in (0, 1)]
    kept = NEAR(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS), "").count()
    assert kept == plain_kept(texts) == 6 and len(found) == 1 and found[0] >= 4


def test_later_rounds_leave_settled_shingles_alone(spark, monkeypatch):
    """Pairs below the bound share prefix shingles and never link; once listed, only shingles with many pairs are looked at again."""
    monkeypatch.setattr(near_copies, "LISTED", 1)
    seen, store = [], near_copies.written

    def watched(df, label):
        out = store(df, label)
        if label == "open-keys":
            seen.append({(r.key, r.id) for r in out.collect()})
        return out

    monkeypatch.setattr(near_copies, "written", watched)
    apart = [edited(1000 * k + again, 50 + k, 100, 3 * again) for k in range(30) for again in (0, 1)]
    crowd = [edited(9000 + k, 7, 300, 5) for k in range(60)]
    texts = [*apart, *crowd]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert NEAR(spark, docs, "").count() == plain_kept(texts)
    assert len(seen) >= 2 and all(later <= earlier for earlier, later in zip(seen, seen[1:], strict=False))
    of = {key: len([1 for k, _ in seen[0] if k == key]) for key, _ in seen[0]}
    assert min(of[key] for key, _ in seen[1]) > 2 >= min(of.values())


def test_pruned_rows_have_no_partner():
    """Every pair that sizes and places leave room for keeps both rows, whatever the bound."""
    p, q = 4, 5
    for n, m in ((10, 10), (10, 12), (20, 17), (9, 11)):
        for a in range(n):
            for b in range(m):
                possible = (1 + min(n - a - 1, m - b - 1)) * (p + q) >= p * (n + m)
                short_a, short_b = a * (p + q) <= n * (q - p), b * (p + q) <= m * (q - p)
                if possible:
                    assert (short_a or m <= n) and (short_b or n <= m) and (short_a or short_b)


def test_keys_with_the_same_rows_are_one(spark, monkeypatch):
    """Near copies share many prefix shingles; they meet once for each set of rows that share some."""
    seen, store = [], near_copies.written

    def watched(df, label):
        out = store(df, label)
        if label == "prefix-keys":
            keys = {}
            for row in out.collect():
                keys.setdefault(row.key, set()).add(row.id)
            seen.extend(frozenset(ids) for ids in keys.values())
        return out

    monkeypatch.setattr(near_copies, "written", watched)
    texts = [edited(100 * k + again, 20 + k, 200, 4 * again) for k in range(20) for again in range(2 + k % 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert NEAR(spark, docs, "").count() == plain_kept(texts)
    assert len(seen) >= 20 and len(seen) == len(set(seen))


@pytest.mark.parametrize("listed", [near_copies.LISTED, 0])
def test_pairs_are_listed_only_where_sketches_allow(spark, monkeypatch, listed):
    """Texts that share their first shingles and little else meet at one key; none of their pairs becomes a row."""
    monkeypatch.setattr(near_copies, "LISTED", listed)
    seen, close = [], near_copies._verified

    def watched(pairs, *rest):
        pairs = pairs.distinct()
        seen.append(pairs.count())
        return close(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", watched)
    # Sorting puts shared shingles last, so all texts of a family agree on no rare shingle but a few drawn ones.
    texts = [" ".join([prose(3, 200), prose(500 + k, 120)]) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    monkeypatch.setattr(near_copies, "_frequent", lambda *_: (np.array([], dtype=np.uint64), np.array([], dtype=np.int64)))
    assert NEAR(spark, docs, "").count() == plain_kept(texts) == 40
    assert sum(seen) < 40
