import random

import numpy as np
import pytest
import xxhash

from oncekeep.llm import simhash
from oncekeep.llm.components import connected

from .helpers import DOCS, awkward_docs, components, prose


def plain_fingerprint(text, shingle):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("shingle", "bits"), [(3, 2), (5, 10)])
def test_groups_equal_brute_force(spark, shingle, bits):
    rows = [r for r in awkward_docs() if r[0] is not None]
    for k in range(40):
        words = prose(k % 6, 150).split()
        words[k] = "changed"
        rows.append((100 + k, " ".join(words), "en", "s", 1))
    got = simhash.simhash_groups(spark.createDataFrame(rows, DOCS), shingle, bits).collect()
    fps = [plain_fingerprint(r[1], shingle) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    root = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[order[a]] ^ fps[order[b]]).bit_count() <= bits])
    expected = sorted((rows[k][0], fps[k], rows[order[root[n]]][0]) for n, k in enumerate(order))
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == expected


def test_random_fingerprints_and_hot_keys(spark, monkeypatch):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(300)}
    for f in list(fps):
        fps.add(f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    fps |= {(7 << 40) | r.getrandbits(12) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits in (0, 1, 2, 3, 7):
        want = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= bits])
        groups = {}
        for i, root in enumerate(want):
            groups.setdefault(root, set()).add(signed[i])
        for block in (simhash.BLOCK, 50):
            monkeypatch.setattr(simhash, "BLOCK", block)
            found = connected(simhash.links(frame, len(fps), bits)).collect()
            got = {}
            for x in found:
                got.setdefault(x.component, set()).add(x.node)
            assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_plan_hands_out_all_units():
    fps = np.random.default_rng(2).integers(0, 2**64, 500, dtype=np.uint64)
    for bits in (0, 2, 5):
        for n in (10**3, 10**6, 10**10):
            parts = simhash.plan_parts(fps, n, bits)
            assert sum(p.threshold + 1 for p in parts) == bits + 1
            used = [b for p in parts for b in p.bits]
            assert len(used) == len(set(used))


def test_correlated_bits_share_a_group():
    r = np.random.default_rng(3)
    x = r.integers(0, 2, (800, 64), dtype=np.uint8)
    for b in (10, 20, 30):
        x[:, b] = x[:, 0]
    groups = simhash.bit_groups(np.packbits(x, axis=1, bitorder="little").view("<u8").reshape(-1), 4)
    assert any({0, 10, 20, 30} <= set(g) for g in groups) and sorted(b for g in groups for b in g) == list(range(64))


def test_empty_and_single(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    one = simhash.simhash_groups(spark.createDataFrame([(7, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.fp, r.component_id) for r in one] == [(7, 0, 7)]


def test_components_of_a_path_a_star_and_noise(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(5, 5), (None, 3), (7, None), (1, 0)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}
