import random
import re
import zlib
from collections import Counter

import pytest

from oncekeep.llm import spelling

from .helpers import DOCS, awkward_docs

WORDS = "word string, n long"


def is_near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_words(rows):
    out = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if v != w and is_near(v, w)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def some_words(seed, n, alphabet="abc", low=6, high=9):
    r = random.Random(seed)
    return {"".join(r.choice(alphabet) for _ in range(r.randint(low, high))): r.choice([5, 5, 6, 30, 150, 800, 5000]) for _ in range(n)}


def as_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("size", [5_000, 40, 3])
def test_variants_equal_all_pairs(spark, size):
    words = some_words(size, 700) | some_words(size + 1, 60, "abé×ÿ", 6, 12)
    got = spelling.variants(spark.createDataFrame(list(words.items()), WORDS), group_words=size)
    assert as_rows(got) == plain_variants(words)


def test_one_prefix_holds_all_words(spark):
    """Halving the span ends at groups that agree but for one place."""
    words = {"commonprefix" + w: n for w, n in some_words(9, 500, "abcd", 3, 5).items()} | {"x" * 3000: 5, "x" * 3001: 90, "x" * 2999 + "y": 5}
    got = spelling.variants(spark.createDataFrame(list(words.items()), WORDS), group_words=10)
    assert as_rows(got) == plain_variants(words)
    cells = spelling._cells(spark.createDataFrame(list(words.items()), WORDS), 6, 10)
    sizes = cells.groupBy(*spelling.KEY).count().collect()
    assert all(r["count"] <= 10 or r.hi - r.lo == 1 for r in sizes)


def test_ties_take_the_smallest_word(spark):
    words = {"planet": 5, "planeta": 25, "planetb": 25, "plant": 25, "planets": 5}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(words.items()), WORDS)).collect()}
    assert (got["planet"].form, got["planet"].n_near, got["planet"].form_n, got["planeta"].form) == ("planeta", 3, 25, None)


def test_whole_texts(spark):
    docs = awkward_docs()
    docs += [(i, "Kitchen kitchen kitchens Kitchén KITCHEN café́s naïveté ÀÿÀÿÀÿÿ Ābcdefgh " * 3, None, None, 0) for i in range(400)]
    got = spelling.spelling_variants(spark.createDataFrame(docs, DOCS).repartition(3))
    want = plain_variants(plain_words(docs))
    assert as_rows(got) == want and any(form for _, form, *_ in want)


def test_empty_tables(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, None, None, None), (None, "", "", "", 0)], DOCS)).collect() == []


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor()
    acceptor.add(sorted(["tap", "top", "map", "mop"]))
    # the end, before p, before ap or op, the start
    assert len(acceptor.arcs) == 4
