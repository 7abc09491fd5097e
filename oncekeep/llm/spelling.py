"""Spelling variants by finite-state composition: vocabulary, one edit, vocabulary.

The minimised acceptor of the words is composed with a transducer that makes exactly one edit and
with the acceptor again; every accepted path is a pair of near words. The work is split by the
initial state: by what both words of a pair have read before the edit and what they still read
after it. So a task composes only the small acceptor between these two.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach
from .common import text_of, written

# The contract's runs, least length and occurrences, the noise, the share of a form.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, DROP_EVERY, TIMES = 6, 5, 199, 5
# The same runs on lower-cased UTF-8 bytes: U+00C0 to U+00FF are C3 and one byte.
ASCII_RUN = re.compile(rb"[a-z]+")
WIDE_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
# Words that a task holds before it passes its counts on.
MEMO = 300_000
# A group of more words is split at the middle of its span of edits.
GROUP_WORDS = 5_000
KEY = ["m", "lo", "hi", "prefix", "suffix"]


# -- words -----------------------------------------------------------------------------------


def noisy_words(docs: DataFrame, drop_every: int = DROP_EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the distinct results of the runs of letters of every whole text.

    A run is lower-cased in A-Z only. With h the CRC-32 of ``<doc_id>:<run>``, a run loses its code
    point h % length if ``drop_every`` divides h. A null text has no runs; a null id counts as an
    empty one. Tasks count before they shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, text in zip(ids, texts, strict=True):
                data = text.as_buffer().to_pybytes().lower()
                start = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter((ASCII_RUN if data.isascii() else WIDE_RUN).findall(data)).items():
                    if len(run) < least_length:
                        continue
                    h = zlib.crc32(run, start)
                    if h % drop_every == 0:
                        letters = run.decode()
                        at = h % len(letters)
                        run = (letters[:at] + letters[at + 1 :]).encode()
                    found[run] += n
                if len(found) > MEMO:
                    yield out(found)
                    found.clear()
        yield out(found)

    def out(found: Counter[bytes]) -> pa.RecordBatch:
        words = pa.array(list(found), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_of().alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").filter(F.char_length("word") >= least_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# -- acceptor and composition ------------------------------------------------------------------


class Acceptor:
    """Minimised acceptors of word lists in one register, so equal right languages are one state.

    ``arcs[q]`` lists (symbol, next state, rank): the rank counts the words that branch off before,
    so the ranks along a path add up to the word's place in the sorted list.
    """

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.arcs: list[list[tuple[str, int, int]]] = [[]]
        self.size = [1]

    def add(self, words: list[str]) -> int:
        """Initial state of sorted distinct words, all of one length."""
        open_arcs: list[list[tuple[str, int]]] = [[] for _ in range(len(words[0]) + 1)]
        previous = words[0]
        for word in words[1:]:
            shared = 0
            while word[shared] == previous[shared]:
                shared += 1
            self._close(open_arcs, previous, shared)
            previous = word
        return self._close(open_arcs, previous, -1)

    def _close(self, open_arcs: list[list[tuple[str, int]]], word: str, down_to: int) -> int:
        state = 0
        for depth in range(len(word), down_to, -1):
            if depth < len(word):
                state = self._state(open_arcs[depth])
                open_arcs[depth] = []
            if depth:
                open_arcs[depth - 1].append((word[depth - 1], state))
        return state

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.arcs)
            ranked, rank = [], 0
            for symbol, after in arcs:
                ranked.append((symbol, after, rank))
                rank += self.size[after]
            self.arcs.append(ranked)
            self.size.append(rank)
        return state


class OneEdit:
    """The composition of acceptor, one edit and acceptor; results are pairs of ranks.

    Before the edit both sides read the same symbols; the edit stands at the first place where the
    words differ, so each pair has one path; after it both read the same again. Composed states are
    met once and their pairs kept. Words have one length a side, so a state fixes its depth.
    """

    def __init__(self, acceptor: Acceptor) -> None:
        self.arcs, self.size = acceptor.arcs, acceptor.size
        self.met: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.changed: dict[int, list[tuple[int, int]]] = {}
        self.dropped: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def meet(self, p: int, q: int) -> list[tuple[int, int]]:
        """Both sides read the same to the end."""
        if p == q:
            return [(i, i) for i in range(self.size[p])]
        known = self.met.get((p, q))
        if known is None:
            known = self.met[p, q] = self._meet(p, q, None)
        return known

    def _meet(self, p: int, q: int, but: str | None) -> list[tuple[int, int]]:
        if not self.arcs[p]:
            return [(0, 0)]
        right = {c: (state, rank) for c, state, rank in self.arcs[q]}
        out = []
        for c, state, rank in self.arcs[p]:
            if c in right and c != but:
                other, shift = right[c]
                out += [(x + rank, y + shift) for x, y in self.meet(state, other)]
        return out

    def replaced(self, p: int, places: int) -> list[tuple[int, int]]:
        """Pairs that differ in one symbol, at one of the next ``places``."""
        if places <= 0 or self.size[p] < 2:
            return []
        known = self.changed.get(p)
        if known is None:
            known, arcs = [], self.arcs[p]
            for i, (_, state, rank) in enumerate(arcs):
                for _, other, shift in arcs[i + 1 :]:
                    known += [(x + rank, y + shift) for x, y in self.meet(state, other)]
                known += [(x + rank, y + rank) for x, y in self.replaced(state, places - 1)]
            self.changed[p] = known
        return known

    def deleted(self, p: int, q: int, places: int) -> list[tuple[int, int]]:
        """Pairs of a longer word and the same without one symbol, at one of the next ``places``."""
        if places <= 0:
            return []
        known = self.dropped.get((p, q))
        if known is None:
            known, right = [], {c: (state, rank) for c, state, rank in self.arcs[q]}
            for c, state, rank in self.arcs[p]:
                # The next symbol differs from the deleted one: else the words differ further on.
                known += [(x + rank, y) for x, y in self._meet(state, q, c)]
                if c in right:
                    other, shift = right[c]
                    known += [(x + rank, y + shift) for x, y in self.deleted(state, other, places - 1)]
            self.dropped[p, q] = known
        return known


def near_in_group(words: list[str], low: int, places: int) -> Iterator[tuple[int, int]]:
    """Index pairs of distinct words of ``low`` symbols and of one more; the longer ones don't pair among themselves."""
    order = sorted(range(len(words)), key=words.__getitem__)
    short, long = [i for i in order if len(words[i]) == low], [i for i in order if len(words[i]) > low]
    if not short:
        return
    deep = 4 * low + 1000
    if sys.getrecursionlimit() < deep:
        sys.setrecursionlimit(deep)
    acceptor = Acceptor()
    p = acceptor.add([words[i] for i in short])
    edit = OneEdit(acceptor)
    q = acceptor.add([words[i] for i in long]) if long else 0
    if len(short) > 1:
        for x, y in edit.replaced(p, places):
            yield short[x], short[y]
    if long:
        for x, y in edit.deleted(q, p, places):
            yield long[x], short[y]


# -- partitions ------------------------------------------------------------------------------


def _keyed(cells: DataFrame) -> DataFrame:
    """What the words of a cell share before and after the span of the edit, and the part between."""
    length = F.char_length("word")
    after = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return cells.withColumns(
        {
            "prefix": F.col("word").substr(F.lit(1), F.col("lo")),
            "suffix": F.when(after > 0, F.col("word").substr(length - after + 1, after)).otherwise(""),
            "middle": F.col("word").substr(F.col("lo") + 1, length - after - F.col("lo")),
        }
    )


def _first_cells(words: DataFrame, least_length: int) -> DataFrame:
    """Each word as the shorter or equal one of a pair (m = its length) and as the longer one (m one less).

    ``m`` is the pair's shorter length; the edit stands at a place from ``lo`` to ``hi`` - 1. The
    words agree before ``lo`` and in the last m - hi symbols.
    """
    half = lambda m: F.floor(m / 2).cast("int")
    cell = lambda m, lo, hi: F.struct(m.alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    cells: list[Column] = []
    for m in (F.char_length("word"), F.char_length("word") - 1):
        cells += [cell(m, F.lit(0), half(m)), cell(m, half(m), m + 1)]
    listed = F.filter(F.array(*cells), lambda c: (c["m"] >= least_length) & (c["lo"] < c["hi"]))
    return words.select("word", "n", F.inline(listed))


def _cells(words: DataFrame, least_length: int, group_words: int) -> DataFrame:
    """Cells of at most ``group_words`` words. Larger ones are halved until the edit has one place.

    A cell of one place holds words that agree elsewhere: at most as many as there are symbols, and
    pairs of symbols on the longer side. So no group is large, whatever its words share.
    """
    cells, done = written(_keyed(_first_cells(words, least_length)), "cells"), []
    while True:
        sizes = cells.groupBy(*KEY).agg(F.count("*").alias("size"))
        large = written(sizes.filter((F.col("size") > group_words) & (F.col("hi") - F.col("lo") > 1)), "large-cells")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, cells])
        marked = attach(cells, large, KEY, "size", cells.count())
        done.append(marked.filter(F.col("size").isNull()).drop("size"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        spans = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
        split = marked.filter(F.col("size").isNotNull()).select("word", "n", "m", F.inline(spans))
        cells = written(_keyed(split), "cells")


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of every word of (word, n) with a near one.

    ``form`` is the near word of largest n, of equal ones the smallest. ``words`` must be distinct
    and at least ``least_length`` long. A pair is found in one cell; a task states the sum and the
    best of each word of a group, never its pairs.
    """
    cells = _cells(words, least_length, group_words)
    groups = cells.groupBy(*KEY).agg(F.collect_list("middle").alias("middles"), F.collect_list("n").alias("counts"))
    spans = [(F.least("hi", "m") - F.col("lo")).alias("low"), (F.col("hi") - F.col("lo")).alias("places")]
    groups = groups.filter(F.size("middles") > 1).select("prefix", "suffix", *spans, "middles", "counts")

    def enumerate_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                for x in _summed(row):
                    for column, value in zip(columns, x, strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "form_n", "form"])

    found = groups.mapInArrow(enumerate_pairs, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return summed.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def _summed(row: dict) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the best of them, the best of them) within one group."""
    middles, counts = row["middles"], row["counts"]
    near, best = [0] * len(middles), [-1] * len(middles)
    for pair in near_in_group(middles, row["low"], row["places"]):
        for a, b in (pair, pair[::-1]):
            near[a] += 1
            c = best[a]
            # Words of a group differ in their middles only, but for its end these may be of two lengths.
            if c < 0 or counts[b] > counts[c] or (counts[b] == counts[c] and middles[b] + row["suffix"] < middles[c] + row["suffix"]):
                best[a] = b
    whole = lambda i: row["prefix"] + middles[i] + row["suffix"]
    for i, n in enumerate(near):
        if n:
            yield whole(i), n, counts[best[i]], whole(best[i])


# -- forms and roots -------------------------------------------------------------------------


def last_of(links: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) links ends. Every round doubles the reach of a link.

    Forms grow ``TIMES``-fold in count, so chains are short and have no rings.
    """
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, times: int = TIMES, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    The form is the near word of largest n (of equal ones the smallest) if that n is at least
    ``times`` the word's own; else it is null. An empty table gives an empty result.
    """
    words = written(words, "words")
    near = near_words(words, least_length, group_words)
    is_form = F.col("form_n") >= times * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    joined = written(joined, "forms")
    roots = last_of(joined.filter("form is not null"))
    out = joined.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of all ``docs``. Only doc_id and text are read; repeated rows count again."""
    return variants(noisy_words(docs))
