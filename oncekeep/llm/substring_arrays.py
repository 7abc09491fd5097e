"""Removing repeated byte strings by suffix arrays from induced sorting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .winnow import CHUNK, Windows, byte_values, covered_runs, covered_units, rows_of

WINDOW = 100
GRAM = 24
# Bytes whose suffixes one array sorts.
SHARD_BYTES = 1_000_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes or other small numbers by induced sorting.

    Suffixes are classified, the leftmost-smaller substrings sorted by one induction and named,
    their order settled on the names, and a second induction places all suffixes. An induction
    goes through the buckets of the first symbols; what one bucket passes on is moved as a whole.
    """
    s = np.append(text.astype(np.int64) + 1, 0)  # closed by a least symbol of its own
    n = len(s)
    step = np.sign(np.diff(s))
    # A suffix is smaller than the one behind it if the next change of symbol goes up.
    change = np.where(step != 0, np.arange(n - 1), n - 2)
    change = np.minimum.accumulate(change[::-1])[::-1] if n > 1 else change
    smaller = np.append(step[change] > 0, True) if n > 1 else np.array([True])
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = leftmost
    if len(leftmost) > 1:
        found = _induce(s, smaller, leftmost)
        flag = np.zeros(n, dtype=bool)
        flag[leftmost] = True
        found = found[flag[found]]
        length = np.zeros(n, dtype=np.int64)
        length[leftmost] = np.diff(np.append(leftmost, n - 1)) + 1
        names = np.zeros(n, dtype=np.int64)
        names[found] = np.cumsum(np.append(False, ~_equal(s, found[:-1], found[1:], length)))
        order = leftmost[_ranked(names[leftmost])]
    return _induce(s, smaller, order)[1:]


def _equal(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Are the substrings at ``a`` and ``b`` of their ``length`` the same?"""
    same = length[a] == length[b]
    left, at = np.flatnonzero(same), 0
    while len(left):
        same[left] = s[a[left] + at] == s[b[left] + at]
        at += 1
        left = left[same[left] & (length[a[left]] > at)]
    return same


def _ranked(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of names: pairs of names get names, until all differ."""
    rank, width = names, 1
    while True:
        count = int(rank.max()) + 1
        if count == len(rank):
            return np.argsort(rank)
        behind = np.append(rank[width:] + 1, np.zeros(min(width, len(rank)), dtype=np.int64))[: len(rank)]
        rank = np.unique(rank * (count + 1) + behind, return_inverse=True)[1].reshape(-1)
        width *= 2


def _induce(s: np.ndarray, smaller: np.ndarray, order: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the leftmost-smaller ones in ``order`` induce."""
    alphabet = int(s.max()) + 1
    seeds = _by_symbol(s, order)
    larger: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    lower: list[list[np.ndarray]] = [[] for _ in range(alphabet)]

    def pass_on(rows: list[np.ndarray], kind: bool, into: list[list[np.ndarray]], own: int) -> list[np.ndarray]:
        """Pass the suffixes in front of a bucket's rows to their buckets; the bucket grows by those of its own symbol."""
        level, all_ = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64), []
        while len(level):
            all_.append(level)
            front = level[level > 0] - 1
            front = front[smaller[front] == kind]
            at_home = s[front] == own
            for symbol, part in _by_symbol(s, front[~at_home]).items():
                into[symbol].append(part)
            level = front[at_home]
        return all_

    for symbol in range(alphabet):
        larger[symbol] = pass_on(larger[symbol], False, larger, symbol)
        if symbol in seeds:
            pass_on([seeds[symbol]], False, larger, symbol)
    lower[0].append(np.array([len(s) - 1]))
    out: list[np.ndarray] = []
    for symbol in range(alphabet - 1, 0, -1):
        out += pass_on(lower[symbol], True, lower, symbol)
        backwards = [part[::-1] for part in reversed(larger[symbol])]
        pass_on(backwards, True, lower, symbol)
        out += backwards
    return np.concatenate(out + lower[0])[::-1]


def _by_symbol(s: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    if not len(rows):
        return {}
    symbols = s[rows]
    order = np.argsort(symbols, kind="stable")
    edges = np.flatnonzero(np.diff(symbols[order])) + 1
    parts = np.split(rows[order], edges)
    return dict(zip(symbols[order][np.append(0, edges)].tolist(), parts, strict=True))


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Length of the prefix that each suffix (in text order) shares with the one before it in the array, up to ``most``."""
    n = len(text)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.append(text.astype(np.int64), -1 - np.arange(2))
    out = np.zeros(n, dtype=np.int64)
    # Eight symbols at a time while they agree, then one at a time.
    words = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        words = words * np.uint64(256) + np.append(text[k:], np.zeros(min(k, n), text.dtype)).astype(np.uint64)
    left = np.flatnonzero(before >= 0)
    while len(left):
        a, b = left + out[left], before[left] + out[left]
        left = left[(np.maximum(a, b) + 8 <= n) & (words[np.minimum(a, n - 1)] == words[np.minimum(b, n - 1)]) & (out[left] < most)]
        out[left] += 8
    left = np.flatnonzero(before >= 0)
    while len(left):
        a, b = np.minimum(left + out[left], n), np.minimum(before[left] + out[left], n + 1)
        same = (padded[a] == padded[b]) & (out[left] < most) & (a < n) & (b < n)
        left = left[same]
        out[left] += 1
    return np.minimum(out, most)


def repeated_windows(contents: list[bytes], groups: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each content, in (document, place) order inside its group, a flag per window: does it start earlier too?"""
    # A passage ends with a symbol that no byte has; windows never reach it.
    symbols = [np.append(np.frombuffer(c, dtype=np.uint8).astype(np.uint16) + 1, np.uint16(0)) for c in contents]
    text = np.concatenate(symbols)
    starts = np.cumsum([0, *map(len, symbols[:-1])])
    suffix = suffix_array(text)
    shared = permuted_prefixes(text, suffix, window)[suffix]
    of = np.searchsorted(starts, suffix, "right") - 1
    place = suffix - starts[of]
    good = place < counts[of]
    # Stretches of the array with a shared prefix of a whole window are one string.
    string = np.cumsum(shared < window)
    of, place, string = of[good], place[good], string[good]
    order = np.lexsort((place, of, string))
    again = np.append(False, string[order][1:] == string[order][:-1])
    flags = [np.zeros(n, dtype=bool) for n in counts]
    for i, p in zip(of[order][again].tolist(), place[order][again].tolist(), strict=True):
        flags[i][p] = True
    return flags


def repeated_bytes(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, runs) of the windows of ``window`` bytes that start earlier too, for ``winnow.rows_of`` a stored table."""
    shape = Windows(window, min(GRAM, window))

    def units(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        for a in range(0, len(data) - window + 1, CHUNK):
            part = data[a : a + CHUNK + window - 1]
            yield a, byte_values(part, 0), byte_values(part, 1)

    def cut(text: str) -> Callable[[int, int], bytes]:
        data = text.encode("utf-8", "surrogatepass")
        return lambda first, count: data[first : first + count + window - 1]

    def repeated(contents: list[bytes], groups: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        return repeated_windows(contents, groups, counts, window)

    return covered_runs(rows, shape, units, cut, repeated, keep_first=True, shard_bytes=SHARD_BYTES)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per document: without bytes in a window that also starts earlier.

    Earlier means a smaller doc_id, or an earlier place in the document; rows with one id are
    taken in the order of the table, so of repeated rows one keeps its text, and null ids come
    first. The first copy of a string stays; windows are judged on the input and may overlap.
    ``kept`` is binary, as a cut may fall into a character. Rows of a plain scan are numbered by
    their place (files in order of their paths); other ``docs`` are numbered and written once.
    A null or empty text has no bytes. Other columns of ``docs`` are left out. An empty table
    gives an empty result.

    Each shard holds the passages of whole anchors (see ``winnow``): every pair of equal windows
    meets in one shard, and their array tells which of them start earlier.
    """
    rows = rows_of(numbered(docs, "row", ["doc_id", "text"]), "row")
    runs = repeated_bytes(rows, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, packed in zip(batch.column("text"), batch.column("runs"), strict=True):
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                gone = covered_units(packed.as_py(), window, len(data))
                spans = int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())
                for column, value in zip(out, (len(data), int(gone.sum()), spans, data[~gone].tobytes()), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.binary()]
            columns = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(runs, "row", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
