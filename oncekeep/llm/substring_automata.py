"""Removing repeated passages of words by suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, text_of
from .winnow import CHUNK, Rolling, Windows, byte_values, covered_runs, covered_units, mix, rows_of

WINDOW = 35
GRAM = 8
# Bytes of reference passages in one automaton.
SHARD_BYTES = 200_000
SHARD_WORDS = 40_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    inside = ~_SPACE[np.frombuffer(data, dtype=np.uint8)]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_values(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    out: list[list[np.ndarray]] = [[], []]
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = data[at:end]
        start, stop = word_spans(part)
        raw = np.frombuffer(part, dtype=np.uint8)
        for which in (0, 1):
            spans = Rolling(byte_values(raw, which), which)(start, stop)
            out[which].append(mix(spans ^ (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        at = end
    empty = [np.zeros(0, dtype=np.uint64)]
    return np.concatenate(out[0] or empty), np.concatenate(out[1] or empty)


class Automaton:
    """Suffix automaton of a list of numbers, with the number of places of each state."""

    def __init__(self, text: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]
        last = 0
        for symbol in text:
            last = self._extend(last, symbol)
        for state in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            self.places[self.link[state]] += self.places[state]

    def _state(self, edges: dict[int, int], link: int, length: int, places: int) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.places.append(places)
        return len(self.next) - 1

    def _extend(self, last: int, symbol: int) -> int:
        new, at = self._state({}, 0, self.length[last] + 1, 1), last
        while at != -1 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at != -1:
            target = self.next[at][symbol]
            if self.length[target] != self.length[at] + 1:
                copy = self._state(dict(self.next[target]), self.link[target], self.length[at] + 1, 0)
                self.link[target] = copy
                while at != -1 and self.next[at].get(symbol) == target:
                    self.next[at][symbol] = copy
                    at = self.link[at]
                target = copy
            self.link[new] = target
        return new

    def stream(self, text: list[int], window: int) -> list[int]:
        """For each window of ``text``, at how many places of the automaton's own text it stands.

        These are matching statistics cut at ``window``: the state of the longest suffix that
        matches, never longer than a window.
        """
        edges, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for i, symbol in enumerate(text):
            while state and symbol not in edges[state]:
                state = link[state]
                matched = length[state]
            if symbol in edges[state]:
                state, matched = edges[state][symbol], matched + 1
            while matched >= window and length[link[state]] >= window:
                state = link[state]
            matched = min(matched, window)
            if i >= window - 1:
                out.append(self.places[state] if matched == window else 0)
        return out


def repeated_windows(contents: list[bytes], groups: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each content a flag per window: does its word sequence stand anywhere else in the shard?

    One automaton serves many small groups. A group beyond ``SHARD_WORDS`` is cut into reference
    blocks and streamed past the automaton of each, so memory stays bounded and nothing is missed.
    """
    names: dict[bytes, int] = {}
    texts = [[names.setdefault(w, len(names)) for w in c.split(b" ")] for c in contents]
    flags = [np.zeros(n, dtype=bool) for n in counts]
    block_of, size, block, group = [], 0, 0, None
    for text, g in zip(texts, groups, strict=True):
        if size > SHARD_WORDS:
            block, size = block + 1, 0
        block_of.append(block)
        size, group = size + len(text) + 1, g
    block_of = np.array(block_of)
    for b in range(block + 1):
        own = np.flatnonzero(block_of == b).tolist()
        joined: list[int] = []
        for i in own:
            joined += [*texts[i], -1 - i]  # an end of its own after each passage
        automaton = Automaton(joined)
        reference = set(groups[own].tolist())
        for i, text in enumerate(texts):
            if groups[i] in reference:
                least = 2 if block_of[i] == b else 1
                flags[i] |= np.array(automaton.stream(text, window)) >= least
    return flags


def repeated_words(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, runs) of the windows of ``window`` words that stand anywhere else, for ``winnow.rows_of`` a stored table."""
    shape = Windows(window, min(GRAM, window))

    def units(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        one, two = word_values(text.encode("utf-8", "surrogatepass"))
        for a in range(0, len(one) - window + 1, CHUNK):
            yield a, one[a : a + CHUNK + window - 1], two[a : a + CHUNK + window - 1]

    def cut(text: str) -> Callable[[int, int], bytes]:
        words = text.encode("utf-8", "surrogatepass").split()
        return lambda first, count: b" ".join(words[first : first + count + window - 1])

    def repeated(contents: list[bytes], groups: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        return repeated_windows(contents, groups, counts, window)

    return covered_runs(rows, shape, units, cut, repeated, keep_first=False, shard_bytes=SHARD_BYTES)


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with each word removed that lies in a window of ``window`` words standing anywhere else too.

    Adds n_words and n_removed. Every copy of a passage goes, the first too, in the same document
    as in others; windows are judged on the input. Words are runs without ASCII white space and
    stay as they are; the white space before a removed word goes with it, unless the text begins
    with the word. Rows that are not a plain scan are
    written once with their numbers.

    A null or empty text has no words and comes back as it was. Repeated rows are copies of each
    other. Ids are only carried along and may be null. Columns named n_words or n_removed are
    replaced. An empty table gives an empty result.

    Whole-corpus automata would have to be broadcast shard by shard past every document, which
    grows with the square of the corpus. Here a passage only meets the reference shard of its
    anchor (see ``winnow``); other shards cannot hold its windows.
    """
    names, kinds = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")], dict(docs.dtypes)
    rows = numbered(docs, "__row", names)
    runs = repeated_words(rows_of(rows, "__row"), window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, packed in zip(batch.column("__body"), batch.column("__runs"), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                start, stop = word_spans(data)
                gone = covered_units(packed.as_py(), window, len(start))
                n_words.append(len(start)), n_removed.append(int(gone.sum()))
                texts.append(_without(data, start, stop, gone).decode("utf-8", "surrogatepass") if gone.any() else text.as_py())
            kept = pa.array(texts, pa.string())
            if "text" in names:
                was_null = batch.column("text").is_null()
                kept = pa.compute.if_else(was_null, pa.scalar(None, pa.string()), kept)
            columns = [kept if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    import pyarrow.compute  # noqa: F401

    joined = rows.withColumn("__body", text_of()).join(runs.select(F.col("row").alias("__row"), F.col("runs").alias("__runs")), "__row", "left").drop("__row")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_words long, n_removed long"
    return joined.mapInArrow(cut, schema)


def _without(data: bytes, start: np.ndarray, stop: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words that go and the white space before them."""
    keep = np.ones(len(data) + 1, dtype=np.int64)
    edges = np.zeros(len(data) + 1, dtype=np.int64)
    before = np.append(0, stop[:-1])
    np.add.at(edges, before[gone], 1)
    np.add.at(edges, stop[gone], -1)
    keep = np.cumsum(edges[:-1]) == 0
    out = np.frombuffer(data, dtype=np.uint8)[keep].tobytes()
    return out if not gone[0] else out.lstrip(b" \t\n\r\x0b\x0c")
