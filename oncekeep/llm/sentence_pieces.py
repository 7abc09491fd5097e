"""SentencePiece encoding by shared-prefix Viterbi, and decoding."""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

MARK = "▁"
# A marked word: its marks and what follows them. Line ends stand alone, as no piece holds one.
MARKED = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
# Words, parts of words and piece pairs that one Python worker remembers, each, in each of two generations.
MEMO = 300_000
# Characters of text whose new words are sorted into one trie.
TRIE_CHARS = 2_000_000
# What an unknown character costs below the worst piece, in a unigram model. Fixed value.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        self.ids, self.scores, self.byte_ids = {}, {}, {}
        self.shown: list[bytes] = []
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.shown.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.shown.append(b"")
            elif model.is_unknown(i):
                self.shown.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.shown.append(piece.replace(MARK, " ").encode())
        self.unknown = model.unk_id()
        self.packed = {piece: array("i", [i]).tobytes() for piece, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                tails.setdefault(piece[-3:], set()).add(len(piece))
        # Lengths of the pieces that end with the last three characters, longest first; or with the last two.
        self.lengths = {t: sorted(found | ({2} if t[-2:] in self.ids else set()), reverse=True) for t, found in tails.items()}
        self.inside = {pair for piece in self.ids for pair in zip(piece, piece[1:], strict=False)}
        self.least = min(self.scores.values(), default=0.0)

    def parts(self, word: str) -> list[str]:
        """The word cut between two characters that stand next to each other in no piece: none can cross there."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def ids_of(self, piece: str) -> bytes:
        """The piece's id, packed; of an unknown character its bytes' ids."""
        found = self.packed.get(piece)
        if found is None:
            spelt = piece.encode("utf-8", "surrogatepass") if self.byte_ids else b""
            found = array("i", [self.byte_ids.get(b, self.unknown) for b in spelt] or [self.unknown]).tobytes()
        return found


class SharedPrefixViterbi:
    """Best segmentations of many words; forward states are kept along the path of the trie.

    The words come sorted, so they pass as in a depth-first walk of their trie, and the states of
    a common prefix are worked out once. A state holds where the last piece of the prefix begins.

    In a ``unigram`` model the last piece is the one with the best sum of scores. In a ``bpe``
    model the pieces come from merges; there a prefix has exactly one last piece that its own
    predecessor tolerates, that is, the two merge to themselves, so the same forward pass finds
    the result of the merges. That makes the ids those of the library for either kind.
    """

    def __init__(self, pieces: Pieces, kind: str) -> None:
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind of model: {kind}")
        self.pieces, self.bpe = pieces, kind == "bpe"
        self.tolerated: dict[tuple[str, str], bool] = {}
        self.grown: dict[str, tuple | None] = {}

    def merged(self, text: str) -> list[str]:
        """Merges of the best score first, of equal ones the leftmost."""
        scores, parts = self.pieces.scores, list(text)
        while len(parts) > 1:
            best = max((scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == -np.inf:
                break
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _growth(self, piece: str) -> tuple | None:
        """How a piece comes about by merges: its left and right ends over time, and whether scores only fall.

        An end is (text, score at which it came, score at which it went); None if the merges of its
        characters do not give the piece.
        """
        if piece in self.grown:
            return self.grown[piece]
        scores, parts = self.pieces.scores, list(piece)
        left, right, time, falling = [[parts[0], np.inf, -np.inf]], [[parts[-1], np.inf, -np.inf]], np.inf, True
        while len(parts) > 1:
            best, at = max((scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == -np.inf:
                break
            falling, time, at = falling and best < time, best, -at
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            for ends, touched in ((left, at == 0), (right, at == len(parts) - 1)):
                if touched:
                    ends[-1][2] = best
                    ends.append([parts[at], best, -np.inf])
        self.grown[piece] = out = (left, right, falling) if len(parts) == 1 else None
        return out

    def _fits(self, before: str, piece: str) -> bool:
        """Do the merges of both together give these two pieces?"""
        pair = (before, piece)
        known = self.tolerated.get(pair)
        if known is None:
            if len(self.tolerated) >= MEMO:
                self.tolerated.clear()
            known = self.tolerated[pair] = self._tolerates(before, piece)
        return known

    def _tolerates(self, before: str, piece: str) -> bool:
        """They do unless two ends that meet are merged while both exist; where scores rise or tie, the merges are run."""
        after = self._growth(piece)
        if after is None or not before:
            return after is not None
        front = self._growth(before)
        if front is None:
            return False
        plain, scores = front[2] and after[2], self.pieces.scores
        for a, a_came, a_went in front[1]:
            for b, b_came, b_went in after[0]:
                score = scores.get(a + b)
                if score is not None:
                    low, high = max(a_went, b_went), min(a_came, b_came)
                    if not plain or score == low or high == low:
                        return self.merged(before + piece) == [before, piece]
                    if score > low and high > low:
                        return False
        return True

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of sorted words."""
        scores, longest, lengths, tolerated = self.pieces.scores, self.pieces.longest, self.pieces.lengths, self.tolerated
        begin, best, previous = [0], [0.0], ""
        worst = self.pieces.least - UNKNOWN_PENALTY
        for word in words:
            shared = 0
            for a, b in zip(word, previous, strict=False):
                if a != b:
                    break
                shared += 1
            del begin[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                low = max(0, end - longest)
                if self.bpe:
                    tail = word[end - 3 : end] if end > 3 else word[:end]
                    for n in lengths.get(tail) or lengths.get(tail[-2:], ()):
                        start = end - n
                        if start >= 0 and (piece := word[start:end]) in scores:
                            pair = (word[begin[start] : start], piece)
                            fits = tolerated.get(pair)
                            if fits or fits is None and self._fits(*pair):
                                break
                    else:
                        start = end - 1
                    begin.append(start)
                else:
                    top, at = -np.inf, end - 1
                    for start in range(low, end):
                        score = scores.get(word[start:end])
                        if score is None and start == end - 1:
                            score = worst
                        if score is not None and best[start] + score > top:
                            top, at = best[start] + score, start
                    begin.append(at), best.append(top)
            out, end = [], len(word)
            while end:
                out.append(word[begin[end] : end])
                end = begin[end]
            yield word, out[::-1]
            previous = word


class Memory:
    """Results that a worker keeps. Of a full generation only what is asked for again while the next one fills stays."""

    def __init__(self) -> None:
        self.now: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def unknown(self, wanted: set[str]) -> set[str]:
        """Those of ``wanted`` without a result; the results of the others stand in ``now``."""
        new = wanted.difference(self.now)
        if len(self.now) + len(new) > MEMO:
            self.former, self.now, new = self.now, {}, wanted
        now, former = self.now, self.former
        again = former.keys() & new
        now.update((w, former[w]) for w in again)
        return new - again


class BatchEncoder:
    """texts -> ids. Known words are looked up; the distinct new parts of the others are sorted and segmented together."""

    def __init__(self, model_file: str, kind: str) -> None:
        self.pieces = Pieces(model_file)
        self.viterbi = SharedPrefixViterbi(self.pieces, kind)
        self.words, self.known = Memory(), Memory()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # Millions of short lists without a ring among them: the collector would only walk them again and again.
        running = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if running:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [MARKED.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        ids_of = self.pieces.ids_of
        cut = {w: self.pieces.parts(w) for w in self.words.unknown(set().union(*marked))}
        new = self.known.unknown({p for parts in cut.values() for p in parts})
        words, known = self.words.now, self.known.now
        for part, pieces in self.viterbi.segment(sorted(new)):
            known[part] = b"".join(map(ids_of, pieces))
        for word, parts in cut.items():
            words[word] = known[parts[0]] if len(parts) == 1 else b"".join(map(known.__getitem__, parts))
        return [np.frombuffer(b"".join(map(words.__getitem__, found)), dtype="<i4") for found in marked]


@lru_cache(maxsize=4)
def batch_encoder(model_file: str, kind: str = "bpe") -> BatchEncoder:
    """The worker's encoder for a file; it outlives a task, and so do the words it knows."""
    return BatchEncoder(model_file, kind)


@lru_cache(maxsize=4)
def decoder(model_file: str) -> Callable[[np.ndarray], str]:
    """ids -> text: pieces joined, bytes put together, marks as spaces, the added first mark dropped."""
    shown = Pieces(model_file).shown

    def decode(ids: np.ndarray) -> str:
        text = b"".join(map(shown.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    return decode


def _encoded(batches: Iterator[pa.RecordBatch], encode: BatchEncoder) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """(rows, texts, ids) for stretches of rows (the last column the text) of about ``TRIE_CHARS`` characters."""
    for batch in batches:
        column, a = batch.column(batch.num_columns - 1), 0
        while a < batch.num_rows:
            b, size, texts = a, 0, []
            while b < batch.num_rows and size < TRIE_CHARS:
                texts.append(column[b].as_py() or "")
                size += len(texts[-1])
                b += 1
            yield batch.slice(a, b - a), texts, encode(texts)
            a = b


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32)), pa.array(np.concatenate(ids)))


def encode_documents(docs: DataFrame, model_file: str, kind: str = "bpe") -> DataFrame:
    """``docs`` (its last column the text) with the text replaced by ``ids``; nothing is shuffled.

    A null or empty text has no ids. Characters without a piece become their bytes. A mark in a
    text is the same as a space. Long texts are segmented word by word, so their memory is that of
    the text. Repeated rows get the same ids, an empty table stays empty.
    """
    *keys, _ = docs.columns
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, ids in _encoded(batches, batch_encoder(model_file, kind)):
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], _lists(ids)], names=[*keys, "ids"])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "ids array<int>"]))


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` (its last column ids) with a further column ``decoded``; null ids give a null text."""
    names, kinds = encoded.columns, dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(model_file)
        for batch in batches:
            column = batch.column(len(names) - 1)
            texts = [decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "decoded string"]))


def encode_and_decode(docs: DataFrame, model_file: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, n_ids, ids, round_trip): the ids of each text, and whether decoding gives the text back.

    A null text counts as empty. Other columns of ``docs`` are left out.
    """
    named = ["doc_id", "n_ids", "ids", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(model_file)
        for rows, texts, ids in _encoded(batches, batch_encoder(model_file, kind)):
            back = pa.array([decode(x) == text for x, text in zip(ids, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in ids], pa.int64()), _lists(ids), back], names=named)

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_ids long, ids array<int>, round_trip boolean")
