"""Best-fit packing in bulk-synchronous rounds over length and gap classes."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import with_positions
from .common import text_of, written

CAPACITY = 1024
END_ID = 2
# Chunks remembered by one Python worker; then it starts over.
MEMO_CHUNKS = 600_000


class _Chunks(dict):
    """Ids (little-endian bytes) of a text chunk, worked out once per worker."""

    def __init__(self, ids_of: Callable[[str], list[int]], lead: str) -> None:
        super().__init__()
        self.ids_of, self.lead = ids_of, lead

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMO_CHUNKS:
            self.clear()
        self[chunk] = out = np.asarray(self.ids_of(self.lead + chunk), dtype="<u4").tobytes()
        return out


# Fixed value: how a byte-level pre-tokenizer cuts a text into words.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to ids, where the file is a plain byte-level BPE whose ids follow its merges."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    # Printable bytes stand for themselves, the others for code points from 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(set(merged)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}


def encoder(tokenizer_file: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian bytes, equal to those that ``tokenizers`` gives for the whole text.

    A byte-level pre-tokenizer always starts a new word at a single space between two characters
    that are not white space. So the text is cut there and each chunk, a word with its space, is
    looked up; a chunk that is new to this worker is encoded by the file's merges in ``tiktoken``,
    which takes a third of the time. Texts with an added token's string, and files of any other
    kind, go to ``tokenizers`` itself.
    """
    import json

    import regex
    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    tokenizer, ranks = Tokenizer.from_file(tokenizer_file), _ranks(spec)
    whole = lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    if ranks is None:
        return whole
    added = [t["content"] for t in spec.get("added_tokens", [])]
    ids_of = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    first, later = _Chunks(ids_of, ""), _Chunks(ids_of, " ")
    # White space next to a space: there the simple split would cut at the wrong place.
    crowded = regex.compile(r"[\s\u180e\u200b] | [\s\u180e\u200b]")
    between = regex.compile(r"(?<=[^\s\u180e\u200b]) (?=[^\s\u180e\u200b])")
    look_up = later.__getitem__

    def encode(text: str) -> bytes:
        if any(t in text for t in added):
            return whole(text)
        parts = between.split(text) if crowded.search(text) else text.split(" ")
        return b"".join([first[parts[0]], *map(look_up, parts[1:])])

    return encode


def tokenize(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of the documents.

    Each document is its ids and ``end_id``; a null text is an empty one, so a single id. A longer
    one than ``capacity`` is cut into pieces of that size, of which the first may be shorter. With
    ``with_ids`` the ids come along as little-endian unsigned 32-bit bytes.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(texts):
                data = memoryview(encode(text.as_py()) + end)
                n = len(data) // 4
                a, k = 0, 0
                b = n % capacity or capacity
                while a < n:
                    part = data[4 * a : 4 * b]
                    at.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(bytes(part))
                    a, b, k = b, b + capacity, k + 1
            columns = [ids_of.take(pa.array(at, pa.int32())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            columns += [pa.array(ids, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col("doc_id").cast("long"), text_of())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(cut, schema)


def best_fit_rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit on classes: (length, first rank, documents, first sequence, documents a sequence, offset).

    Documents of one length and sequences with one gap are alike, so a round handles a length as a
    whole, longest first: the gaps are swept upwards from the smallest that fits (the successor),
    ranks decide which documents meet which sequences, the gaps shrink, and new sequences open for
    the rest. That is best fit for every single document, yet its work and its size depend on
    ``capacity`` alone, never on the number of documents.
    """
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    plan, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in runs:
                insort(gaps, gap)
            runs.setdefault(gap, []).append((first, n))

    for length in sorted((n for n in counts if counts[n] > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full, rest = min(n, left // each), 0
            if full < n and left - full * each < each:
                rest = left - full * each
            for k, m, start, sequences in ((each, full * each, first, full), (max(rest, 1), rest, first + full, 1 if rest else 0)):
                if m:
                    plan.append((length, rank, m, start, k, capacity - gap))
                    put(gap - k * length, start, sequences)
                    rank, left = rank + m, left - m
            used = full + (1 if rest else 0)
            put(gap, first + used, n - used)
    return plan


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Pieces are range-sorted by length and ``order`` and ranked inside their length, which needs no
    task per length. The counts by length (at most ``capacity`` rows) go to the driver for
    ``best_fit_rounds``; its plan, bounded by capacity squared, goes back to the tasks, which look
    their rows up by rank. Lengths must lie between 1 and ``capacity``; ties may take either place.
    """
    ranked = with_positions(pieces, [length], order, "_rank")
    counts = {r[length]: r["count"] for r in ranked.groupBy(length).count().collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = np.array(sorted(best_fit_rounds(counts, capacity)), dtype=np.int64).reshape(-1, 6)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = (plan[:, 0] << 48) + plan[:, 1]
        for frame in frames:
            rank = frame["_rank"].to_numpy() - 1
            of = plan[np.searchsorted(starts, (frame[length].to_numpy() << 48) + rank, "right") - 1]
            nth = rank - of[:, 1]
            frame["sequence_id"] = of[:, 3] + nth // of[:, 4]
            frame["offset"] = of[:, 5] + nth % of[:, 4] * of[:, 0]
            yield frame.drop(columns="_rank")

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ranked.columns if c != "_rank") + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Null and empty texts are one end id each. Repeated rows and ids are packed like any others;
    a null id stays null. Other columns of ``docs`` are left out. An empty table gives an empty result.
    """
    pieces = written(tokenize(docs, tokenizer_file, capacity, end_id), "pieces")
    placed = pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
