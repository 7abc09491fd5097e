"""Token counts by a two-tier look-up on the map side; no pre-token is ever shuffled.

A tokenizer of this kind lower-cases a text, cuts it into pre-tokens and merges each on its own, so
a text's count is the sum of its pre-tokens' counts. The counts of frequent pre-tokens come from a
small broadcast table, those of the others from a cache that each Python worker keeps from task to
task; only what neither holds is encoded.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LIMIT = 2048
# Entries of the broadcast table, and the longest pre-token it takes: at most 8 MB with the lengths.
TABLE = 65_536
LONGEST = 64
# Documents sampled for the table, and the tasks that count them. They decide speed, never a count.
SAMPLE = 20_000
SAMPLE_TASKS = 8
# Pre-tokens that one worker remembers beyond the table.
MEMO = 300_000

# The parts of a tokenizer file for which the fast way below is exact.
NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same pattern for lower-cased text of the characters below.
PLAIN_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
# Anything but printable ASCII, ASCII white space and the letters from U+00C0 to U+00FF: normal
# forms, cases and classes of other characters are left to the library.
ODD = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
# A stretch without ASCII white space. Pre-tokens, normal forms and added tokens never cross one.
STRETCH = re.compile("[^\t-\r ]+")


class PreTokens:
    """Counts tokens of texts with one tokenizer file; made once a worker and file."""

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encoded = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.plain = _is_plain(spec)
        self.memo: dict[str, int] = {}

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """(pre-tokens of the plain stretches, stretches that only the library may cut)."""
        if not self.plain:
            return [], [text] if text else []
        if not ODD.search(text) and not any(a in text for a in self.added):
            return PLAIN_PRE_TOKEN.findall(text.lower()), []
        plain, odd = [], []
        for stretch in STRETCH.findall(text):
            (odd if ODD.search(stretch) or any(a in stretch for a in self.added) else plain).append(stretch)
        return PLAIN_PRE_TOKEN.findall(" ".join(plain).lower()), odd

    def length(self, part: str) -> int:
        """Tokens of one part, from this worker's cache where it is known."""
        known = self.memo.get(part)
        if known is None:
            known = self.encoded(part)
            if len(part) <= LONGEST:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[part] = known
        return known

    def counter(self, frequent: dict[str, int]) -> Callable[[str], int]:
        """text -> tokens, with ``frequent`` as the first tier."""

        class Tiers(dict):
            def __missing__(tiers, part: str) -> int:  # noqa: N805
                return self.length(part)

        look_up = Tiers(frequent).__getitem__

        def count(text: str) -> int:
            plain, odd = self.parts(text)
            return sum(map(look_up, plain)) + sum(map(self.length, odd))

        return count


def _is_plain(spec: dict) -> bool:
    """Does the file say the normalizers and the pattern that the fast way reproduces?"""
    flat = lambda part, inner: (part or {}).get(inner) or ([part] if part else [])
    normalizers = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in flat(spec.get("normalizer"), "normalizers")]
    pre = flat(spec.get("pre_tokenizer"), "pretokenizers")
    split = pre[0] if pre else {}
    pattern = (split.get("pattern") or {}).get("Regex")
    ends = len(pre) == 2 and pre[1]["type"] == "ByteLevel" and not pre[1].get("use_regex", True) and not pre[1].get("add_prefix_space")
    kept = split.get("behavior") == "Removed" and split.get("invert") is True
    stands_alone = [not (t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"])) for t in spec.get("added_tokens", [])]
    return normalizers == NORMALIZERS and pattern == PRE_TOKEN and kept and ends and all(stands_alone)


@lru_cache(maxsize=4)
def pre_tokens(tokenizer_file: str) -> PreTokens:
    """The worker's counter for a file; it outlives a task, and so does its cache."""
    return PreTokens(tokenizer_file)


@lru_cache(maxsize=4)
def _unpacked(words: str, lengths: bytes) -> dict[str, int]:
    return dict(zip(words.split("\n"), lengths, strict=True)) if words else {}


def frequent_lengths(docs: DataFrame, tokenizer_file: str, table: int = TABLE, sample: int = SAMPLE) -> tuple[str, bytes]:
    """The ``table`` most frequent pre-tokens of about ``sample`` documents, packed: words and a length byte each.

    The sampled documents are dealt to a few tasks; each returns its own most frequent ones, which
    the driver adds up. So documents move, pre-tokens don't, and the driver sees at most
    ``SAMPLE_TASKS * table`` of them. A table fitted once serves any number of later counts.
    """
    rows = docs.select(text_of().alias("text"))
    share = min(1.0, sample / max(rows.count(), 1))
    sampled = rows.sample(share, seed=13).repartition(SAMPLE_TASKS)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        parts = pre_tokens(tokenizer_file).parts
        for batch in batches:
            for text in batch.column(0):
                found.update(parts(text.as_py())[0])
                if len(found) > 8 * table:
                    found = Counter(dict(found.most_common(2 * table)))
        best = [(w, n) for w, n in found.most_common(table) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])

    total: Counter[str] = Counter()
    for row in sampled.mapInArrow(top, "word string, n long").collect():
        total[row.word] += row.n
    length = pre_tokens(tokenizer_file).length
    chosen = [(w, length(w)) for w, _ in total.most_common(table)]
    chosen = [(w, n) for w, n in chosen if n < 256]
    return "\n".join(w for w, _ in chosen), bytes(n for _, n in chosen)


def count_tokens(docs: DataFrame, tokenizer_file: str, frequent: tuple[str, bytes] | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as ``tokenizers`` counts its whole text.

    A null text is empty: no bytes, no tokens. No tokens are added at either end, an added token's
    string inside a text is one token, nothing is cut or padded. Repeated rows and null ids stay
    rows of their own; other columns of ``docs`` are left out; an empty table gives an empty
    result. ``frequent`` is what :func:`frequent_lengths` gave; without it the table is fitted here.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer_file) if frequent is None else frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = pre_tokens(tokenizer_file).counter(_unpacked(*table.value))
        for batch in batches:
            tokens = [count(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
