"""Near copies by exact Jaccard similarity of word shingles: prefix filter, then the sets themselves.

Every pair at or above the bound becomes a candidate: in one order of all shingles such a pair has a
common shingle among the first of both sets (the prefix filter). Fingerprints are not used, as a
pair at the bound often lies as far apart in bits as unrelated texts do in a large table.

Keys that hold the same rows are one key, so a pair that shares many rare shingles meets once. Where rows meet,
their parity sketches are compared: a bit tells whether an odd number of shingles fall on it, so two sketches differ in
at most as many bits as the sets do in shingles. Pairs whose sketches differ in more than the bound allows cannot
link and are not listed; no other pair is left out. Whole sets are fetched for the rest only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import small
from ..session import discard
from .common import text_of, written
from .components import connected
from .simhash import _LOWER, simhash_groups

# Texts on which frequent shingles are told; they only move to the end of the order, no shingle is left out.
SAMPLE = 20_000
COMMON = 200_000
# Pairs per row of a shared shingle up to which all of them are listed at once.
LISTED = 8
# Rounds in which rows of other shingles only meet a leader; then whatever is left is listed.
ROUNDS = 8
# Share of its pairs above which a round counts as idle: whatever is left is listed then.
STALLED = 0.9
# Leaders that the shingles of one round pick from one group.
LEADERS = 4
# Longs of a parity sketch. Sets of more than about twice its bits pass it unjudged and are compared whole.
SKETCH_LONGS = 16


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the lowered word shingles; a text of fewer words is one shingle, one without words too."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts, k = [0, *(ends[:-1] + 1).tolist()], max(min(shingle, len(words)) - 1, 0)
    ends = ends.tolist() or [0]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(body[a:b], 42) for a, b in zip(starts, ends[k:], strict=False)), dtype="<u8"))


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """Bits of ``SKETCH_LONGS`` longs on which an odd number of the distinct hashes ``own`` fall."""
    width = 64 * SKETCH_LONGS
    odd = np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes) of ``rows`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "hashes"])

    return rows.select("id", "text").mapInArrow(run, "id long, hashes array<long>")


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three and more texts of a sample, sorted, and their counts there."""
    step = max(1, rows.count() // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0)
    counts = _sets(sample, shingle).select(F.explode("hashes").alias("hash")).groupBy("hash").count().filter("count > 2")
    found = counts.orderBy(F.desc("count"), "hash").limit(COMMON).collect()
    hashes = np.array([r["hash"] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["count"] for r in found], dtype=np.int64)[order]


def _prefixes(rows: DataFrame, shingle: int, bound: Fraction) -> DataFrame:
    """(id, n, same, prefix, sketch): size and digest of each set, its first shingles, rare ones first, and its parity sketch."""
    frequent, counts = _frequent(rows, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, same, prefixes, sketches = [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), shingle)
                rank = np.zeros(len(own), dtype=np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    rank = np.where(frequent[at] == own, counts[at], 0)
                least = -(-bound.numerator * len(own) // bound.denominator)
                sizes.append(len(own)), same.append(xxhash.xxh3_128_digest(own.tobytes())), sketches.append(parity_sketch(own))
                prefixes.append(own[np.lexsort((own, rank))[: len(own) - least + 1]].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefixes, sketches)]
            columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(same, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "same", "prefix", "sketch"])

    return rows.select("id", "text").mapInArrow(run, "id long, n int, same binary, prefix array<long>, sketch array<long>")


def _possible(a: str, b: str, bound: Fraction) -> Column:
    """Whether sizes ``n`` and places ``pos`` of the first common shingle leave room for the bound."""
    p, q = bound.numerator, bound.denominator
    both = F.lit(1) + F.least(F.expr(f"{a}.n - {a}.pos - 1"), F.expr(f"{b}.n - {b}.pos - 1"))
    return both * (p + q) >= F.expr(f"{p} * ({a}.n + {b}.n)")


def _short(bound: Fraction) -> Column:
    """Whether the shingle lies in the short prefix. Of a pair that reaches the bound the smaller set (of equal ones both) has its first common shingle there."""
    p, q = bound.numerator, bound.denominator
    return F.col("pos") * (p + q) <= F.col("n") * (q - p)


def _shared(keys: DataFrame, bound: Fraction) -> DataFrame:
    """The rows of ``keys`` (id, n, pos, key) that have a possible partner at their key as far as sizes and places tell, with ``short``.

    A row beyond its short prefix meets short rows of smaller sets only, so it goes if even the smallest of them leaves no room for the bound.
    Of keys that then hold the same rows only the first in the order of all shingles stays: a pair's first common shingle is the first of all keys that hold both.
    """
    p, q = bound.numerator, bound.denominator
    by_key = Window.partitionBy("key")
    marked = keys.withColumn("short", _short(bound)).withColumn("_least", F.min(F.when(F.col("short"), F.col("n"))).over(by_key))
    room = (F.col("n") - F.col("pos")) * (p + q) >= (F.col("n") + F.col("_least")) * p
    left = marked.filter(F.col("short") | ((F.col("_least") <= F.col("n")) & room))
    left = left.withColumn("_many", F.count("*").over(by_key))
    digests = [F.bit_xor(F.xxhash64("id", F.lit(seed))).over(by_key) for seed in (0, 1)]
    alike = left.withColumns({"_one": digests[0], "_two": digests[1]}).filter("_many > 1")
    first = alike.groupBy("id", "_many", "_one", "_two").agg(F.min(F.struct("pos", "key", "n", "short")).alias("_first"))
    return first.select("id", "_first.n", "_first.pos", "_first.key", "_first.short")


def _open(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key lies in several components ``c``, with ``share``: pairs of different ones per row of the key."""
    by_key, by_part = Window.partitionBy("key"), Window.partitionBy("key", "c")
    # A pair has a short end at least, so a key of n rows, s of them short, has s * n - s * s / 2 of them.
    own = F.when(F.col("short"), F.count("*").over(by_part) - F.count_if("short").over(by_part) / 2)
    keys = keys.withColumn("_own", own)
    n, short = F.count("*").over(by_key), F.count_if("short").over(by_key).cast("double")
    keys = keys.withColumns({"_low": F.min("c").over(by_key), "_high": F.max("c").over(by_key), "_n": n, "_s": short, "_in": F.sum("_own").over(by_key)})
    several = keys.filter("_low < _high AND _s > 0").withColumn("share", F.expr("(_s * _n - _s * _s / 2 - _in) / _n"))
    return several.drop("_low", "_high", "_n", "_s", "_in", "_own")


def _near(a: str, b: str, bound: Fraction) -> Column:
    """Whether sizes ``n`` and sketches ``sketch`` leave room for the bound."""
    p, q = bound.numerator, bound.denominator
    apart = " + ".join(f"bit_count({a}.sketch[{i}] ^ {b}.sketch[{i}])" for i in range(SKETCH_LONGS))
    return F.expr(f"({apart}) * {p + q} <= ({a}.n + {b}.n) * {q - p}")


def _close(pairs: DataFrame, sets: DataFrame, bound: Fraction) -> DataFrame:
    """The pairs (a, b) without those whose sketches show that their sets cannot reach the bound."""
    x, y = (sets.select(F.col("id").alias(end), F.struct("n", "sketch").alias(f"s{end}")) for end in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").filter(_near("sa", "sb", bound)).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, bound: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets reach the bound."""
    pairs = written(pairs.distinct(), "close-candidates")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = written(_sets(rows.join(small(ids, "candidate-ids"), "id", "left_semi"), shingle), "shingles")
    x, y = (sets.select(F.col("id").alias(end), F.col("hashes").alias(f"h{end}")) for end in ("a", "b"))
    met = pairs.join(x, "a").join(y, "b").withColumn("_both", F.size(F.array_intersect("ha", "hb")))
    reach = F.col("_both") * bound.denominator >= (F.size("ha") + F.size("hb") - F.col("_both")) * bound.numerator
    links = written(met.filter(reach).select("a", "b"), "links")
    for done in (sets, pairs):
        discard(done)
    return links


def later_copies(rows: DataFrame, shingle: int, similarity: float, max_bits: int | None = None) -> DataFrame:
    """(id): all but the smallest id of each group of ``rows`` (id, text) linked by a Jaccard similarity of ``similarity`` or more.

    ``rows`` must be a stored table. Equal sets are collapsed first. With ``max_bits`` the groups of fingerprints
    that link within so many bits come next: each row meets the first of its group, verified like any pair. Rows that no
    other row at their prefix shingle can reach, by sizes and places, are left out. A shingle with few pairs
    has all of them listed and is settled. While the pairs at a shingle are many, its rows only meet leaders;
    what these rounds link needs no further comparison, so a large group costs rows and not pairs, and a round
    looks only at shingles that the one before left open. All pairs of different components
    that are left are then listed and verified, so no link is missed and none is taken unverified.
    """
    bound = Fraction(str(similarity))
    rows = rows.select("id", text_of().alias("text"))
    sets = written(_prefixes(rows, shingle, bound), "prefixes")
    firsts = sets.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("_many")).filter("_many > 1")
    equal = written(sets.select("id", "same").join(firsts, "same").filter("id != first").select("id"), "equal-sets")
    single = sets.join(small(equal, "equal-ids"), "id", "left_anti")
    keys = single.select("id", "n", F.posexplode("prefix").alias("pos", "key"))
    open_ = written(_shared(keys, bound), "prefix-keys")
    found, parts, limit, before = None, None, None, math.inf
    if max_bits is not None:
        groups = simhash_groups(rows.join(single.select("id"), "id", "left_semi"), shingle, max_bits, "id")
        near = groups.filter("id != component_id").select(F.col("component_id").alias("a"), F.col("id").alias("b"))
        found = _verified(_close(near, sets, bound), rows, shingle, bound)
        parts = written(connected(found), "parts")
    for turn in range(ROUNDS + 1):
        # Components only grow, so a key that one of them holds alone stays settled and is not looked at again.
        live = open_.withColumn("c", F.col("id"))
        if parts is not None:
            live = open_.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
        live = written(_open(live.select("key", "id", "n", "pos", "short", "c")), "open-keys")
        discard(open_)
        many = F.col("share") > LISTED
        open_ = live.filter(many).drop("c", "share")
        n, cross = live.agg(F.count("*"), F.sum("share")).first()
        if not n:
            break
        # Few pairs are listed as they are, and so are those that leaders hardly lower any more.
        limit = LISTED * n if limit is None else limit
        last = turn == ROUNDS or cross <= limit or cross > STALLED * before
        before = cross
        # Sketches judge a pair where it meets, so only pairs that they leave room for become rows.
        listed = (live if last else live.filter(~many)).join(sets.select("id", "sketch"), "id")
        x, y = listed.filter("short").alias("x"), listed.alias("y")
        met = x.join(y, F.expr("x.key = y.key AND x.c != y.c AND (x.id < y.id OR NOT y.short)") & _possible("x", "y", bound) & _near("x", "y", bound))
        if not last:
            drawn = F.xxhash64("id", F.pmod("key", F.lit(LEADERS)), F.lit(turn))
            leader = F.min(F.when(F.col("short"), F.struct(drawn, "id", "n", "pos", "c"))).over(Window.partitionBy("key"))
            led = live.filter(many).select(F.struct("id", "n", "pos", "c").alias("x"), leader.alias("y"))
            led = led.filter("x.c != y.c").filter(_possible("x", "y", bound))
        ends = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
        pairs = met.select(*ends) if last else met.select(*ends).unionByName(_close(led.select(*ends).distinct(), sets, bound))
        links = _verified(pairs, rows, shingle, bound)
        found = links if found is None else found.unionByName(links)
        parts = written(connected(found), "parts")
        if last:
            break
    if parts is not None:
        equal = equal.unionByName(parts.filter("node != component").select(F.col("node").alias("id")))
    later = written(equal, "later")
    discard(sets)
    discard(open_)
    return later
