"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import small
from .common import text_of, written
from .components import connected

BITS = 64
# Fingerprints on which bit groups and candidate counts are estimated; search covers all of them.
SAMPLE = 2000
# Rows of one key compared by one task; larger keys are cut into blocks, and each pair of blocks is a task's share.
BLOCK = 20_000
# Seconds for one probe, shuffled and sorted, and for one candidate pair, as measured.
PROBE_COST, PAIR_COST = 1e-6, 2e-8
# Pairs compared in one numpy step.
TILE = 1_000_000


def fingerprint_of(text: str, shingle: int) -> int:
    """The fingerprint as an unsigned number; see ``fingerprints``."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest, k = xxhash.xxh64_intdigest, min(shingle, len(words)) - 1
    hashes = np.fromiter((digest(body[a:b], 42) for a, b in zip(starts, ends[k:], strict=False)), dtype="<u8")
    total = 0
    counts = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 65_536)):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` (columns as given, the last one the text) with the text replaced by ``fp``, a signed long.

    A-Z are lowered, words are runs without ASCII white space, shingles of ``shingle`` words are
    joined by spaces and hashed by XXH64 with seed 42, repeats included; a text of fewer words is
    one shingle. A bit is set if it is in more than half of the hashes; without words it is 0.
    """
    *keys, text = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t.as_py() or "", shingle) for t in batch.column(len(keys))], dtype=np.uint64)
            columns = [batch.column(i) for i in range(len(keys))] + [pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "fp"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "fp long"]))


@dataclass(frozen=True)
class Part:
    """A group of bits (by number) and the distance up to which it is probed."""

    bits: tuple[int, ...]
    threshold: int


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(fps: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits that go together on the sample in one group each, so that correlation spoils few groups."""
    x = _bit_matrix(fps).astype(float)
    x -= x.mean(axis=0) if len(x) else 0
    norm = np.sqrt((x * x).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        own = [left.pop(int(np.argmax(corr[np.ix_(left, left)].max(axis=1))))]
        while len(own) < size:
            own.append(left.pop(int(np.argmax(corr[np.ix_(left, own)].sum(axis=1)))))
        groups.append(tuple(sorted(own)))
    return groups


def plan_parts(fps: np.ndarray, n: int, max_bits: int) -> list[Part]:
    """Bit groups and thresholds T with sum(T + 1) = max_bits + 1, of least estimated cost for ``n`` fingerprints.

    By the generalised pigeonhole principle two fingerprints within ``max_bits`` are within T of each
    other on at least one group; a group with T = -1 is not probed. For each number of groups a
    dynamic programme over the groups hands the thresholds out; a choice costs the probes that it
    makes and the candidate pairs that the sample lets expect.
    """
    best, most = None, max_bits + 1
    x = _bit_matrix(fps).astype(np.float32)
    for m in range(1, min(most + 3, 16) + 1):
        groups = bit_groups(fps, m)
        costs = []
        for bits in groups:
            y = x[:, bits]
            far = (y @ (1 - y).T + (1 - y) @ y.T).round().astype(int)
            seen = np.bincount(far[np.triu_indices(len(y), 1)], minlength=len(bits) + 1).cumsum() + 1.0
            share = seen / (len(y) * (len(y) - 1) / 2 + 1.0)
            ball = np.cumsum([math.comb(len(bits), k) for k in range(len(bits) + 1)])
            row = [0.0]
            for t in range(min(max_bits, len(bits)) + 1):
                meet = ball[t // 2]
                row.append(PROBE_COST * n * float(ball[t - t // 2]) + PAIR_COST * float(meet) * share[t] * n * n / 2)
            costs.append(row)
        # table[u]: the least cost of handing out u units so far, and how
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for u, (c, how) in table.items():
                for t, extra in enumerate(row):
                    if u + t <= most and (u + t not in step or c + extra < step[u + t][0]):
                        step[u + t] = (c + extra, (*how, t - 1))
            table = step
        if most in table and (best is None or table[most][0] < best[0]):
            best = (table[most][0], [Part(b, t) for b, t in zip(groups, table[most][1], strict=True) if t >= 0])
    return best[1]


def _probes(fps: np.ndarray, parts: list[Part]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(part, radius, keys): the values of a part within half its threshold, rounded up, of each fingerprint."""
    for p, part in enumerate(parts):
        mask = np.uint64(sum(1 << b for b in part.bits))
        own = fps & mask
        for radius in range(part.threshold - part.threshold // 2 + 1):
            for flips in combinations(part.bits, radius):
                yield p, radius, own ^ np.uint64(sum(1 << b for b in flips))


def _star(fps: np.ndarray, radius: np.ndarray, threshold: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the fingerprints of one key as their links within ``max_bits`` do: each to its smallest."""
    order = np.lexsort((fps, radius))
    fps, radius = fps[order], radius[order]
    label = np.arange(len(fps))
    changed, step = True, max(1, TILE // max(len(fps), 1))
    cut = np.searchsorted(radius, np.arange(threshold + 2))
    while changed:
        changed = False
        for a in range(0, len(fps), step):
            mine = fps[a : a + step]
            # radii of both ends add up to the threshold at most
            upto = cut[max(0, threshold - int(radius[a])) + 1] if threshold - int(radius[a]) >= 0 else 0
            if not upto:
                continue
            near = np.bitwise_count(mine[:, None] ^ fps[None, :upto]) <= max_bits
            low = np.minimum(np.where(near, label[None, :upto], len(fps)).min(axis=1), label[a : a + step])
            back = np.where(near, low[:, None], len(fps)).min(axis=0)
            new = np.minimum(label[:upto], back)
            changed |= bool((low < label[a : a + step]).any() or (new < label[:upto]).any())
            label[:upto] = new
            label[a : a + step] = np.minimum(label[a : a + step], low)
        jump = label[label]
        while (jump != label).any():
            label, jump, changed = jump, jump[jump], True
    keep = label != np.arange(len(fps))
    return fps[keep], fps[label[keep]]


def links(fps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links within ``max_bits``.

    Probes meet on (part, value). Counted keys with more than ``BLOCK`` rows are cut into blocks and
    every pair of blocks is one task's share, so a hot value is spread and no pair is left out.
    """
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    parts = plan_parts(np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64), n, max_bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for p, radius, keys in _probes(own.view(np.uint64), parts):
                columns = [np.full(len(own), p, np.int8), keys.view(np.int64), np.full(len(own), radius, np.int8), own]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "key", "radius", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, radius, found in _runs(batches):
            a, b = _star(found, radius, parts[part].threshold, max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    probes = fps.select("fp").mapInArrow(probe, "part byte, key long, radius byte, fp long")
    counted = probes.groupBy("part", "key").count().filter(F.col("count") > BLOCK)
    hot = small(counted.select("part", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("_n")), "hot-keys")
    marked = probes.join(hot, ["part", "key"], "left")
    keys = ["part", "key", "x", "y"]
    light = marked.filter("_n IS NULL").select("part", "key", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "radius", "fp")
    heavy = marked.filter("_n IS NOT NULL").withColumn("_own", F.expr("pmod(xxhash64(fp, 5), CAST(_n AS long))"))
    heavy = heavy.withColumn("_other", F.explode(F.expr("sequence(0L, _n - 1L)")))
    heavy = heavy.select("part", "key", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), "radius", "fp")
    spread = light.unionByName(heavy)
    sorted_ = spread.repartition(*keys).sortWithinPartitions(*keys, "radius")
    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, radii, fingerprints) of each key with two rows or more, from batches sorted by key."""
    held: list[np.ndarray] = []

    def emit(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        edge = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        starts, ends = np.append(0, edge), np.append(edge, len(rows))
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            yield int(rows[a, 0]), rows[a:b, 4], rows[a:b, 5].view(np.uint64)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], axis=1)
        rows = np.concatenate([*held, rows]) if held else rows
        last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from emit(np.ascontiguousarray(rows[:cut]))
        held = [rows[cut:]]
    if held:
        yield from emit(np.ascontiguousarray(held[0]))


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id): fingerprints link at ``max_bits`` or fewer differing bits.

    ``component_id`` is the smallest key reachable over links, the row's own included. Equal
    fingerprints are collapsed before the search, so groups of copies cost one row there.
    Null and empty texts have fingerprint 0 and link like any other. Null keys stay and never
    become a component id unless the whole group has none. Repeated rows fall into one group.
    Other columns of ``docs`` are left out. An empty table gives an empty result.
    """
    rows = written(fingerprints(docs.select(F.col(key), text_of().alias("text")), shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    n = fps.count()
    if n < 2:
        return rows.join(fps, "fp").select(key, "fp", F.col("first").alias("component_id"))
    parts = connected(links(fps, n, max_bits))
    of = fps.join(parts, fps["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    of = written(of, "roots")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(key, "fp", "component_id")
