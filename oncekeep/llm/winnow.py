"""Finding repeated windows of fixed length: content-chosen anchors, shuffled once.

Both substring operators look for windows (of words or of bytes) that occur again. Shuffling every
window would move the corpus many times over. Instead each window names its anchor, the leftmost
least hashed gram inside it. Equal windows have equal anchors at equal places, so it is enough to
compare windows with one anchor; neighbouring windows mostly share theirs and travel as one run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of, written

# Units hashed at a time; longer documents are taken in overlapping pieces.
CHUNK = 1_000_000

_RANDOM = np.random.default_rng(20240229)
_TABLES = _RANDOM.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
_FACTORS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_INVERSES = [pow(f, -1, 2**64) for f in _FACTORS]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(which: int, n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n - 1 of a hash factor or its inverse, modulo 2**64; kept by the worker."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 4096), (_INVERSES if inverse else _FACTORS)[which], dtype=np.uint64)
        steps[0] = 1
        have = _powers[which, inverse] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any span of a sequence of 64-bit values, each in constant time."""

    def __init__(self, values: np.ndarray, which: int) -> None:
        self.which = which
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _power(which, len(values), False), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _power(self.which, len(self.sums), True)[start]


def byte_values(data: np.ndarray, which: int) -> np.ndarray:
    return _TABLES[which][data]


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in each stretch of ``width``."""
    low, at, step = values, np.arange(len(values)), 1
    while 2 * step <= width:
        take = low[step:] < low[:-step]
        low, at = np.where(take, low[step:], low[:-step]), np.where(take, at[step:], at[:-step])
        step *= 2
    if step < width:
        gap = width - step
        take = low[gap:] < low[:-gap]
        at = np.where(take, at[gap:], at[:-gap])
    return at


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` units whose anchors are grams of ``gram`` units."""

    length: int
    gram: int


def runs(values: tuple[np.ndarray, np.ndarray], lengths: np.ndarray, windows: Windows) -> tuple[np.ndarray, ...]:
    """(anchor, context, first window, windows, anchor offset) of each run in a row of segments.

    ``values`` are two independent hashes of every unit. The context hash covers all units of the
    run's windows, so that equal anchor and context mean equal runs.
    """
    n, empty = len(values[0]), np.zeros(0, dtype=np.int64)
    if n < windows.length:
        return (empty.astype(np.uint64),) * 2 + (empty,) * 3
    one, two = Rolling(values[0], 0), Rolling(values[1], 1)
    starts = np.arange(n - windows.gram + 1)
    grams = mix(one(starts, starts + windows.gram))
    least = _leftmost_least(grams, windows.length - windows.gram + 1)
    ends = np.repeat(np.cumsum(lengths), lengths)  # of each unit's segment
    valid = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= windows.length)
    if not len(valid):
        return (empty.astype(np.uint64),) * 2 + (empty,) * 3
    anchor = least[valid]
    first = np.append(True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1))
    at = np.flatnonzero(first)
    a, p, count = valid[at], anchor[at], np.diff(np.append(at, len(valid)))
    shape = (count * 1024 + (p - a)).astype(np.uint64)
    context = mix(two(a, a + count + windows.length - 1) ^ mix(shape))
    return grams[p], context, a, count, p - a


def pack_run(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run's first window and number of windows in one long."""
    return (first.astype(np.int64) << 16) | count


def unpack_run(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> 16, packed & 0xFFFF


# Kinds of rows: a run to be looked up, a run known to be repeated, a run whose content is asked for.
LOOK, COVER, ASK = 0, 1, 2
RUN_COLUMNS = ["kind", "anchor", "context", "doc_id", "row", "run"]
RUN_SCHEMA = "kind byte, anchor long, context long, doc_id long, row long, run long"


def rows_of(docs: DataFrame, number: str) -> DataFrame:
    """(row, doc_id, text) of a stored table whose column ``number`` names each row."""
    return docs.select(F.col(number).alias("row"), F.col("doc_id").cast("long"), text_of().alias("text"))


def _batch(columns: list[np.ndarray], ids: pa.Array) -> pa.RecordBatch:
    kind, anchor, context, row, run = columns
    arrays = [pa.array(kind, pa.int8()), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), ids, pa.array(row), pa.array(run)]
    return pa.RecordBatch.from_arrays(arrays, names=RUN_COLUMNS)


def collect_runs(rows: DataFrame, windows: Windows, units: Callable, keep_first: bool) -> DataFrame:
    """Runs of all documents. ``units(text)`` yields (first unit, two hashes per unit) pieces of a text.

    Equal runs that meet in one chunk are settled at once: all but the first in (doc_id, row, place)
    are covered, without ``keep_first`` the first too; only the first is looked up further on, so a
    large group of copies is collapsed before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(_order_key(batch.column(1)), kind="stable")
            held, size = [], 0
            for i in order:
                for start, one, two in units(batch.column(2)[int(i)].as_py()):
                    held.append((int(i), start, one, two))
                    size += len(one)
                    if size >= CHUNK:
                        yield from settle(batch, held)
                        held, size = [], 0
            if held:
                yield from settle(batch, held)

    def settle(batch: pa.RecordBatch, held: list) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(h[2]) for h in held])
        values = (np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
        anchor, context, a, count, _ = runs(values, lengths, windows)
        if not len(a):
            return
        of = np.searchsorted(np.cumsum(lengths), a, "right")
        begin = np.cumsum(lengths) - lengths
        first = a - begin[of] + np.array([h[1] for h in held])[of]
        source = np.array([h[0] for h in held])[of]
        # Rows come in order, so the first of equal ones is the earliest.
        order = np.lexsort((np.arange(len(a)), context, anchor))
        same = np.append(False, (anchor[order][1:] == anchor[order][:-1]) & (context[order][1:] == context[order][:-1]))
        again = np.zeros(len(a), dtype=bool)
        again[order] = same
        covered = again.copy()
        if not keep_first:
            covered[order[:-1][same[1:]]] = True
        packed, row = pack_run(first, count), batch.column(0).to_numpy(zero_copy_only=False)[source]
        for kind, which in ((LOOK, ~again), (COVER, covered)):
            at = np.flatnonzero(which)
            if len(at):
                # What is settled goes to any task.
                key = anchor[at] if kind == LOOK else mix(packed[at].view(np.uint64) + row[at].view(np.uint64))
                columns = [np.full(len(at), kind, np.int8), key, context[at], row[at], packed[at]]
                yield _batch(columns, batch.column(1).take(pa.array(source[at])))

    return rows.select("row", "doc_id", "text").mapInArrow(run, RUN_SCHEMA)


def _order_key(ids: pa.Array) -> np.ndarray:
    """Ids in Spark's order: nulls first."""
    lowest = np.iinfo(np.int64).min
    return ids.fill_null(lowest).to_numpy(zero_copy_only=False)


def match_runs(found: DataFrame, keep_first: bool) -> DataFrame:
    """COVER rows for runs that occur again as a whole, ASK rows for one run of each context where an anchor has several.

    With ``keep_first`` the first occurrence of a run is not covered. One shuffle and one sort by
    anchor serve all windows; what a large group needs beyond memory is spilled by Spark.
    """
    order = ["anchor", "context", "doc_id", "row", "run"]
    rows = found.repartition("anchor").sortWithinPartitions(*order)
    by_anchor, by_context = Window.partitionBy("anchor"), Window.partitionBy("anchor", "context")
    ordered = by_context.orderBy("doc_id", "row", "run")
    rows = rows.withColumns({"_least": F.min("context").over(by_anchor), "_most": F.max("context").over(by_anchor)})
    rows = rows.withColumns({"_nth": F.row_number().over(ordered), "_next": F.lead("row").over(ordered)})
    again = F.col("_nth") > 1 if keep_first else (F.col("_nth") > 1) | F.col("_next").isNotNull()
    asked = (F.col("_nth") == 1) & (F.col("_least") != F.col("_most")) & (F.col("kind") == LOOK)
    kinds = F.array_compact(F.array(F.when((F.col("kind") == COVER) | again, F.lit(COVER)), F.when(asked, F.lit(ASK))))
    rows = rows.filter((F.col("kind") == COVER) | again | asked)
    return rows.select(F.explode(kinds.cast("array<byte>")).alias("kind"), "anchor", "doc_id", "row", "run")


def contents(asked: DataFrame, rows: DataFrame, cut: Callable) -> DataFrame:
    """(anchor, doc_id, row, run, content) of the runs asked for; ``cut(text)`` gives ``content(first, windows)``."""
    wanted = asked.groupBy("row").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("run").alias("runs"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, row_ids = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for i, (anchors, packed) in enumerate(zip(batch.column("anchors").to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                content = cut(batch.column("text")[i].as_py())
                for anchor, run in zip(anchors, packed, strict=True):
                    for column, value in zip(out, (anchor, doc_ids[i], row_ids[i], run, content(run >> 16, run & 0xFFFF)), strict=True):
                        column.append(value)
                if len(out[0]) > 50_000:
                    yield _contents(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _contents(out)

    joined = wanted.join(rows, "row").select("doc_id", "row", "text", "anchors", "runs")
    return joined.mapInArrow(extract, "anchor long, doc_id long, row long, run long, content binary")


def _contents(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["anchor", "doc_id", "row", "run", "content"])


def by_shard(contents_: DataFrame, repeated: Callable, shard_bytes: int) -> DataFrame:
    """(row, run) of repeated windows; ``repeated(groups)`` gets the contents of whole anchors, in order.

    It returns a flag for each window of each content. Anchors are put together into shards of
    about ``shard_bytes``; an anchor is never cut, as its contents must meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_anchors(batches, shard_bytes):
            runs_ = rows.column("run").to_numpy(zero_copy_only=False)
            first, count = unpack_run(runs_)
            ids = rows.column("row").to_numpy(zero_copy_only=False)
            groups = np.unique(rows.column("anchor").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            flags = repeated(rows.column("content").to_pylist(), groups, count)
            flat = np.concatenate([np.append(f, False) for f in flags]) if flags else np.zeros(0, bool)
            edges = np.diff(np.concatenate([[0], flat.astype(np.int8), [0]]))
            begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            offsets = np.cumsum(count + 1) - (count + 1)
            of = np.searchsorted(offsets, begin, "right") - 1
            if len(of):
                packed = pack_run(first[of] + begin - offsets[of], end - begin)
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(packed)], names=["row", "run"])

    sorted_ = contents_.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "row", "run")
    return sorted_.mapInArrow(run, "row long, run long")


def _whole_anchors(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.Table]:
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        while table.num_rows:
            sizes = np.cumsum([len(x) for x in table.column("content").to_pylist()])
            have = sum(t.nbytes for t in held)
            anchors = table.column("anchor").to_numpy()
            full = int(np.searchsorted(sizes, max(shard_bytes - have, 0)))
            # the first row at or after the limit whose anchor is new
            last = held[-1].column("anchor")[-1].as_py() if held else None
            before = np.append(last if last is not None else anchors[0] ^ 1, anchors[:-1])
            edge = np.flatnonzero(anchors[full:] != before[full:])
            edge = [int(x) + full for x in edge if x + full > 0 or held]
            if not edge or (edge[0] == 0 and not held):
                held.append(table)
                break
            if edge[0]:
                held.append(table.slice(0, edge[0]))
            yield pa.concat_tables(held).combine_chunks()
            held, table = [], table.slice(edge[0])
    if held:
        yield pa.concat_tables(held).combine_chunks()


def covered_runs(rows: DataFrame, windows: Windows, units: Callable, cut: Callable, repeated: Callable, keep_first: bool, shard_bytes: int) -> DataFrame:
    """(row, runs): for each of the stored ``rows_of`` a table with repeated windows, its covered runs of windows."""
    found = written(match_runs(collect_runs(rows, windows, units, keep_first), keep_first), "runs")
    wanted = contents(found.filter(F.col("kind") == ASK), rows, cut)
    more = by_shard(wanted, repeated, shard_bytes)
    covered = found.filter(F.col("kind") == COVER).select("row", "run").unionByName(more)
    return written(covered.groupBy("row").agg(F.collect_list("run").alias("runs")), "covered")


def covered_units(packed: list[int] | None, length: int, n: int) -> np.ndarray:
    """Flags of the ``n`` units that lie in a covered window."""
    if not packed:
        return np.zeros(n, dtype=bool)
    first, count = unpack_run(np.array(packed, dtype=np.int64))
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + count + length - 1, -1)
    return np.cumsum(edges[:-1]) > 0
