"""Near-duplicate embeddings by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.skew import small
from ..session import discard
from .common import written
from .components import connected

TREES = 6
# Vectors per leaf that trees aim at; a leaf that cannot be split usefully may hold more.
LEAF = 256
# Vectors of one node on which a round fits its splits; every vector is then routed by them.
SAMPLE = 4096
# Levels that one round adds to a node.
LEVELS = 6
# Half the width of the spill zone in standard deviations of the projected distance at the threshold.
SPILL = 0.5
# A split is useful if neither side keeps more than this share of a node, and both sides together not more than that.
USEFUL_SIDE, USEFUL_SUM = 0.9, 1.4
# Directions tried for a node before it is left whole.
TURNS = 4
# Vectors of one leaf that a task compares; larger leaves are cut into blocks and each pair of blocks is a share.
BLOCK = 10_000
# Pairs compared in one numpy step.
TILE = 1_000_000
# Vectors that a task routes in one step.
ROUTED = 2048


def _direction(tree: int, path: str, turn: int, size: int) -> np.ndarray:
    """A random unit direction of a tree node; it depends on the node's name and the turn only."""
    seed = [tree, size, turn, *path.encode()]
    x = np.random.default_rng(seed).standard_normal(size)
    return x / np.linalg.norm(x)


def _margin(threshold: float, size: int) -> float:
    return SPILL * np.sqrt(max(2 - 2 * threshold, 0.0) / size)


def _units(column: pd.Series | list[bytes], size: int) -> np.ndarray:
    """Unit vectors: stored as doubles, or as the floats of the table, which are scaled here."""
    packed = b"".join(column)
    kind = len(packed) // (len(column) * size)
    x = np.frombuffer(packed, dtype=f"<f{kind}").reshape(-1, size)
    return _scaled(x) if kind == 4 else x


def _scaled(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` as unit vectors of doubles; a row that has none holds non-finite numbers."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cut(x: np.ndarray, margin: float) -> float:
    """Between the third and seventh tenth, the cut with the fewest values in its spill zone, of equal ones the middlemost."""
    x = np.sort(x)
    cuts = np.quantile(x, np.linspace(0.3, 0.7, 41))
    spilled = np.searchsorted(x, cuts + margin, "right") - np.searchsorted(x, cuts - margin, "left")
    return float(cuts[np.lexsort((np.abs(np.arange(41) - 20), spilled))[0]])


def _fit(tree: int, path: str, size: int, total: int, sample: np.ndarray, margin: float) -> list[tuple[str, int, float]]:
    """(path, turn, cut) of the splits below a node, from its sample, until leaves are small or no turn is useful.

    A cut through a dense group would send most of it to both sides again and again; cuts look
    for thin places, and a node that has none stays whole.
    """
    splits, open_ = [], [(path, np.arange(len(sample)))]
    per_row = total / max(len(sample), 1)
    for _ in range(LEVELS):
        below = []
        for at, rows in open_:
            if len(rows) * per_row <= LEAF or len(rows) < 8:
                continue
            for turn in range(TURNS):
                x = sample[rows] @ _direction(tree, at, turn, size)
                cut = _cut(x, margin)
                left, right = rows[x <= cut + margin], rows[x >= cut - margin]
                if max(len(left), len(right)) <= USEFUL_SIDE * len(rows) and len(left) + len(right) <= USEFUL_SUM * len(rows):
                    splits.append((at, turn, cut))
                    below += [(at + "0", left), (at + "1", right)]
                    break
        open_ = below
    return splits


_SPLIT = np.dtype([("at", "<i4"), ("turn", "i1"), ("cut", "<f8")])


def _pack_splits(path: str, splits: list[tuple[str, int, float]]) -> bytes:
    """The splits below ``path`` in a few bytes each, as every row of the node carries them; a place is its bits behind a leading one."""
    return np.array([(int("1" + at[len(path) :], 2), turn, cut) for at, turn, cut in splits], dtype=_SPLIT).tobytes()


def _unpack_splits(path: str, packed: bytes) -> dict[str, tuple[int, float]]:
    return {path + f"{at:b}"[1:]: (turn, cut) for at, turn, cut in np.frombuffer(packed, dtype=_SPLIT).tolist()}


def _routed(rows: pa.RecordBatch, size: int, tree: int, path: str, threshold: float) -> pa.RecordBatch:
    """The rows of one node in the nodes below it that its splits lead to."""
    cuts = _unpack_splits(path, rows.column("splits")[0].as_py())
    units, margin = _units(rows.column("unit").to_pylist(), size), _margin(threshold, size)
    open_, taken, paths = [(path, np.arange(rows.num_rows))], [], []
    while open_:
        at, own = open_.pop()
        if not len(own):
            continue
        if at in cuts:
            turn, cut = cuts[at]
            x = units[own] @ _direction(tree, at, turn, size)
            open_ += [(at + "0", own[x <= cut + margin]), (at + "1", own[x >= cut - margin])]
        else:
            taken.append(own)
            paths += [at] * len(own)
    moved = rows.select(["node", "size", "tree"]).take(pa.array(np.concatenate(taken)))
    # A node that its own round could not split stays as it is.
    columns = [*moved.columns, pa.array(paths, pa.string()), pa.array([at == path for at in paths], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=[*moved.schema.names, "path", "done"])


def _shuffled(table: DataFrame) -> DataFrame:
    """For joins on what grows with the vectors: stored places and lists of leaves pack so well that by the size
    of their files Spark would send them through the driver."""
    return table.hint("merge")


def _split_round(rows: DataFrame, units: DataFrame, threshold: float) -> tuple[DataFrame, bool]:
    """Route the vectors of every node with more than ``LEAF`` of them further down; False if there is none.

    ``rows`` (stored) has a place of a vector in a tree per row and no vectors; these are joined where they are needed.
    """
    node = ["size", "tree", "path"]
    counts = written(rows.filter("NOT done").groupBy(*node).agg(F.count("*").alias("total")).filter(F.col("total") > LEAF), "rp-nodes")
    if counts.isEmpty():
        discard(counts)
        return rows, False
    open_ = rows.filter("NOT done").join(counts, node)
    vectors = units.select("node", "unit")
    # Only ranks up to SAMPLE are kept, so Spark cuts each task's share of a node before the shuffle.
    by_hash = Window.partitionBy(*node).orderBy(F.xxhash64("node", "tree"), "node")
    sample = open_.withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= SAMPLE)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        size, tree, path = int(key[0]), int(key[1]), str(key[2])
        splits = _fit(tree, path, size, int(frame["total"].iloc[0]), _units(frame["unit"], size), _margin(threshold, size))
        return pd.DataFrame({"size": [size], "tree": [tree], "path": [path], "splits": [_pack_splits(path, splits)]})

    model = sample.join(_shuffled(vectors), "node").groupBy(*node).applyInPandas(fit, "size int, tree int, path string, splits binary")
    model = written(model, "rp-splits")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROUTED):
                part = batch.slice(at, ROUTED)
                size, tree = (part.column(c).to_numpy() for c in ("size", "tree"))
                paths = part.column("path").to_pylist()
                edges = [i for i in range(1, len(paths)) if (size[i], tree[i], paths[i]) != (size[i - 1], tree[i - 1], paths[i - 1])]
                for a, b in zip([0, *edges], [*edges, len(paths)], strict=True):
                    yield _routed(part.slice(a, b - a), int(size[a]), int(tree[a]), paths[a], threshold)

    schema = "node long, size int, tree int, path string, done boolean"
    # Sorted, so that a batch holds few nodes.
    moved = open_.join(model, node).drop("total").join(_shuffled(vectors), "node").sortWithinPartitions(*node)
    moved = moved.select("node", "size", "tree", "unit", "path", "splits").mapInArrow(route, schema)
    rest = rows.join(counts.select(*node), node, "left_anti").unionByName(rows.filter("done").join(counts.select(*node), node))
    after = written(rest.unionByName(moved.select(*rest.columns)), "rp-rows")
    for done in (rows, counts, model):
        discard(done)
    return after, True


def _compare_leaf(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """For each vector of a leaf: the vectors it newly links with here, and a star of edges that joins what is linked.

    A pair may meet in several leaves; it is counted in the smallest of them only, which both of
    its vectors know from their leaf lists.
    """
    size, leaf = int(frame["size"].iloc[0]), int(frame["leaf"].iloc[0])
    block, across = frame["own"].to_numpy(), frame["x"].iloc[0] != frame["y"].iloc[0]
    units, n, nodes = _units(frame["unit"], size), frame["n"].to_numpy(), frame["node"].to_numpy()
    lower = [[x for x in leaves if x < leaf] for leaves in frame["leaves"]]
    names = {x: i for i, x in enumerate(dict.fromkeys(x for own in lower for x in own))}
    member = np.zeros((len(frame), max(len(names), 1)), dtype=np.float32)
    for i, own in enumerate(lower):
        member[i, [names[x] for x in own]] = 1
    links, label = np.zeros(len(frame), dtype=np.int64), np.arange(len(frame))
    changed, counted, step = True, False, max(1, TILE // len(frame))
    while changed:
        changed = False
        for a in range(0, len(frame), step):
            near = units[a : a + step] @ units.T >= threshold
            near[np.arange(len(near)), a + np.arange(len(near))] = False
            if across:
                near &= block[a : a + step, None] != block[None, :]
            if not counted:
                links[a : a + step] = (near & (member[a : a + step] @ member.T == 0)) @ n
            low = np.minimum(np.where(near, label[None, :], len(frame)).min(axis=1), label[a : a + step])
            changed |= bool((low < label[a : a + step]).any())
            label[a : a + step] = low
        counted = True
        label = label[label]
    return pd.DataFrame({"node": nodes, "root": nodes[label], "links": links})


def _leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole leaves, or pairs of their blocks, from batches that are sorted so."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame[["leaf", "x", "y"]].iloc[-1]
        ended = (frame[["leaf", "x", "y"]] != last).any(axis=1)
        for _, own in frame[ended].groupby(["leaf", "x", "y"], sort=False):
            yield own
        held = frame[~ended]
    if held is not None and len(held):
        yield held


def _unit_column(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors that can link, packed: floats of the table as they are (``kind`` <f4), else unit vectors of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, sizes = [], []
            for value in batch.column(2):
                x = np.array([np.nan if v is None else v for v in value.as_py() or []], dtype=np.float64)
                unit = _scaled(x[None, :])[0] if len(x) else x
                good = len(x) and np.isfinite(x).all() and np.isfinite(unit).all()
                units.append((x if kind == "<f4" else unit).astype(kind).tobytes() if good else None), sizes.append(len(x))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "size", "unit"])

    return run


def link_embeddings(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", trees: int = TREES) -> DataFrame:
    """(key, n_links, component_id, kept): vectors link at a cosine of ``threshold`` or more, in double precision.

    Equal vectors are collapsed first and counted. Each tree splits a node at the median of a
    random projection; vectors near the cut go to both sides. Rounds fit the splits of all large
    nodes on bounded samples and route every vector, until leaves are small or their vectors lie
    too close to be parted. Inside leaves all vectors are compared, so every link found is exact;
    links are counted, and only a star of edges per leaf leaves it. Links that no tree brings
    together are missed; the tests measure the recall against brute force.

    ``kept`` is true for the smallest key of a component. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, and neither do vectors of different
    length. Repeated rows are copies that link. A null key never becomes a component id unless
    its component has no other, and is not kept unless alone. Other columns of ``vectors`` are
    left out. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(key), F.col(vector).alias("_v"))
    groups = rows.filter("_v IS NOT NULL").groupBy("_v").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "rp-vectors")
    kind = "<f4" if isinstance(rows.schema["_v"].dataType.elementType, T.FloatType) else "<f8"
    units = groups.select("node", "n", "_v").mapInArrow(_unit_column(kind), "node long, n long, size int, unit binary")
    units = written(units.filter("unit IS NOT NULL"), "rp-units")

    spread = units.select("node", "size", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"))
    places, more = written(spread.withColumns({"path": F.lit(""), "done": F.lit(False)}), "rp-rows"), True
    while more:
        places, more = _split_round(places, units, threshold)
    placed = places.select("node", F.xxhash64("size", "tree", "path").alias("leaf"))
    known = placed.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for leaf in _leaves(frames):
            if len(leaf) > 1:
                yield _compare_leaf(leaf, threshold)

    large = placed.groupBy("leaf").count().filter(F.col("count") > BLOCK)
    large = small(large.select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("_n")), "rp-large")
    spread = placed.join(_shuffled(known), "node").join(_shuffled(units), "node").join(large, "leaf", "left").withColumn("own", F.expr("pmod(xxhash64(node, 3), coalesce(_n, 1))"))
    spread = spread.withColumn("_other", F.explode(F.expr("sequence(0, coalesce(_n, 1) - 1)")))
    share = ["leaf", "x", "y"]
    spread = spread.withColumns({"x": F.least("own", "_other"), "y": F.greatest("own", "_other")})
    spread = spread.select(*share, "own", "node", "n", "size", "unit", "leaves")
    sorted_ = spread.repartition(*share).sortWithinPartitions(*share, "node")
    found = sorted_.mapInPandas(compare, "node long, root long, links long").filter("links > 0 OR node != root")
    found = written(found, "rp-found")
    parts = connected(found.filter("node != root"), "node", "root")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))

    of = groups.select("node", "_v", "first", "n").join(_shuffled(units.select("node", F.lit(True).alias("good"))), "node", "left")
    of = of.join(_shuffled(linked), "node", "left").join(_shuffled(parts), "node", "left")
    of = of.select("_v", "first", "n", "good", F.coalesce("component", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    of = written(of.filter("good"), "rp-groups")
    for done in (groups, units, places, found):
        discard(done)
    least = of.groupBy("root").agg(F.min("first").alias("_least"))
    of = of.join(_shuffled(least), "root").select("_v", (F.col("links") + F.col("n") - 1).alias("_links"), "_least")
    out = rows.join(_shuffled(of), "_v", "left")
    component = F.when(F.col("_links").isNull(), F.col(key)).otherwise(F.col("_least"))
    return out.select(
        key, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept")
    )
