"""Two building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# A table of at most this many rows is broadcast; the row count is checked, not assumed.
BROADCAST_ROWS = 200_000
# At most this many keys can each hold more than 1/MAX_HEAVY of all rows.
MAX_HEAVY = 2_000
# A key with more rows than this is too much for one task, however large the table is.
TASK_ROWS = 5_000_000


def attach(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left-join ``table`` (unique on ``keys``, already written) to ``rows``.

    ``weight`` counts how many of the ``total`` rows carry each key. A small table is broadcast.
    Otherwise only the keys above ``total / MAX_HEAVY`` or ``TASK_ROWS`` are, so no shuffle
    partition receives a heavy key. A key needs ``total / BROADCAST_ROWS`` rows to count, so
    there cannot be more than ``BROADCAST_ROWS`` of them.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, "left")
    is_heavy = F.col(weight) > max(min(total // MAX_HEAVY, TASK_ROWS), total // max(BROADCAST_ROWS, MAX_HEAVY), 1)
    heavy, light = table.filter(is_heavy), table.filter(~is_heavy)
    hot = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti").join(light, keys, "left")
    return hot.unionByName(rest)


def small(table: DataFrame, label: str) -> DataFrame:
    """Write a summary table; hint a broadcast only if its row count is low enough."""
    stored = written(table, label)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def with_positions(
    df: DataFrame,
    group: list[str],
    order: list[str],
    name: str = "pos",
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """1-based position of each row inside its group, without a task per group.

    Rows are range-partitioned over (group, order), so one group may span many partitions;
    the position is the row's place in its partition plus the group's rows in earlier ones.
    ``finish`` runs on the evenly spread rows before they are written.
    """
    keys = [F.col(c) for c in (*group, *order)]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    placed = placed if finish is None else finish(placed)
    placed = written(placed, "placed").withColumn("_part", F.shiftright("_slot", 33))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy(*group, "_part")
        .agg(F.min("_slot").alias("_first"), F.count("*").alias("_n"))
        .select(*group, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    )
    joined = placed.join(small(runs, "runs"), [*group, "_part"])
    return joined.withColumn(name, F.col("_slot") + F.col("_shift")).drop("_slot", "_part", "_shift")
