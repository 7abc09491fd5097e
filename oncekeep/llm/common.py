"""What the operators share: table access, the word rule, and stored intermediate tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written  # noqa: F401  (re-exported: the one way lineage is cut)

# Words are runs of anything but the six ASCII white-space bytes. On UTF-8 bytes this is exactly
# what ``bytes.split()`` does.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Bits of a row's place in its file, in a row number.
ROW_BITS = 40

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is nothing but a scan of one folder or one file of Parquet."""
    files, read = df.inputFiles(), df.sparkSession.read.schema(df.schema)
    places = {os.path.dirname(f) for f in files} if len(files) != 1 else {files[0], os.path.dirname(files[0])}
    # Spark compares paths as they were given, so a local one is tried without its scheme too.
    given = places | {p.removeprefix("file://") for p in places}
    return len(given) <= 4 and any(df.sameSemantics(read.parquet(p)) for p in given)


def numbered(df: DataFrame, column: str, names: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``names`` only) with a number for each row in ``column`` that holds in every scan.

    A row of a plain scan is numbered by its place: its file, in order of their paths, and its row there.
    Anything else is written once with its numbers: these would follow the splits of a scan, and those follow
    the cores registered at that moment.
    """
    names = names or df.columns
    if not _is_scan(df):
        return written(df.select(*names).withColumn(column, F.monotonically_increasing_id()), "numbered")
    placed = df.select(*names, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    paths = sorted(r[0] for r in placed.select("__file").distinct().collect())
    files = df.sparkSession.createDataFrame([(p, i << ROW_BITS) for i, p in enumerate(paths)], "__file string, __base long").coalesce(1)
    return placed.join(F.broadcast(files), "__file").select(*names, (F.col("__base") + F.col("__at")).alias(column))
