"""Session defaults and the one way the library cuts lineage: a written table."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


# Runtime settings the operators rely on. The hash-join threshold is checked by AQE against the
# measured shuffle: only joins whose every partition is that small stop sorting.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128MB",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Lets the newest-N filter of the snapshot run before its shuffle for any byte cap in use.
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
}

# Shuffle files of a finished query go at once; else they stay until the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# How ``written`` names a folder.
_MADE = re.compile(r"-[0-9a-f]{32}$")


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "oncekeep", master: str | None = None, **conf: object) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; there is no fallback, as a local folder would lose rows."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Everything derived from the result sees the same rows even after an executor is lost,
    and later joins see a plain scan whose size Spark knows.
    """
    path = os.path.join(scratch_dir(df.sparkSession), "tables", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete a table of ``written``, to be called once everything that reads it is stored itself.

    Only folders below the scratch folder that ``written`` made are deleted; anything else raises an error.
    """
    spark = stored.sparkSession
    tables = os.path.join(scratch_dir(spark), "tables")
    folders = {os.path.dirname(path) for path in stored.inputFiles()}
    if any(os.path.basename(os.path.dirname(f)) != "tables" or not _MADE.search(f) for f in folders):
        raise ValueError("not a table of the scratch folder")
    files = spark._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = files.Path(os.path.join(tables, os.path.basename(folder)))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
