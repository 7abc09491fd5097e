"""Parquet tables on shared storage: an append-only ledger and copy-on-write versions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.skew import small
from ..session import written


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


# -- the ledger: loose batches, and merged files under a manifest ------------------------------
#
# path/batch=B/shop_id=S/month=M       a batch as it was appended ("loose")
# path/_commits/B@ID                   says that writing B has ended; a repeated batch gets a new ID
# path/_merged/version=N/shop_id=S/month=M   all batches merged so far, their number in a column
# path/_merged/retired/version=N       the commits whose loose files version N has taken in
#
# A loose batch counts while one of its commits is not retired, and then its rows take the place of
# those that a merged version holds of it. So readers see each batch once, whenever they look.


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _filesystem(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(where)] if fs.exists(where) else []


def _batch_name(batch: int | str) -> str:
    if not re.fullmatch(r"[0-9A-Za-z_-]+", str(batch)):
        raise ValueError(f"a batch is named by letters, digits, - and _: {batch}")
    return str(batch)


def _live_batches(spark: SparkSession, path: str) -> list[str]:
    """Loose batches that count: committed, and not taken in by the merged version."""
    known = versions(spark, f"{path}/_merged")
    retired = set()
    if known:
        retired = {r.commit for r in spark.read.schema("commit string").parquet(f"{path}/_merged/retired/version={known[-1]}").collect()}
    return sorted({name.split("@")[0] for name in _children(spark, f"{path}/_commits") if "@" in name and name not in retired})


def append_ledger(records: DataFrame, path: str, batch: int | str) -> None:
    """Write one batch of ledger rows under ``path``, partitioned by batch, shop and month, then commit it.

    A repeated batch replaces its own rows and nothing else, also where they were merged since.
    ``rebalance`` lets AQE split the files of a shop with very many rows.
    """
    spark = records.sparkSession
    name = _batch_name(batch)
    rows = records.withColumn("month", F.date_format("created_at", "yyyy-MM")).hint("rebalance", "shop_id", "month")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shop_id", "month").parquet(f"{path}/batch={name}")
    before = [n for n in _children(spark, f"{path}/_commits") if n.startswith(f"{name}@")]
    fs, marker = _filesystem(spark, f"{path}/_commits/{name}@{uuid.uuid4().hex}")
    fs.create(marker).close()
    for old in before:
        fs.delete(_filesystem(spark, f"{path}/_commits/{old}")[1], False)


def read_ledger(spark: SparkSession, path: str, schema: str, but_not: int | str | None = None, shop_ids: list[str] | None = None) -> DataFrame | None:
    """All batches under ``path``, or all but one; None when nothing has been written.

    With ``shop_ids`` only the folders of these shops are read.
    """
    live, known = _live_batches(spark, path), versions(spark, f"{path}/_merged")
    if not live and not known:
        return None
    mine = (lambda df: df) if shop_ids is None else (lambda df: df.filter(F.col("shop_id").isin(shop_ids)))
    columns = spark.createDataFrame([], f"{schema}, batch string").columns
    parts = []
    loose = [b for b in live if but_not is None or b != str(but_not)]
    if loose:
        folders = [f"{path}/batch={b}" for b in loose]
        parts.append(mine(spark.read.schema(f"{schema}, batch string, month string").option("basePath", path).parquet(*folders)))
    if known:
        merged = spark.read.schema(f"{schema}, batch string, month string").parquet(f"{path}/_merged/version={known[-1]}")
        replaced = sorted({*live, *([] if but_not is None else [str(but_not)])})
        parts.append(mine(merged.filter(~F.col("batch").isin(replaced)) if replaced else merged))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [df.select(columns) for df in parts]).drop("batch")


def merge_ledger(spark: SparkSession, path: str, schema: str) -> int | None:
    """Merge all batches into one version with a few files a shop and month; returns its number, None if there is nothing to merge.

    Readers go on: until the new version is complete they see the former one and the loose batches.
    Only then are the loose files and older versions deleted. One writer at a time.
    """
    commits = [n for n in _children(spark, f"{path}/_commits") if "@" in n]
    live, known = _live_batches(spark, path), versions(spark, f"{path}/_merged")
    if not live:
        return None
    number = known[-1] + 1 if known else 1
    full = f"{schema}, batch string, month string"
    rows = spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/batch={b}" for b in live])
    if known:
        former = spark.read.schema(full).parquet(f"{path}/_merged/version={known[-1]}")
        rows = rows.unionByName(former.filter(~F.col("batch").isin(live)))
    spark.createDataFrame([(c,) for c in commits], "commit string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_merged/retired/version={number}")
    rows.hint("rebalance", "shop_id", "month").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shop_id", "month").parquet(f"{path}/_merged/version={number}")
    fs, _ = _filesystem(spark, path)
    gone = [f"{path}/batch={b}" for b in sorted({c.split("@")[0] for c in commits})] + [f"{path}/_commits/{c}" for c in commits]
    gone += [f"{path}/_merged/{kind}version={n}" for n in known for kind in ("", "retired/")]
    for old in gone:
        fs.delete(_filesystem(spark, old)[1], True)
    return number


def _with_partitions(spark: SparkSession, path: str, outer: list[str]) -> DataFrame:
    """A partitioned table with its partition columns as text, so that they are written back alike."""
    found = spark.read.parquet(path).schema
    fields = [f for f in found.fields if f.name not in outer] + [StructField(n, StringType()) for n in outer]
    return spark.read.schema(StructType(fields)).parquet(path)


def rewrite_shops(spark: SparkSession, path: str, shop_ids: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the rows of some shops by ``change`` of them, loose and merged; no other shop's files are read or written."""
    places = [(path, ["batch", "shop_id", "month"])] if any(n.startswith("batch=") for n in _children(spark, path)) else []
    places += [(f"{path}/_merged/version={n}", ["shop_id", "month"]) for n in versions(spark, f"{path}/_merged")]
    for place, outer in places:
        changed = written(change(_with_partitions(spark, place, outer).filter(F.col("shop_id").isin(shop_ids))), "rewrite")
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*outer).parquet(place)


def drop_shops(spark: SparkSession, path: str, shop_ids: list[str]) -> None:
    """Delete the files of some shops from every batch and from the merged versions."""
    fs, _ = _filesystem(spark, path)
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    names = [f"shop_id={escape(s)}" for s in shop_ids]
    places = [f"{path}/{n}" for n in _children(spark, path) if n.startswith("batch=")]
    places += [f"{path}/_merged/version={n}" for n in versions(spark, f"{path}/_merged")]
    for place in places:
        for name in names:
            fs.delete(_filesystem(spark, f"{place}/{name}")[1], True)


# -- a table that is replaced shop by shop -----------------------------------------------------


def put_shops(rows: DataFrame, touched: DataFrame, root: str) -> int:
    """Replace the rows of the ``touched`` shops (column shop_id) by ``rows``; only these are written.

    Each call writes one generation, ``data/gen=N/shop_id=S``, and then its manifest, the shops it
    touched. A shop's rows are those of the last generation that touched it; one without a manifest
    never took place, and its number is used again.
    """
    spark = rows.sparkSession
    known = versions(spark, f"{root}/manifest")
    number = known[-1] + 1 if known else 1
    kept = rows.hint("rebalance", "shop_id")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shop_id").parquet(f"{root}/data/gen={number}")
    touched.select("shop_id").distinct().coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={number}")
    return number


def _current(spark: SparkSession, root: str, known: list[int]) -> DataFrame:
    """(shop_id, gen): the last generation that touched each shop."""
    names = [f"{root}/manifest/version={n}" for n in known]
    manifest = spark.read.schema("shop_id string, version int").option("basePath", f"{root}/manifest").parquet(*names)
    return manifest.groupBy("shop_id").agg(F.max("version").alias("gen"))


def read_shops(spark: SparkSession, root: str, schema: str | None = None, shop_ids: list[str] | None = None) -> DataFrame | None:
    """The current rows, of some shops or all; None when nothing has been written. Folders of other shops are not read."""
    known = versions(spark, f"{root}/manifest")
    if not known:
        return None
    current = _current(spark, root, known)
    mine = (lambda df: df) if shop_ids is None else (lambda df: df.filter(F.col("shop_id").isin(shop_ids)))
    current = small(mine(current), "manifest")
    found = StructType.fromDDL(schema) if schema else spark.read.parquet(f"{root}/data").schema
    fields = [f for f in found.fields if f.name not in ("shop_id", "gen")] + [StructField("gen", IntegerType()), StructField("shop_id", StringType())]
    rows = mine(spark.read.schema(StructType(fields)).parquet(f"{root}/data"))
    return rows.join(current, ["shop_id", "gen"]).drop("gen")


def clear_generations(spark: SparkSession, root: str) -> None:
    """Delete generations of which no shop's rows are current, with their manifests. One writer at a time."""
    known = versions(spark, f"{root}/manifest")
    if not known:
        return
    used = {r.gen for r in _current(spark, root, known).select("gen").distinct().collect()}
    fs, _ = _filesystem(spark, root)
    for n in known:
        if n not in used and n != known[-1]:
            fs.delete(_filesystem(spark, f"{root}/manifest/version={n}")[1], True)
            fs.delete(_filesystem(spark, f"{root}/data/gen={n}")[1], True)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of a copy-on-write table (those with a success marker), oldest first."""
    fs, where = _filesystem(spark, root)
    if not fs.exists(where):
        return []
    found = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(_filesystem(spark, f"{root}/{name}/_SUCCESS")[1]):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def replace_table(df: DataFrame, root: str, partition_by: list[str] | None = None) -> int:
    """Write ``df`` as the next version; readers move to it once its success marker is there."""
    known = versions(df.sparkSession, root)
    number = known[-1] + 1 if known else 1
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{root}/version={number}")
    return number


def read_table(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest complete version, or None."""
    known = versions(spark, root)
    return spark.read.parquet(f"{root}/version={known[-1]}") if known else None


# -- orders and what was rejected --------------------------------------------------------------


def store_checked(checked: DataFrame, path: str, batch: int | str) -> None:
    """Write the rows of ``orders.check_orders`` in one pass: orders and rejected rows to folders of their own.

    A repeated batch replaces its own files in both. Orders drop the raw payload, rejected rows keep it.
    """
    rejected = F.col("reason").isNotNull()
    rows = checked.withColumns({"raw_payload": F.when(rejected, F.col("raw_payload")), "rejected": rejected})
    place = f"{path}/batch={_batch_name(batch)}"
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("rejected").parquet(place)


def read_checked(spark: SparkSession, path: str, schema: str, rejected: bool) -> DataFrame:
    """Stored orders, or the rows rejected with reason and raw payload; only the folders of that kind are read.

    ``schema`` is that of the checked rows.
    """
    kept = StructType.fromDDL(f"{schema}, batch string, rejected boolean")
    rows = spark.read.schema(kept).option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("rejected") == rejected)
    return rows.drop("rejected", *([] if rejected else ["reason", "raw_payload"]))


def write_snapshot(documents: DataFrame, path: str) -> None:
    """One JSON document per line, in a folder per shop."""
    documents.select("shop_id", F.col("document").alias("value")).write.mode("overwrite").partitionBy("shop_id").text(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Stored documents; pass them to ``snapshot.parse_documents``."""
    return spark.read.schema("value string, shop_id string").text(path).select("shop_id", F.col("value").alias("document"))


def write_exports(envelopes: DataFrame, path: str) -> None:
    """One JSON envelope per request, in a folder per request's shop."""
    envelopes.select("shop_id", F.col("envelope").alias("value")).write.mode("overwrite").partitionBy("shop_id").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
