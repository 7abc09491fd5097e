"""Size-capped fingerprint snapshots: one JSON document per shop for screening buyers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip
from ..functions.hashing import hex8
from ..functions.sketch import sketch_hex
from .linkage import active_offers
from .skew import small

VERSION = 2
# Fixed value: byte cap of a shop's serialised snapshot.
MAX_BYTES = 10_240

# Bucket arrays in document order, with the entry column that feeds each.
ARRAYS = {
    "phone_hashes": "phone",
    "email_hashes": "email",
    "address_full_hashes": "addr_full",
    "address_house_hashes": "addr_house",
    "ip_hashes": "ip",
    "device_hashes": "device",
    "email_sketches": "email_sketch",
    "address_sketches": "addr_sketch",
}
BUCKET = "mode string, entry_ts array<bigint>, " + ", ".join(f"{name} array<string>" for name in ARRAYS)
_FIELDS = list(ARRAYS.values())


def newest_records(records: DataFrame, shops: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The ``records`` of active offers that can reach their shop's snapshot, told before their signals are derived.

    At most ``max_bytes / 11`` entries of a shop survive (see :func:`evict`). A record with a valid
    IP of a shop with a salt is an entry for certain; one with that many of these after it is none
    that stays. All others are kept, so also records whose entry depends on further signals.
    """
    most = max_bytes // 11 + 1
    salted = shops.filter(F.unhex("salt_hex").isNotNull()).select("shop_id").distinct()
    at = F.struct(F.unix_timestamp("created_at").alias("ts"), F.col("record_id"))
    sure = records.filter(ip.ip_key(F.col("ip")).isNotNull()).join(salted, "shop_id", "left_semi").select("shop_id", at.alias("_at"))
    newest = Window.partitionBy("shop_id").orderBy(F.col("_at").desc())
    last = sure.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= most)
    last = last.groupBy("shop_id").agg(F.min("_at").alias("_least"), F.count("*").alias("_n")).filter(F.col("_n") == most).drop("_n")
    return records.join(small(last, "oldest-kept"), "shop_id", "left").filter(F.col("_least").isNull() | (at >= F.col("_least"))).select(records.columns)


def snapshot_entries(ledger: DataFrame, offers: DataFrame) -> DataFrame:
    """One entry per redemption of an active offer that has any signal; absent signals are null."""
    text = lambda c: F.when(F.col(c).isNotNull(), hex8(F.col(c)))
    device = text("device_hash") if "device_hash" in ledger.columns else F.lit(None).cast("string")
    wanted = active_offers(offers).select("shop_id", "offer_id", F.when(F.col("mode") == "watch", "watch").otherwise("block").alias("mode"))
    entries = ledger.join(wanted, ["shop_id", "offer_id"]).select(
        "shop_id", "offer_id", "mode", "record_id",
        F.unix_timestamp("created_at").alias("ts"),
        text("phone_hash").alias("phone"),
        text("email_hash").alias("email"),
        text("address_full_hash").alias("addr_full"),
        text("address_house_hash").alias("addr_house"),
        text("ip_hash").alias("ip"),
        device.alias("device"),
        sketch_hex(F.col("email_sketch")).alias("email_sketch"),
        sketch_hex(F.col("address_sketch")).alias("addr_sketch"),
    )
    return entries.filter(F.coalesce(*_FIELDS).isNotNull())


def _quoted(value: Column | str) -> Column:
    """A JSON string, escaped, or ``null``."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - F.lit(2))


def _frame_bytes(shops: DataFrame) -> DataFrame:
    """Bytes of a shop's document without any bucket."""
    empty = F.concat(F.lit(f'{{"v":{VERSION},"salt_hex":'), _quoted("salt_hex"), F.lit(',"default_country_cc":'), _quoted("default_prefix"), F.lit(',"offers":{}}'))
    return shops.select("shop_id", F.octet_length(empty).alias("_frame"))


def evict(entries: DataFrame, shops: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Keep each shop's newest entries whose serialised snapshot fits into ``max_bytes``.

    Every entry takes at least 11 bytes (a timestamp and a comma), so at most ``max_bytes / 11``
    entries per shop can survive; that rank filter runs before the shuffle, and only then do
    the running byte sums look at a shop's entries together. Adds ``rank`` (1 = newest) and
    ``bytes``, the size of the document up to that entry.
    """
    newest = Window.partitionBy("shop_id").orderBy(F.col("ts").desc(), F.col("record_id").desc())
    few = entries.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= max_bytes // 11 + 1)
    so_far = newest.rowsBetween(Window.unboundedPreceding, 0)
    in_offer = Window.partitionBy("shop_id", "offer_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    keys = '"{}":[]'
    overhead = len(':{"mode":"","entry_ts":[],') + len(",".join(keys.format(n) for n in ARRAYS)) + len("}")
    # An item costs its text and a comma; the first item of an array and the first bucket have no comma.
    item = lambda c, quotes: F.octet_length(F.col(c).cast("string")) + quotes + 1
    first = lambda c: (F.count(c).over(in_offer) == 1) & F.col(c).isNotNull()
    values = [F.coalesce(item(c, 2), F.lit(0)) - first(c).cast("int") for c in _FIELDS]
    times = item("ts", 0) - first("ts").cast("int")
    bucket = F.when(first("ts"), F.octet_length(_quoted("offer_id")) + F.octet_length("mode") + overhead + 1).otherwise(0)
    sized = few.withColumn("_cost", reduce(add, [*values, times, bucket]))
    total = F.col("_frame") - 1 + F.sum("_cost").over(so_far)
    summed = sized.join(_frame_bytes(shops), "shop_id").withColumn("bytes", total)
    return summed.filter(F.col("bytes") <= max_bytes).drop("_cost", "_frame")


def buckets(entries: DataFrame) -> DataFrame:
    """Per offer: mode and parallel arrays, oldest entry first. Feed it evicted entries."""
    listed = F.sort_array(F.collect_list(F.struct("ts", "record_id", *_FIELDS)))
    grouped = entries.groupBy("shop_id", "offer_id").agg(F.min("mode").alias("mode"), listed.alias("_e"))
    array = lambda field: F.array_compact(F.transform("_e", lambda x: x[field]))
    return grouped.select(
        "shop_id", "offer_id", "mode", F.transform("_e", lambda x: x["ts"]).alias("entry_ts"),
        *[array(field).alias(name) for name, field in ARRAYS.items()],
    )


def documents(offer_buckets: DataFrame, shops: DataFrame) -> DataFrame:
    """One JSON document per shop, with its stats."""
    names = ["mode", "entry_ts", *ARRAYS]
    bucket = F.concat(_quoted("offer_id"), F.lit(":"), F.to_json(F.struct(*names)))
    per_shop = offer_buckets.groupBy("shop_id").agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("offer_id", bucket.alias("text")))), lambda x: x["text"])).alias("_offers"),
        F.sum(F.size("entry_ts")).alias("entries"),
        F.min(F.array_min("entry_ts")).alias("oldest_ts"),
        F.max(F.array_max("entry_ts")).alias("newest_ts"),
    )
    head = F.concat(F.lit(f'{{"v":{VERSION},"salt_hex":'), _quoted("salt_hex"), F.lit(',"default_country_cc":'), _quoted("default_prefix"))
    text = F.concat(head, F.lit(',"offers":{'), F.coalesce("_offers", F.lit("")), F.lit("}}"))
    joined = shops.select("shop_id", "salt_hex", "default_prefix").join(per_shop, "shop_id", "left")
    return joined.select(
        "shop_id", text.alias("document"), F.octet_length(text).alias("bytes"),
        F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), "oldest_ts", "newest_ts",
    )


def rebuild(ledger: DataFrame, offers: DataFrame, shops: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Ledger to snapshot documents: active offers, entries, eviction, buckets, JSON."""
    return documents(buckets(evict(snapshot_entries(ledger, offers), shops, max_bytes)), shops)


def append(kept: DataFrame, new: DataFrame, shops: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add entries to the entries kept so far; an offer that has a bucket keeps its mode."""
    old = kept.select(new.columns)
    modes = old.groupBy("shop_id", "offer_id").agg(F.min("mode").alias("_mode"))
    fresh = new.join(modes, ["shop_id", "offer_id"], "left").withColumn("mode", F.coalesce("_mode", "mode")).drop("_mode")
    return evict(old.unionByName(fresh), shops, max_bytes)


def set_modes(offer_buckets: DataFrame, modes: DataFrame) -> DataFrame:
    """Set bucket modes; an offer without a bucket gets an empty one."""
    new = modes.select("shop_id", "offer_id", F.col("mode").alias("_mode"))
    out = offer_buckets.join(new, ["shop_id", "offer_id"], "full").withColumn("mode", F.coalesce("_mode", "mode"))
    empty = {c: F.coalesce(c, F.array().cast(t)) for c, t in [("entry_ts", "array<bigint>"), *[(n, "array<string>") for n in ARRAYS]]}
    return out.withColumns(empty).select(offer_buckets.columns)


def drop_buckets(offer_buckets: DataFrame, gone: DataFrame) -> DataFrame:
    return offer_buckets.join(gone.select("shop_id", "offer_id"), ["shop_id", "offer_id"], "left_anti")


def parse_documents(df: DataFrame, lower: bool = True) -> DataFrame:
    """Documents back to buckets. Corrupt JSON or another version gives no bucket; malformed hashes are dropped."""
    from_text = F.from_json(
        F.col("document"),
        "v int, salt_hex string, default_country_cc string, offers map<string, string>",
    )
    parsed = df.select("shop_id", from_text.alias("d")).filter(F.col("d.v") == VERSION)
    offers = parsed.select("shop_id", F.col("d.salt_hex").alias("salt_hex"), F.col("d.default_country_cc").alias("default_prefix"), F.explode("d.offers").alias("offer_id", "_b"))
    raw = "mode string, entry_ts array<string>, " + ", ".join(f"{n} array<string>" for n in ARRAYS)
    rows = offers.filter(F.col("offer_id") != "").withColumn("_b", F.from_json("_b", raw))

    def clean(name: str) -> Column:
        digits = 32 if name.endswith("sketches") else 8
        kept = F.filter(F.coalesce(F.col(f"_b.{name}"), F.array().cast("array<string>")), lambda x: x.rlike(f"^[0-9a-fA-F]{{{digits}}}\\z"))
        return F.transform(kept, lambda x: F.lower(x)) if lower else kept

    times = F.transform(F.coalesce("_b.entry_ts", F.array().cast("array<string>")), lambda x: x.try_cast("bigint"))
    return rows.select(
        "shop_id", "salt_hex", "default_prefix", "offer_id",
        F.when(F.col("_b.mode") == "watch", "watch").otherwise("block").alias("mode"),
        F.array_compact(times).alias("entry_ts"),
        *[clean(n).alias(n) for n in ARRAYS],
    )
