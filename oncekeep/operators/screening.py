"""Screen buyers at checkout against the per-offer hash buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import small

# Weights of the screening rules; a score of 10 blocks.
PHONE, EMAIL, FULL, HOUSE, TAG = 10, 10, 10, 8, 10
_KINDS = {"phone": "phone_hashes", "email": "email_hashes", "full": "address_full_hashes", "house": "address_house_hashes"}


def screen(buyers: DataFrame, offer_buckets: DataFrame) -> DataFrame:
    """Score each buyer against the offers of the shop that it scores on: those hit by a signal, with a tag all.

    ``buyers`` holds shop_id, buyer_id, has_tag and the hashes phone_hash, email_hash,
    address_full_hash, address_house_hash as 8 hex digits. A bucket is bounded by the snapshot
    cap, so a shop has a bounded number of hashes and offers. A pair that scores nothing has no row.
    """
    tagged = lambda kind, hashes: F.transform(hashes, lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("hash")))
    members = F.flatten(F.array(*[tagged(k, c) for k, c in _KINDS.items()]))
    known = offer_buckets.select("shop_id", "offer_id", F.inline(members))
    # One row per known hash with the offers that hold it: at most the shop's offers.
    holders = small(known.groupBy("shop_id", "kind", "hash").agg(F.collect_set("offer_id").alias("offers")), "holders")
    asked = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("hash")) for k, c in
          (("phone", "phone_hash"), ("email", "email_hash"), ("full", "address_full_hash"), ("house", "address_house_hash"))]
    )
    signals = buyers.select("shop_id", "buyer_id", F.inline(F.filter(asked, lambda x: x["hash"].isNotNull())))
    hits = signals.join(holders, ["shop_id", "kind", "hash"]).select("shop_id", "buyer_id", "kind", F.explode("offers").alias("offer_id"))
    has = lambda kind: F.max((F.col("kind") == kind).cast("int"))
    offers = small(offer_buckets.select("shop_id", "offer_id", "mode"), "offers")
    tags = buyers.filter("has_tag").select("shop_id", "buyer_id").join(offers.drop("mode"), "shop_id")
    hits = hits.unionByName(tags.withColumn("kind", F.lit("tag")))
    matched = hits.groupBy("shop_id", "buyer_id", "offer_id").agg(*[has(k).alias(f"_{k}") for k in (*_KINDS, "tag")])
    joined = matched.join(offers, ["shop_id", "offer_id"])
    score = (
        F.col("_phone") * PHONE
        + F.col("_email") * EMAIL
        + F.when(F.col("_full") == 1, FULL).when(F.col("_house") == 1, HOUSE).otherwise(0)
        + F.col("_tag") * TAG
    )
    return joined.select(
        "shop_id", "buyer_id", "offer_id", "mode", score.alias("score"),
        ((score >= 10) & (F.col("mode") == "block")).alias("blocked"),
    )
