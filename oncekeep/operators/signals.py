"""Orders to canonical values, salted hashes and sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, ip, sketch, text

HASHES = ["phone_hash", "email_hash", "address_full_hash", "address_house_hash", "billing_full_hash", "ip_hash"]
SKETCHES = ["email_sketch", "address_sketch"]
SIGNALS = [*HASHES, *SKETCHES]

# Domain tags of the lookup hashes.
TAGS = {
    "phone": "phone",
    "email": "email_canonical",
    "full": "addr_full",
    "house": "addr_house",
    "v4": ip.TAG_V4,
    "v6": ip.TAG_V6,
    "device": "device",
}


def shop_keys(shops: DataFrame) -> DataFrame:
    """Per shop: the hash state after its salt and each tag, and the salt-only state for sketches."""
    salt = F.col("salt_hex")
    states = [hashing.lookup_state(salt, tag).alias(f"_{name}_state") for name, tag in TAGS.items()]
    return shops.select("shop_id", F.col("default_prefix").alias("_prefix"), *states, hashing.salt_state(salt).alias("_salt_state"))


_PARTS = [(address, part) for address in ("address", "billing") for part in ("address1", "address2", "zip")]


def _lines(address: str, short: str) -> list[Column]:
    """Normalised line 1, line 2, zip and the upper-case country of an address struct, as flat columns."""
    has = F.col(address).isNotNull()

    def part(name: str) -> Column:
        folded = F.get(F.col("_folded"), F.lit(1 + _PARTS.index((address, name))))
        return F.when(has, text.normalize_line(F.coalesce(folded, F.col(f"{address}.{name}")), stripped=True))

    return [
        part("address1").alias(f"_{short}_n1"),
        part("address2").alias(f"_{short}_n2"),
        part("zip").alias(f"_{short}_zip"),
        F.when(has, F.upper(F.coalesce(F.col(f"{address}.country"), F.lit("")))).alias(f"_{short}_cc"),
    ]


def _filled(address: str) -> Column:
    """An address with nothing in line 1, zip and country is not hashed."""
    return F.concat_ws("", *[F.col(f"{address}.{p}") for p in ("address1", "zip", "country")]) != ""


def _cols(short: str, *names: str) -> list[Column]:
    return [F.col(f"_{short}_{n}") for n in names]


def derive(orders: DataFrame, shops: DataFrame) -> DataFrame:
    """Add canonical email and phone, six hashes (as longs), the IP tag and two sketches.

    ``orders`` has shop_id, email, phone, ip and the structs ``address`` and ``billing``
    (address1, address2, zip, country). The shop table joins by size: broadcast when Spark
    sees it is small, else a shuffle join that AQE splits for shops with very many orders.
    """
    keep = orders.columns
    keyed = orders.join(shop_keys(shops), "shop_id")
    states = [c for c in keyed.columns if c.endswith("_state")]
    folded = text.normalize_row(F.col("email"), *[F.col(f"{a}.{p}") for a, p in _PARTS])
    canonical = keyed.withColumn("_folded", folded).select(
        *keep,
        *states,
        text.canonical_email(F.coalesce(F.get("_folded", F.lit(0)), F.col("email")), composed=True).alias("canonical_email"),
        text.canonical_phone(F.col("phone"), F.col("_prefix")).alias("canonical_phone"),
        *_lines("address", "ship"),
        *_lines("billing", "bill"),
        ip.ip_key(F.col("ip")).alias("_ip_key"),
    )
    words = sketch.address_words(*_cols("ship", "n1", "zip"), F.substring_index(F.col("_ship_cc"), "|", 1))
    prepared = canonical.select(
        *keep,
        *states,
        "canonical_email",
        "canonical_phone",
        F.when(_filled("address"), text.address_full_key(*_cols("ship", "n1", "n2", "zip", "cc"))).alias("_full"),
        F.when(_filled("address"), text.address_house_key(*_cols("ship", "n1", "zip", "cc"))).alias("_house"),
        F.when(_filled("billing"), text.address_full_key(*_cols("bill", "n1", "n2", "zip", "cc"))).alias("_billing"),
        "_ip_key",
        ip.ip_tag(F.col("_ip_key")).alias("ip_tag"),
        sketch.email_words(F.col("canonical_email")).alias("_email_words"),
        words.alias("_address_words"),
    )
    state = lambda name: F.col(f"_{name}_state")
    ip_state = F.when(F.col("ip_tag") == ip.TAG_V4, state("v4")).otherwise(state("v6"))
    return prepared.select(
        *keep,
        "canonical_email",
        "canonical_phone",
        "ip_tag",
        hashing.fnv1a(F.col("canonical_phone"), state("phone")).alias("phone_hash"),
        hashing.fnv1a(F.col("canonical_email"), state("email")).alias("email_hash"),
        hashing.fnv1a(F.col("_full"), state("full")).alias("address_full_hash"),
        hashing.fnv1a(F.col("_house"), state("house")).alias("address_house_hash"),
        hashing.fnv1a(F.col("_billing"), state("full")).alias("billing_full_hash"),
        hashing.fnv1a(F.col("_ip_key"), ip_state).alias("ip_hash"),
        hashing.bottom4(F.col("_email_words"), state("salt")).alias("email_sketch"),
        hashing.bottom4(F.col("_address_words"), state("salt")).alias("address_sketch"),
    )


def at_rest(df: DataFrame) -> DataFrame:
    """Hash columns from longs to 8 hex digits."""
    return df.withColumns({c: hashing.hex8(F.col(c)) for c in HASHES})


def in_flight(df: DataFrame) -> DataFrame:
    """Hash columns from 8 hex digits to longs."""
    return df.withColumns({c: hashing.from_hex8(F.col(c)) for c in HASHES})
