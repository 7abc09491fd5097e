"""Ledger upkeep: deliveries, backfill, retention, erasure, rotation, lifecycle of offers and shops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto, hashing, ip
from .linkage import match_codes
from .signals import HASHES, SIGNALS, derive, shop_keys

UNIQUE = ["shop_id", "order_gid", "offer_id"]
CIPHERTEXTS = ["email_ciphertext", "phone_ciphertext", "address_ciphertext", "billing_ciphertext", "ip_ciphertext"]
PERSONAL = ["customer_gid", *CIPHERTEXTS, *SIGNALS]


def first_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key; a partial aggregate, so a key with many rows stays cheap."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def last_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def dedupe_deliveries(events: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """First delivery of each id wins; ids already in ``log`` are dropped. Adds the payload's SHA-256."""
    fresh = events if log is None else events.join(log.select("webhook_gid"), "webhook_gid", "left_anti")
    return first_by(fresh.withColumn("payload_sha256", F.sha2("payload", 256)), ["webhook_gid"], "received_at", "payload_sha256")


# -- adding rows -----------------------------------------------------------------------------


def not_in_ledger(records: DataFrame, ledger: DataFrame) -> DataFrame:
    return records.join(ledger.select(*UNIQUE), UNIQUE, "left_anti")


def backfill(orders: DataFrame, offers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Historical orders that used an active offer's code and are not in the ledger yet."""
    matched = first_by(match_codes(orders, offers), UNIQUE, "created_at", "record_id")
    return not_in_ledger(matched, ledger)


def seal(derived: DataFrame, shops: DataFrame) -> DataFrame:
    """Ledger rows from derived orders: personal values only as envelopes under the shop's key."""
    keyed = derived.join(shops.select("shop_id", F.unhex("key_hex").alias("_key")), "shop_id")
    sealed = lambda value: crypto.encrypt(value, F.col("_key"))
    as_json = lambda c: F.when(F.col(c).isNotNull(), F.to_json(c))
    return keyed.select(
        "record_id", *UNIQUE, "order_name", "code_used", "customer_gid", "created_at", "ip_tag",
        sealed(F.col("canonical_email")).alias("email_ciphertext"),
        sealed(F.col("canonical_phone")).alias("phone_ciphertext"),
        sealed(as_json("address")).alias("address_ciphertext"),
        sealed(as_json("billing")).alias("billing_ciphertext"),
        sealed(F.col("ip")).alias("ip_ciphertext"),
        *SIGNALS,
    )


def unseal(ledger: DataFrame, shops: DataFrame) -> DataFrame:
    """Ledger rows with the personal values decrypted again; a damaged envelope gives null."""
    address = "address1 string, address2 string, city string, zip string, country string"
    keyed = ledger.join(shops.select("shop_id", F.unhex("key_hex").alias("_key")), "shop_id")
    opened = lambda c: crypto.decrypt(F.col(c), F.col("_key"))
    return keyed.withColumns(
        {
            "email": opened("email_ciphertext"),
            "phone": opened("phone_ciphertext"),
            "address": F.from_json(opened("address_ciphertext"), address),
            "billing": F.from_json(opened("billing_ciphertext"), address),
            "ip": opened("ip_ciphertext"),
        }
    ).drop("_key")


# -- removing and rewriting rows -------------------------------------------------------------


def _cutoff(now: str, days: Column) -> Column:
    return F.to_timestamp(F.lit(now)) - F.make_interval(days=days)


def retention_keep(ledger: DataFrame, shops: DataFrame, now: str) -> DataFrame:
    """Rows that stay: shops without a limit, uninstalled shops, and rows not older than the limit."""
    limit = shops.select("shop_id", "retention_days", "uninstalled_at")
    unlimited = F.col("uninstalled_at").isNotNull() | (F.coalesce(F.col("retention_days"), F.lit(0)) <= 0)
    recent = F.col("created_at") >= _cutoff(now, F.col("retention_days").cast("int"))
    return ledger.join(limit, "shop_id").filter(unlimited | recent).select(ledger.columns)


def archive_keep(log: DataFrame, time_col: str, days: int, now: str) -> DataFrame:
    return log.filter(F.col(time_col) >= _cutoff(now, F.lit(days)))


def _erased(requests: DataFrame) -> DataFrame:
    wanted = requests.filter((F.col("topic") == "customers/redact") & F.col("customer_gid").isNotNull())
    return wanted.select("shop_id", "customer_gid", F.lit(True).alias("_hit")).distinct()


def redact(table: DataFrame, requests: DataFrame, columns: list[str], row_id: str = "record_id") -> DataFrame:
    """Null the personal columns of the requested customers; rows stay."""
    columns = [c for c in columns if c in table.columns]
    # Guests have no customer id: a key of their own keeps them from meeting in one partition.
    keyed = table.withColumn("_customer", F.coalesce("customer_gid", F.concat(F.lit("guest:"), F.col(row_id).cast("string"))))
    hits = _erased(requests).withColumnRenamed("customer_gid", "_customer")
    joined = keyed.join(hits, ["shop_id", "_customer"], "left")
    cleared = {c: F.when(F.col("_hit").isNull(), F.col(c)) for c in columns}
    return joined.withColumns(cleared).select(table.columns)


def complete_requests(requests: DataFrame, topic: str, now: str) -> DataFrame:
    """Open requests of a topic become completed; finished ones keep their time."""
    due = (F.col("topic") == topic) & (F.col("status") != "completed")
    return requests.withColumns(
        {
            "completed_at": F.when(due, F.to_timestamp(F.lit(now))).otherwise(F.col("completed_at")),
            "status": F.when(due, "completed").otherwise(F.col("status")),
        }
    )


def purge_shops(tables: dict[str, DataFrame], shops: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given shops."""
    gone = shops.select("shop_id").distinct()
    return {name: df.join(gone, "shop_id", "left_anti") for name, df in tables.items()}


def turn_salts(shops: DataFrame, new_salts: DataFrame) -> DataFrame:
    """Shops with their new salts, versions up by one; a shop that has its new salt already stays as it is."""
    renewed = shops.join(new_salts.select("shop_id", F.col("salt_hex").alias("_new")), "shop_id", "left")
    turned = F.col("_new").isNotNull() & (F.col("_new") != F.col("salt_hex"))
    return renewed.withColumns(
        {"salt_version": F.col("salt_version") + turned.cast("int"), "salt_hex": F.coalesce("_new", "salt_hex")}
    ).select(shops.columns)


def rehash(ledger: DataFrame, shops: DataFrame) -> DataFrame:
    """Hash and sketch every record again, from its envelopes, under its shop's salt."""
    plain = unseal(ledger, shops).drop(*SIGNALS, "ip_tag")
    # Stored values are canonical already, so no default prefix applies.
    keys = shops.withColumn("default_prefix", F.lit(None).cast("string"))
    return derive(plain, keys).select(ledger.columns)


def rotate_salt(ledger: DataFrame, shops: DataFrame, new_salts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hash and sketch every record again under its shop's new salt; versions go up by one.

    Returns (ledger, shops); shops without a new salt keep their rows and their salt. For a stored
    ledger ``streaming.jobs.rotate_stored`` reads and writes the rotated shops alone.
    """
    turned = turn_salts(shops, new_salts)
    changed = ledger.join(new_salts.select("shop_id"), "shop_id", "left_semi")
    same = ledger.join(new_salts.select("shop_id"), "shop_id", "left_anti")
    return rehash(changed, turned).unionByName(same), turned


def backfill_ip(ledger: DataFrame, shops: DataFrame) -> DataFrame:
    """Fill the IP hash of rows that have an encrypted IP but no hash."""
    lacking = F.col("ip_hash").isNull() & F.col("ip_ciphertext").isNotNull()
    opened = ledger.join(shops.select("shop_id", F.unhex("key_hex").alias("_key")), "shop_id", "left")
    opened = opened.withColumn("_ip", ip.ip_key(F.when(lacking, crypto.decrypt(F.col("ip_ciphertext"), F.col("_key")))))
    states = shop_keys(shops).select("shop_id", "_v4_state", "_v6_state")
    tag = ip.ip_tag(F.col("_ip"))
    state = F.when(tag == ip.TAG_V6, F.col("_v6_state")).otherwise(F.col("_v4_state"))
    filled = opened.join(states, "shop_id", "left").withColumn("_hash", hashing.fnv1a(F.col("_ip"), state))
    return filled.withColumns(
        {"ip_hash": F.coalesce("ip_hash", "_hash"), "ip_tag": F.when(F.col("_hash").isNotNull(), tag).otherwise(F.col("ip_tag"))}
    ).select(ledger.columns)


def backfill_billing(ledger: DataFrame, history: DataFrame, shops: DataFrame) -> DataFrame:
    """Fill the billing slot from order history where billing and shipping differ."""
    none = F.lit(None).cast("string")
    lacking = ledger.filter(F.col("billing_ciphertext").isNull()).select("shop_id", "order_gid").distinct()
    wanted = first_by(history.join(lacking, ["shop_id", "order_gid"], "left_semi"), ["shop_id", "order_gid"], "created_at", "record_id")
    both = wanted.filter(F.col("address").isNotNull() & F.col("billing").isNotNull())
    both = both.select("shop_id", "order_gid", none.alias("email"), none.alias("phone"), none.alias("ip"), "address", "billing")
    hashed = derive(both, shops).filter(~F.col("address_full_hash").eqNullSafe(F.col("billing_full_hash")))
    keyed = hashed.join(shops.select("shop_id", F.unhex("key_hex").alias("_key")), "shop_id")
    slot = keyed.select(
        "shop_id", "order_gid",
        crypto.encrypt(F.to_json("billing"), F.col("_key")).alias("_cipher"),
        F.col("billing_full_hash").alias("_hash"),
    )
    empty = F.col("billing_ciphertext").isNull()
    return ledger.join(slot, ["shop_id", "order_gid"], "left").withColumns(
        {
            "billing_full_hash": F.when(empty, F.coalesce("_hash", "billing_full_hash")).otherwise(F.col("billing_full_hash")),
            "billing_ciphertext": F.coalesce("billing_ciphertext", "_cipher"),
        }
    ).select(ledger.columns)


# -- subject access --------------------------------------------------------------------------


def export_lines(requests: DataFrame, ledger: DataFrame, flags: DataFrame, shops: DataFrame | None = None) -> DataFrame:
    """One row per request and item: the customer's redemptions and flags (left join, none gives one null item).

    With ``shops`` the ledger is a sealed one: its envelopes are opened with the shops' keys and
    the items carry the personal values. Without, they carry those that the ledger holds in plain.
    """
    ledger = ledger if shops is None else unseal(ledger, shops)
    wanted = requests.filter(F.col("topic") == "customers/data_request").select("request_id", "shop_id", "customer_gid")
    who = ["shop_id", "customer_gid"]
    record = F.to_json(F.struct("record_id", "order_gid", "order_name", "offer_id", "created_at", *[c for c in ("email", "phone", "address", "billing", "ip", *HASHES) if c in ledger.columns]))
    flag = F.to_json(F.struct("order_gid", "order_name", "offer_id", "risk_level", "score", "created_at"))
    items = ledger.select(*who, F.lit("redemption").alias("kind"), F.col("order_gid"), record.alias("item")).unionByName(
        flags.select(*who, F.lit("flag").alias("kind"), F.col("order_gid"), flag.alias("item"))
    )
    return wanted.join(items.filter(F.col("customer_gid").isNotNull()), who, "left")


def export_envelopes(lines: DataFrame, now: str) -> DataFrame:
    """One JSON envelope per request."""
    items = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("order_gid", "item"))))
    grouped = lines.groupBy("request_id", "shop_id", "customer_gid").agg(items("redemption").alias("_r"), items("flag").alias("_f"))
    text = lambda c: F.concat(F.lit("["), F.concat_ws(",", F.transform(c, lambda x: x["item"])), F.lit("]"))
    head = F.to_json(F.struct(F.col("customer_gid").alias("customerGid"), F.lit(now).alias("generatedAt")))
    body = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"redemptions":'), text("_r"), F.lit(',"flaggedOrders":'), text("_f"), F.lit("}"))
    return grouped.withColumn("head", head).select("request_id", "shop_id", body.alias("envelope"))


# -- dimensions and small tables -------------------------------------------------------------


def change_offers(offers: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply to each offer the last change of each field: status, mode and archiving.

    A null leaves a field alone. ``archived_at`` archives an offer; where ``changes`` has a column
    ``archived``, false takes an offer out of the archive and true archives it at the given time.
    """
    flag = F.col("archived") if "archived" in changes.columns else F.lit(None).cast("boolean")
    stamp = F.when(F.coalesce(flag, F.lit(True)), F.col("archived_at"))
    said = F.col("archived_at").isNotNull() | flag.isNotNull()
    last = lambda value, given: F.max_by(value, F.when(given, F.col("changed_at")))
    new = changes.groupBy("offer_id").agg(
        *[last(F.col(c), F.col(c).isNotNull()).alias(f"_{c}") for c in ("status", "mode")],
        last(F.struct(stamp.alias("at")), said).alias("_archived"),
    )
    out = offers.join(new, "offer_id", "left")
    archived = F.when(F.col("_archived").isNotNull(), F.col("_archived.at")).otherwise(F.col("archived_at"))
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("status", "mode")}).withColumn("archived_at", archived).select(offers.columns)


def apply_shop_events(shops: DataFrame, events: DataFrame) -> DataFrame:
    """Uninstall stamps a shop; reinstall clears the stamp and keeps salt and key.

    The last event wins over all batches: ``lifecycle_at`` and ``lifecycle_id`` keep the time and id
    of the event applied last, and one that comes late, after a newer one, changes nothing. Events
    without a column ``event_id`` are told apart by topic. Both columns are added where missing.
    """
    register = {"lifecycle_at": "timestamp", "lifecycle_id": "string"}
    shops = shops.withColumns({c: F.lit(None).cast(t) for c, t in register.items() if c not in shops.columns})
    known = F.col("event_id").cast("string") if "event_id" in events.columns else F.col("topic")
    wanted = events.filter(F.col("topic").isin("app/uninstalled", "app/installed")).withColumn("_id", known)
    last = last_by(wanted, ["shop_id"], "received_at", "_id")
    out = shops.join(last.select("shop_id", F.col("topic").alias("_t"), F.col("received_at").alias("_at"), "_id"), "shop_id", "left")
    newer = F.col("lifecycle_at").isNull() | (F.struct("_at", "_id") > F.struct(F.col("lifecycle_at"), F.coalesce("lifecycle_id", F.lit(""))))
    applies = F.col("_t").isNotNull() & newer
    new = {"uninstalled_at": F.when(F.col("_t") == "app/uninstalled", F.col("_at")), "lifecycle_at": F.col("_at"), "lifecycle_id": F.col("_id")}
    return out.withColumns({c: F.when(applies, v).otherwise(F.col(c)) for c, v in new.items()}).select(shops.columns)


def cancel_pending(jobs: DataFrame, shops: DataFrame) -> DataFrame:
    """Pending work of uninstalled shops is cancelled; it gets no completion time, as it was never done."""
    gone = shops.filter(F.col("uninstalled_at").isNotNull()).select("shop_id", F.lit(True).alias("_gone"))
    hit = F.col("_gone").isNotNull() & (F.col("status") == "pending")
    return jobs.join(gone, "shop_id", "left").withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).select(jobs.columns)


def dispose_flags(flags: DataFrame, actions: DataFrame) -> DataFrame:
    """Merchant actions on flags, scoped by shop; the last action wins."""
    last = last_by(actions, ["shop_id", "order_gid"], "acted_at")
    new = last.select("shop_id", "order_gid", F.col("action").alias("_a"), F.col("acted_at").alias("_at"))
    return flags.join(new, ["shop_id", "order_gid"], "left").withColumns(
        {"merchant_action": F.coalesce("_a", "merchant_action"), "merchant_action_at": F.coalesce("_at", "merchant_action_at")}
    ).select(flags.columns)


def settle_dead_letters(jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """Retry or archive failed jobs; jobs in another status are left alone."""
    last = last_by(actions, ["job_id"], "acted_at").select("job_id", F.col("action").alias("_a"), F.col("acted_at").alias("_at"))
    failed = F.col("status") == "failed"
    retry, archive = failed & (F.col("_a") == "retry"), failed & (F.col("_a") == "archive")
    return jobs.join(last, "job_id", "left").withColumns(
        {
            "attempts": F.when(retry, 0).otherwise(F.col("attempts")),
            "completed_at": F.when(archive, F.col("_at")).when(~F.coalesce(retry, F.lit(False)), F.col("completed_at")),
            "status": F.when(retry, "pending").when(archive, "archived").otherwise(F.col("status")),
        }
    ).select(jobs.columns)


def shred_keys(shops: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop the data key of the given shops; their envelopes can no longer be opened."""
    mark = gone.select("shop_id", F.lit(True).alias("_gone")).distinct()
    return shops.join(mark, "shop_id", "left").withColumn("key_hex", F.when(F.col("_gone").isNull(), F.col("key_hex"))).select(shops.columns)


def redeemer_tags(ledger: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Customers with any redemption in the shop, without erased ones."""
    tags = ledger.filter(F.col("customer_gid").isNotNull()).select("shop_id", "customer_gid").distinct()
    return tags if requests is None else tags.join(_erased(requests), ["shop_id", "customer_gid"], "left_anti")
