"""Streaming: delivery dedup, scoring with ledger append, snapshot upkeep, governance, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as ledger_ops
from ..operators import linkage, snapshot
from ..operators.signals import SIGNALS, derive
from ..session import written
from ..operators.skew import BROADCAST_ROWS
from ..sources.orders import check_orders
from ..sources.tables import append_ledger, drop_shops, put_shops, read_ledger, read_shops, read_table, replace_table, rewrite_shops, store_checked

LEDGER_SCHEMA = (
    "record_id bigint, order_gid string, offer_id string, order_name string, code_used string, customer_gid string, "
    "created_at timestamp, ip_tag string, email_ciphertext string, phone_ciphertext string, address_ciphertext string, "
    "billing_ciphertext string, ip_ciphertext string, phone_hash bigint, email_hash bigint, address_full_hash bigint, "
    "address_house_hash bigint, billing_full_hash bigint, ip_hash bigint, email_sketch array<bigint>, "
    "address_sketch array<bigint>, shop_id string"
)
ENTRIES_SCHEMA = (
    "shop_id string, offer_id string, mode string, record_id bigint, ts bigint, phone string, email string, addr_full string, "
    "addr_house string, ip string, device string, email_sketch string, addr_sketch string, rank int, bytes bigint"
)
HISTORY_SCHEMA = "shop_id string, record_id bigint, created_at timestamp, payload string"
_MATCH = ["offer_id", "record_id", "created_at", "ip_tag", *SIGNALS]


def dedupe_stream(deliveries: DataFrame, lateness: str = "48 hours") -> DataFrame:
    """First delivery of each id within the retry period; state older than that is dropped."""
    return (
        deliveries.withWatermark("received_at", lateness)
        .dropDuplicatesWithinWatermark(["webhook_gid"])
        .withColumn("payload_sha256", F.sha2("payload", 256))
    )


def rolling_counts(records: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Redemptions per shop and window, for update or append mode."""
    return (
        records.withWatermark("created_at", lateness)
        .groupBy("shop_id", F.window("created_at", width))
        .count()
        .select("shop_id", F.col("window.start").alias("window_start"), F.col("count").alias("redemptions"))
    )


def score_batch(batch: DataFrame, batch_id: int, shops: DataFrame, offers: DataFrame, ledger_path: str, flags_path: str) -> DataFrame:
    """Score one micro-batch of orders against the ledger and the earlier rows of the batch, then append.

    The ledger is the only state. It is read once a batch: the folders of the batch's shops, and of
    these the rows of its offers. A repeated batch leaves its own earlier output out, so it writes
    the same rows again. Returns the new ledger rows.
    """
    spark = batch.sparkSession
    matched = written(ledger_ops.first_by(linkage.match_codes(batch, offers), ledger_ops.UNIQUE, "created_at", "record_id"), "matched")
    used = matched.select("shop_id", "offer_id").distinct()
    stored = read_ledger(spark, ledger_path, LEDGER_SCHEMA, batch_id, shops_in(used))
    if stored is not None:
        prior = written(stored.join(F.broadcast(used.select("offer_id")) if used.count() <= BROADCAST_ROWS else used.select("offer_id"), "offer_id", "left_semi"), "prior")
        matched = ledger_ops.not_in_ledger(matched, prior)
    new = written(ledger_ops.seal(derive(matched, shops), shops), "batch")
    rows = new.select(*_MATCH, F.lit(True).alias("is_new"))
    if stored is not None:
        rows = prior.select(*_MATCH, F.lit(False).alias("is_new")).unionByName(rows)
    # Earlier means arrived earlier: whatever their times, ledger rows come before the batch.
    scored = linkage.best_matches(rows, order=("is_new", "created_at", "record_id")).join(new.select("offer_id", "record_id", "shop_id", "order_gid", "order_name", "customer_gid", "created_at"), ["offer_id", "record_id"])
    flags = linkage.flagged_orders(scored).drop("masks", "pos").withColumns(
        {"merchant_action": F.lit("pending"), "merchant_action_at": F.lit(None).cast("timestamp")}
    )
    append_ledger(flags, flags_path, batch_id)
    append_ledger(new, ledger_path, batch_id)
    return new


def shops_in(rows: DataFrame) -> list[str]:
    """The shops of a micro-batch; no more than its rows, which the stream's trigger bounds."""
    return [r.shop_id for r in rows.select("shop_id").distinct().collect()]


def update_snapshots(new: DataFrame, shops: DataFrame, offers: DataFrame, entries_root: str) -> None:
    """Add new ledger rows to the kept snapshot entries of their shops; other shops are neither read nor written.

    A batch whose entries are all known already writes nothing. Single writer.
    """
    touched = shops_in(new)
    fresh = snapshot.snapshot_entries(new, offers)
    kept = read_shops(new.sparkSession, entries_root, ENTRIES_SCHEMA, touched)
    if kept is not None:
        # A repeated batch must not count twice.
        fresh = fresh.join(kept.select("shop_id", "offer_id", "record_id"), ["shop_id", "offer_id", "record_id"], "left_anti")
    fresh = written(fresh, "entries")
    if fresh.isEmpty():
        return
    result = snapshot.evict(fresh, shops) if kept is None else snapshot.append(kept.select(fresh.columns), fresh, shops)
    put_shops(written(result, "entries"), new, entries_root)


def run_scoring(orders: DataFrame, shops: DataFrame, offers: DataFrame, ledger_path: str, flags_path: str, checkpoint: str, entries_root: str | None = None):
    """Start the scoring stream: dedupe upstream, then score, append and refresh snapshots per batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = score_batch(batch, batch_id, shops, offers, ledger_path, flags_path)
        if entries_root:
            update_snapshots(new, shops, offers, entries_root)

    return orders.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def rebuild_entries(ledger_path: str, shops: DataFrame, offers: DataFrame, entries_root: str, shop_ids: list[str]) -> None:
    """Make the snapshot entries of some shops anew from their ledger rows; no other shop is read or written."""
    spark = shops.sparkSession
    stored = read_ledger(spark, ledger_path, LEDGER_SCHEMA, shop_ids=shop_ids)
    if stored is None or read_shops(spark, entries_root, ENTRIES_SCHEMA) is None:
        return
    fresh = snapshot.evict(snapshot.snapshot_entries(stored, offers), shops)
    put_shops(written(fresh, "entries"), spark.createDataFrame([(s,) for s in shop_ids], "shop_id string"), entries_root)


def rotate_stored(spark: SparkSession, new_salts: DataFrame, tables_root: str, ledger_path: str, offers: DataFrame, entries_root: str) -> None:
    """Rotate the salts of some shops and carry it through: ledger, then shop table, then snapshot entries.

    Only files of these shops are read and written. A run that stopped anywhere is repeated with
    the same ``new_salts`` (shop_id, salt_hex) and ends alike; then nothing changes any more.
    """
    # Whatever made the salts, a repeated task must see the same ones.
    new_salts = written(new_salts.select("shop_id", "salt_hex"), "salts")
    named = shops_in(new_salts)
    turned = ledger_ops.turn_salts(read_table(spark, f"{tables_root}/shops"), new_salts)
    rewrite_shops(spark, ledger_path, named, lambda rows: ledger_ops.rehash(rows, turned))
    replace_table(turned, f"{tables_root}/shops")
    rebuild_entries(ledger_path, turned, offers, entries_root, named)


def change_stored_offers(spark: SparkSession, changes: DataFrame, tables_root: str, ledger_path: str, entries_root: str) -> None:
    """Apply changes of status, mode and archiving to the stored offers, then rebuild the snapshot entries of their shops.

    Entries of an archived offer go, those of one taken out of the archive come back from the ledger.
    """
    changes = written(changes, "changes")
    before = read_table(spark, f"{tables_root}/offers")
    touched = shops_in(before.join(changes.select("offer_id"), "offer_id", "left_semi"))
    after = ledger_ops.change_offers(before, changes)
    replace_table(after, f"{tables_root}/offers")
    rebuild_entries(ledger_path, read_table(spark, f"{tables_root}/shops"), after, entries_root, touched)


def run_backfill(spark: SparkSession, history_path: str, shops: DataFrame, offers: DataFrame, ledger_path: str, checkpoint: str, rejected_path: str, files_per_batch: int = 64):
    """Start a backfill from files of historical orders (``HISTORY_SCHEMA``), newest files first; it ends when all are read.

    Its progress is the stream's checkpoint: stopped and started again it goes on behind the last
    batch, and a batch begun before is written again over its own rows. Each batch reads of the
    ledger the folders of its shops and adds what they lack. All rows are also stored as checked, with the reason
    where one is no order, under ``rejected_path``. One writer of the ledger at a time.
    """
    raw = spark.readStream.schema(HISTORY_SCHEMA).option("latestFirst", "true").option("maxFilesPerTrigger", files_per_batch).parquet(history_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = f"backfill-{batch_id}"
        checked = written(check_orders(batch, history=True), "history")
        store_checked(checked, rejected_path, name)
        orders = checked.filter(F.col("reason").isNull()).drop("reason", "raw_payload")
        matched = written(ledger_ops.first_by(linkage.match_codes(orders, offers), ledger_ops.UNIQUE, "created_at", "record_id"), "matched")
        stored = read_ledger(batch.sparkSession, ledger_path, LEDGER_SCHEMA, name, shops_in(matched))
        new = matched if stored is None else ledger_ops.not_in_ledger(matched, stored)
        append_ledger(ledger_ops.seal(derive(new, shops), shops), ledger_path, name)

    return raw.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _complete(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Requests that the events carried out become completed, at the event's time."""
    # The erasure of a shop names no customer and settles all of its requests of that kind.
    whole = F.col("topic") == "shop/redact"
    who = F.when(whole, F.lit("")).otherwise(F.coalesce(F.concat(F.lit("c:"), "customer_gid"), F.lit(""))).alias("_who")
    done = events.groupBy("topic", "shop_id", who).agg(F.max("received_at").alias("_at"))
    out = requests.withColumn("_who", who).join(done, ["topic", "shop_id", "_who"], "left")
    due = F.col("_at").isNotNull() & (F.col("status") != "completed")
    out = out.withColumn("completed_at", F.when(due, F.col("_at")).otherwise(F.col("completed_at")))
    return out.withColumn("status", F.when(due, "completed").otherwise(F.col("status"))).select(requests.columns)


def run_governance(
    events: DataFrame, tables_root: str, checkpoint: str, live: dict[str, str] | None = None, offers: DataFrame | None = None, entries_root: str | None = None
):
    """Start the stream of lifecycle and compliance events.

    ``events``: topic, shop_id, customer_gid, received_at. Copy-on-write tables under
    ``tables_root``: shops, and where they exist ledger, flags, jobs and requests. ``live`` names
    the paths ``ledger`` and ``flags`` that scoring appends to. Uninstall and reinstall stamp the
    shop and uninstall cancels its pending jobs; erasure nulls a customer's values; a shop erasure
    removes the shop from every table; both rebuild the snapshot entries of the shops they touch,
    and complete their requests. In live tables only files of touched shops are written.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = written(batch, "governance")
        # One read tells which tables the batch touches, so the others are not rewritten.
        topics = {r.topic for r in stored.select("topic").distinct().collect()}
        found = {name: read_table(spark, f"{tables_root}/{name}") for name in ("shops", "ledger", "flags", "jobs", "requests")}
        tables = {name: df for name, df in found.items() if df is not None}
        changed = set()
        if topics & {"app/uninstalled", "app/installed"}:
            tables["shops"] = ledger_ops.apply_shop_events(tables["shops"], stored)
            changed.add("shops")
            if "jobs" in tables and "app/uninstalled" in topics:
                tables["jobs"] = ledger_ops.cancel_pending(tables["jobs"], tables["shops"])
                changed.add("jobs")
        # The shops that a compliance batch names are few.
        shops_of = lambda topic: [r.shop_id for r in stored.filter(F.col("topic") == topic).select("shop_id").distinct().collect()] if topic in topics else []
        erased, purged = shops_of("customers/redact"), shops_of("shop/redact")
        for name, columns, row_id in (("ledger", ledger_ops.PERSONAL, "record_id"), ("flags", ["customer_gid"], "order_gid")):
            clear = lambda rows, columns=columns, row_id=row_id: ledger_ops.redact(rows, stored, columns, row_id)
            if erased and name in tables:
                tables[name] = clear(tables[name])
                changed.add(name)
            if live and erased:
                rewrite_shops(spark, live[name], erased, clear)
            if live and purged:
                drop_shops(spark, live[name], purged)
        if "requests" in tables and (erased or purged):
            tables["requests"] = _complete(tables["requests"], stored)
            changed.add("requests")
        if purged:
            kept = [name for name in tables if name != "requests"]
            tables |= ledger_ops.purge_shops({name: tables[name] for name in kept}, stored.filter(F.col("topic") == "shop/redact"))
            changed |= set(kept)
        if live and entries_root and (erased or purged):
            rebuild_entries(live["ledger"], tables["shops"], offers, entries_root, sorted({*erased, *purged}))
        for name in sorted(changed):
            replace_table(tables[name], f"{tables_root}/{name}")

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
