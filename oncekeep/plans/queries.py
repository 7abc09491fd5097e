"""The registered queries: each reads whole given tables and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto, hashing, ip, sketch, text
from ..operators import ledger as ops
from ..operators import linkage, reports, screening, snapshot
from ..operators.signals import HASHES, derive
from ..session import written
from ..sources.orders import check_orders as checked
from . import fixtures as fx

EVENTS_NOW = "2024-01-30 12:00:00"
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _text(col: str | Column) -> Column:
    return F.concat_ws(",", col)


def _matched(spark, d) -> DataFrame:
    return linkage.match_codes(fx.orders(spark, d), fx.offers(spark, d))


def _with_signals(spark, d):
    shops = fx.shops(spark, d)
    return lambda df: derive(df, shops)


def _records(spark, d) -> DataFrame:
    """Matched orders with their signals."""
    return _with_signals(spark, d)(_matched(spark, d))


# -- signals ---------------------------------------------------------------------------------


@query
def canonical_email(spark, d):
    return fx.orders(spark, d).select("record_id", text.canonical_email(F.col("email")).alias("canonical_email"))


@query
def canonical_phone(spark, d):
    plain, local = text.canonical_phone(F.col("phone")), text.canonical_phone(F.col("phone"), F.lit("+1"))
    return fx.orders(spark, d).select("record_id", plain.alias("canonical_phone"), local.alias("phone_with_prefix"))


@query
def address_keys(spark, d):
    lines = fx.orders(spark, d).select(
        "record_id", *[text.normalize_line(F.col(f"address.{c}")).alias(n) for c, n in (("address1", "n1"), ("address2", "n2"), ("zip", "z"))], "address.country"
    )
    n1, n2, z, cc = (F.col(c) for c in ("n1", "n2", "z", "country"))
    return lines.select("record_id", text.address_full_key(n1, n2, z, cc).alias("full_key"), text.address_house_key(n1, z, cc).alias("house_key"))


@query
def ip_prefix(spark, d):
    keyed = fx.orders(spark, d).select("record_id", ip.ip_key(F.col("ip")).alias("ip_key"))
    return keyed.withColumn("ip_tag", ip.ip_tag(F.col("ip_key")))


@query
def email_trigrams(spark, d):
    canonical = fx.orders(spark, d).select("record_id", text.canonical_email(F.col("email")).alias("e")).filter("e is not null")
    return canonical.select("record_id", _text(sketch.email_trigrams(F.col("e"))).alias("trigrams"))


@query
def address_trigrams(spark, d):
    lines = fx.orders(spark, d).select("record_id", text.normalize_line(F.col("address.address1")).alias("n1"), "address.zip", F.upper("address.country").alias("cc"))
    return lines.select("record_id", _text(sketch.address_trigrams(F.col("n1"), F.col("zip"), F.col("cc"))).alias("trigrams"))


@query
def fnv_lookup_hash(spark, d):
    shops = fx.shops(spark, d)
    return derive(fx.orders(spark, d), shops).select("record_id", *[hashing.hex8(F.col(c)).alias(c) for c in HASHES])


@query
def minhash_sketch(spark, d):
    got = derive(fx.orders(spark, d), fx.shops(spark, d))
    return got.select("record_id", _text("email_sketch").alias("email_sketch"), sketch.sketch_hex(F.col("address_sketch")).alias("address_sketch"))


@query
def check_orders(spark, d):
    """Raw payloads as orders, or with the reason why not."""
    got = checked(fx.raw_orders(spark, d))
    sound = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    return got.select(
        "record_id", "reason", *[sound(c).alias(n) for n, c in (("order_gid", "order_gid"), ("phone", "phone"), ("ip", "ip"), ("ship1", "address.address1"), ("bill1", "billing.address1"))],
        F.when(F.col("reason").isNull(), F.col("codes")[1]).alias("code"), F.col("raw_payload").isNotNull().alias("has_payload"),
    )


# -- linkage ---------------------------------------------------------------------------------


@query
def match_codes(spark, d):
    return _matched(spark, d).select("record_id", "shop_id", "offer_id", "code_used", "offer_mode")


@query
def exact_candidates(spark, d):
    return linkage.candidate_groups(_records(spark, d))


@query
def recent_candidates(spark, d):
    return linkage.recent_windows(_matched(spark, d))


@query
def fuzzy_best(spark, d):
    """Similarity of emails and addresses alone, to all earlier records: every exact signal is left out."""
    derived = _with_signals(spark, d)
    sketches_only = lambda df: derived(df).withColumns({c: F.lit(None).cast("long") for c in HASHES})
    got = linkage.best_matches(_matched(spark, d), derive=sketches_only, window=None)
    return got.select("offer_id", "record_id", F.col("score").cast("long").alias("score"), _text("facts").alias("facts"))


def _scored(spark, d) -> DataFrame:
    return linkage.best_matches(_matched(spark, d), derive=_with_signals(spark, d))


@query
def score_orders(spark, d):
    return _scored(spark, d).select("offer_id", "record_id", F.col("score").cast("long").alias("score"), _text("facts").alias("facts"))


@query
def score_orders_hot(spark, d):
    """The same scores with nearly every shared key taken as hot, so without listing its pairs."""
    got = linkage.best_matches(_matched(spark, d), derive=_with_signals(spark, d), pair_limit=8)
    return got.select("offer_id", "record_id", F.col("score").cast("long").alias("score"), _text("facts").alias("facts"))


def _attributed(spark, d, **limits) -> tuple[DataFrame, DataFrame]:
    placed = linkage.place_records(_matched(spark, d), derive=_with_signals(spark, d))
    return placed, linkage.best_of(placed, **limits)


@query
def match_attribution(spark, d):
    """All earlier records behind each score."""
    placed, scored = _attributed(spark, d)
    got = linkage.attribution(placed, scored)
    return got.select("offer_id", "record_id", _text(F.transform("matched_ids", lambda x: x.cast("string"))).alias("matched_ids"))


@query
def flagged_orders(spark, d):
    orders = fx.orders(spark, d).select("record_id", "shop_id", "order_gid", "customer_gid")
    flags = linkage.flagged_orders(_scored(spark, d).join(orders, "record_id"))
    return flags.select("shop_id", "order_gid", "offer_id", "customer_gid", "risk_level", F.col("score").cast("long").alias("score"), _text("facts").alias("facts"))


# -- ledger ----------------------------------------------------------------------------------


def _seconds(name: str, alias: str | None = None) -> Column:
    return F.unix_timestamp(name).alias(alias or name)


@query
def backfill_new(spark, d):
    known = fx.redemptions(spark, d).filter(F.col("record_id") % 3 == 0)
    return ops.backfill(fx.orders(spark, d), fx.offers(spark, d), known).select("record_id", "shop_id", "order_gid", "offer_id", "code_used", _seconds("created_at"))


@query
def dedupe_deliveries(spark, d):
    got = ops.dedupe_deliveries(fx.deliveries(spark, d))
    return got.select("webhook_gid", "topic", "payload_sha256", F.unix_micros("received_at").alias("received_at"))


@query
def retention_keep(spark, d):
    return ops.retention_keep(fx.redemptions(spark, d), fx.shops(spark, d), fx.NOW).select("record_id", "shop_id", _seconds("created_at"))


@query
def redact_customers(spark, d):
    """Erase the requested customers from the ledger (hashes and sketches) and from the flags."""
    got = ops.redact(derive(fx.orders(spark, d), fx.shops(spark, d)), fx.requests(spark, d), ops.PERSONAL)
    return got.select("record_id", "customer_gid", "email_hash", "billing_full_hash", _text("address_sketch").alias("address_sketch"))


@query
def redact_flags(spark, d):
    got = ops.redact(fx.flags(spark, d), fx.requests(spark, d), ["customer_gid"], "order_gid")
    return got.select("order_gid", "customer_gid", F.col("score").cast("long").alias("score"))


@query
def purge_shop(spark, d):
    gone = fx.shops(spark, d).filter(F.col("uninstalled_at").isNotNull())
    kept = ops.purge_shops({"ledger": fx.redemptions(spark, d), "flags": fx.flags(spark, d)}, gone)
    rows = [df.select(F.lit(name).alias("table_name"), "shop_id", "order_gid") for name, df in kept.items()]
    return rows[0].unionByName(rows[1])


def _sealed(spark, d) -> DataFrame:
    shops = fx.shops(spark, d)
    offer = F.concat("shop_id", F.lit(":"), F.substring(F.col("codes")[1], 8, 1))
    orders = fx.orders(spark, d).withColumn("offer_id", offer).withColumn("code_used", F.col("codes")[1])
    return ops.seal(derive(orders, shops), shops)


@query
def backfill_ip(spark, d):
    """Every fifth row lost its IP hash and gets it back from the encrypted IP."""
    lost = _sealed(spark, d).withColumn("ip_hash", F.when(F.col("record_id") % 5 != 0, F.col("ip_hash")))
    return ops.backfill_ip(lost, fx.shops(spark, d)).select("record_id", "ip_hash", "ip_tag")


@query
def backfill_billing(spark, d):
    """Half of the rows lost their billing slot and get it back where billing differs from shipping."""
    lost = F.col("record_id") % 2 == 0
    bare = _sealed(spark, d).withColumns({c: F.when(~lost, F.col(c)) for c in ("billing_ciphertext", "billing_full_hash")})
    got = ops.backfill_billing(bare, fx.orders(spark, d), fx.shops(spark, d))
    return got.select("record_id", "billing_full_hash", F.col("billing_ciphertext").isNotNull().alias("has_cipher"))


@query
def rotate_salt(spark, d):
    """Shops 0 to 2 get a new salt; all their records are hashed again from their envelopes."""
    new = fx.shops(spark, d).filter(F.col("shop_id") <= "shop_2").select("shop_id", F.md5(F.concat(F.lit("new:"), "shop_id")).alias("salt_hex"))
    rows, _ = ops.rotate_salt(_sealed(spark, d), fx.shops(spark, d), new)
    return rows.select("record_id", *HASHES, _text("email_sketch").alias("email_sketch"), _text("address_sketch").alias("address_sketch"))


@query
def rotate_salt_versions(spark, d):
    shops = fx.shops(spark, d).join(fx.redemptions(spark, d).select("shop_id").distinct(), "shop_id")
    new = shops.filter(F.col("shop_id") <= "shop_2").select("shop_id", F.md5(F.concat(F.lit("new:"), "shop_id")).alias("salt_hex"))
    _, after = ops.rotate_salt(_sealed(spark, d), shops, new)
    return after.select("shop_id", "salt_hex", F.col("salt_version").cast("long").alias("salt_version"))


@query
def encrypt_roundtrip(spark, d):
    """Sealed and opened again; the random IV leaves no trace in the values."""
    opened = ops.unseal(_sealed(spark, d), fx.shops(spark, d))
    return opened.select("record_id", "email", "phone", "address.address1", "ip", (F.length("email_ciphertext") > 0).alias("sealed"))


@query
def rewrap_keys(spark, d):
    """One data key per customer moves from an old to a new wrapping key."""
    old, new = F.unhex(F.lit("aa" * 32)), F.unhex(F.lit("bb" * 32))
    keys = fx.table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("dek"))
    wrapped = keys.withColumn("wrapped", crypto.encrypt(F.col("dek"), old))
    return wrapped.select("c_custkey", (crypto.decrypt(crypto.rewrap(F.col("wrapped"), old, new), new) == F.col("dek")).alias("kept"))


@query
def export_subject(spark, d):
    """Items of each data request, one row per item (the envelopes group these)."""
    lines = ops.export_lines(fx.requests(spark, d), fx.redemptions(spark, d), fx.flags(spark, d))
    return lines.select("request_id", "customer_gid", "kind", "order_gid")


@query
def export_envelopes(spark, d):
    lines = ops.export_lines(fx.requests(spark, d), fx.redemptions(spark, d), fx.flags(spark, d))
    got = ops.export_envelopes(lines, fx.NOW).withColumn("j", F.from_json("envelope", "customerGid string, generatedAt string, redemptions array<struct<order_gid string>>, flaggedOrders array<struct<order_gid string>>"))
    return got.select(
        "request_id", F.col("j.customerGid").alias("customer_gid"), F.col("j.generatedAt").alias("generated_at"),
        _text("j.redemptions.order_gid").alias("redemptions"), _text("j.flaggedOrders.order_gid").alias("flagged"),
    )


@query
def export_decrypted(spark, d):
    """The same from the sealed ledger, with the personal values opened."""
    lines = ops.export_lines(fx.requests(spark, d), _sealed(spark, d), fx.flags(spark, d), fx.shops(spark, d))
    item = F.from_json("item", "email string, phone string, address struct<address1: string>, ip string, score int")
    got = lines.withColumn("i", item)
    return got.select("request_id", "kind", "order_gid", "i.email", "i.phone", F.col("i.address.address1").alias("address1"), "i.ip", F.col("i.score").cast("long").alias("score"))


@query
def archive_logs(spark, d):
    return ops.archive_keep(fx.deliveries(spark, d), "received_at", 10, EVENTS_NOW).select("webhook_gid", F.unix_micros("received_at").alias("received_at"))


@query
def dispose_flags(spark, d):
    """Two actions per third flag; the later one wins."""
    flags = fx.flags(spark, d)
    base = flags.filter(F.col("score") % 3 == 0).select("shop_id", "order_gid", "created_at")
    act = lambda days, name: base.select("shop_id", "order_gid", F.lit(name).alias("action"), (F.col("created_at") + F.make_interval(days=F.lit(days))).alias("acted_at"))
    got = ops.dispose_flags(flags, act(1, "dismissed").unionByName(act(2, "confirmed")))
    return got.select("order_gid", "merchant_action", _seconds("merchant_action_at"))


@query
def settle_dead_letters(spark, d):
    jobs = fx.jobs(spark, d)
    actions = jobs.filter(F.col("job_id") % 4 != 0).select(
        "job_id", F.when(F.col("job_id") % 2 == 0, "retry").otherwise("archive").alias("action"), F.to_timestamp(F.lit(EVENTS_NOW)).alias("acted_at")
    )
    got = ops.settle_dead_letters(jobs, actions)
    return got.select("job_id", "status", F.col("attempts").cast("long").alias("attempts"), F.unix_micros("completed_at").alias("completed_at"))


@query
def uninstall_shops(spark, d):
    """Events as install and uninstall messages; the latest one per merchant decides."""
    events = fx.table(spark, d, "events").select(
        F.col("user_id").alias("shop_id"),
        F.when(F.col("event_type") == "error", "app/uninstalled").when(F.col("event_type") == "signup", "app/installed").otherwise("other").alias("topic"),
        F.col("ts").alias("received_at"),
    )
    got = ops.apply_shop_events(fx.merchants(spark, d), events)
    return got.select("shop_id", F.unix_micros("uninstalled_at").alias("uninstalled_at"))


@query
def cancel_pending(spark, d):
    got = ops.cancel_pending(fx.jobs(spark, d), fx.shops(spark, d))
    return got.groupBy("shop_id", "status").agg(F.count("*").alias("n"), F.count("completed_at").alias("completed"))


@query
def change_offers(spark, d):
    """Each order is a change of its offer, to some fields; the latest one of each field decides."""
    k = F.col("record_id")
    changes = fx.redemptions(spark, d).select(
        "offer_id", F.when(k % 2 == 0, "inactive").alias("status"), F.when(k % 3 == 0, "watch").alias("mode"),
        F.when(k % 7 == 0, F.col("created_at")).alias("archived_at"), F.when(k % 7 == 0, True).when(k % 7 == 1, False).alias("archived"),
        F.struct("created_at", "record_id").alias("changed_at"),
    )
    return ops.change_offers(fx.offers(spark, d), changes).select("offer_id", "status", "mode", F.col("archived_at").isNotNull().alias("archived"))


@query
def redeemer_tags(spark, d):
    return ops.redeemer_tags(fx.redemptions(spark, d), fx.requests(spark, d))


# -- snapshot and screening ------------------------------------------------------------------


def _newest(spark, d) -> DataFrame:
    """Matched orders that can reach a snapshot, with their signals."""
    return _with_signals(spark, d)(snapshot.newest_records(_matched(spark, d), fx.shops(spark, d)))


def _entries(spark, d) -> DataFrame:
    return snapshot.snapshot_entries(_newest(spark, d), fx.offers(spark, d))


@query
def snapshot_evict(spark, d):
    kept = snapshot.evict(_entries(spark, d), fx.shops(spark, d))
    return kept.select("shop_id", "record_id", F.col("rank").cast("long").alias("rank"), F.col("bytes").cast("long").alias("bytes"))


@query
def offer_buckets(spark, d):
    got = snapshot.buckets(snapshot.evict(_entries(spark, d), fx.shops(spark, d)))
    return got.select("shop_id", "offer_id", "mode", *[_text(F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("entry_ts", *snapshot.ARRAYS)])


@query
def snapshot_documents(spark, d):
    got = snapshot.rebuild(_newest(spark, d), fx.offers(spark, d), fx.shops(spark, d))
    return got.select("shop_id", F.col("bytes").cast("long").alias("bytes"), "entries", "oldest_ts", "newest_ts", F.md5("document").alias("document_md5"))


@query
def screen_buyers(spark, d):
    """All orders as buyers against the snapshot read back from its documents."""
    shops = fx.shops(spark, d)
    return _screened(spark, d, snapshot.rebuild(_newest(spark, d), fx.offers(spark, d), shops), shops)


def _screened(spark, d, stored: DataFrame, shops: DataFrame) -> DataFrame:
    """All orders as buyers, under the shops' salts, against stored documents."""
    buyers = derive(fx.orders(spark, d), shops).select(
        "shop_id", F.col("record_id").alias("buyer_id"), (F.col("record_id") % 50 == 0).alias("has_tag"),
        *[hashing.hex8(F.col(c)).alias(c) for c in ("phone_hash", "email_hash", "address_full_hash", "address_house_hash")],
    )
    # Screening reads the documents more than once.
    got = screening.screen(buyers, snapshot.parse_documents(written(stored, "documents")))
    return got.select("buyer_id", "offer_id", "mode", F.col("score").cast("long").alias("score"), "blocked")


@query
def screen_after_rotation(spark, d):
    """Shops 0 to 2 get a new salt; their snapshots are made anew from the ledger hashed again."""
    shops = fx.shops(spark, d)
    new = shops.filter(F.col("shop_id") <= "shop_2").select("shop_id", F.md5(F.concat(F.lit("new:"), "shop_id")).alias("salt_hex"))
    rows, turned = ops.rotate_salt(_sealed(spark, d), shops, new)
    return _screened(spark, d, snapshot.rebuild(rows, fx.offers(spark, d), turned), turned)


@query
def screen_after_archiving(spark, d):
    """The first offer of each shop is archived, the fifth is taken out of the archive."""
    offers = fx.offers(spark, d)
    last = F.right("offer_id", F.lit(1))
    changes = offers.filter(last.isin("1", "5")).select(
        "offer_id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("mode"),
        F.to_timestamp(F.lit(fx.NOW)).alias("archived_at"), (last == "1").alias("archived"), F.to_timestamp(F.lit(fx.NOW)).alias("changed_at"),
    )
    after = ops.change_offers(offers, changes)
    records = _with_signals(spark, d)(snapshot.newest_records(linkage.match_codes(fx.orders(spark, d), after), fx.shops(spark, d)))
    return _screened(spark, d, snapshot.rebuild(records, after, fx.shops(spark, d)), fx.shops(spark, d))


# -- reports ---------------------------------------------------------------------------------


@query
def offer_counts_30d(spark, d):
    return reports.offer_counts(fx.offers(spark, d), fx.redemptions(spark, d), fx.flags(spark, d), fx.NOW)


@query
def offer_detail(spark, d):
    return reports.offer_detail(fx.offers(spark, d), fx.redemptions(spark, d), fx.flags(spark, d), fx.NOW)


@query
def recent_offer_flags(spark, d):
    return reports.recent_flags(fx.flags(spark, d)).select("offer_id", "order_gid", F.col("rank").cast("long").alias("rank"))


@query
def platform_dashboard(spark, d):
    return reports.dashboard(
        fx.merchants(spark, d), fx.redemptions(spark, d), fx.flags(spark, d), fx.jobs(spark, d), fx.deliveries(spark, d), fx.requests(spark, d), EVENTS_NOW
    )


@query
def platform_metrics(spark, d):
    return reports.platform_metrics(fx.merchants(spark, d), fx.redemptions(spark, d), fx.flags(spark, d), "2001-07-25 00:00:00")


@query
def shop_overview(spark, d):
    return reports.shop_overview(fx.shops(spark, d), fx.offers(spark, d), fx.redemptions(spark, d), fx.flags(spark, d), fx.deliveries(spark, d), fx.NOW)


def _rollup(spark, d) -> DataFrame:
    sales = fx.merchant_sales(spark, d)
    offers = sales.select("shop_id", "line").distinct()
    return reports.shop_rollup(fx.merchants(spark, d).select("shop_id", "shop_domain"), offers, sales, sales.filter(F.col("flag") == "R"))


@query
def shop_rollup_page(spark, d):
    """Second page of twenty shops by redemptions, among domains that contain 'SHOP-'."""
    found = reports.search(_rollup(spark, d), "SHOP-", "shop_domain")
    return reports.page(found, [F.col("redemptions").desc(), F.col("shop_id")], number=2, size=20)


@query
def shop_page_count(spark, d):
    return reports.page_count(reports.search(fx.merchants(spark, d), "7", "shop_domain"), 20).select("total", F.col("pages").cast("long").alias("pages"))


@query
def shop_lifecycle(spark, d):
    return reports.shop_lifecycle(fx.merchants(spark, d), "2001-06-01 00:00:00").groupBy("lifecycle").agg(F.count("*").alias("n"))


@query
def status_depth(spark, d):
    return reports.status_depth(fx.jobs(spark, d))


@query
def job_list(spark, d):
    """Newest hundred jobs whose type contains 'err'."""
    found = reports.search(fx.jobs(spark, d), "err", "type", any_case=False)
    return reports.newest(found, "created_at", "job_id", 100).select("job_id", "type", "status")


@query
def dead_letters(spark, d):
    return reports.dead_letters(fx.jobs(spark, d)).select("job_id", "payload")


@query
def requests_by_topic(spark, d):
    got = reports.requests_by_topic(fx.requests(spark, d), fx.shops(spark, d))
    return got.select("topic", "n", _text("request_ids").alias("request_ids"))


@query
def request_age(spark, d):
    got = reports.request_age(fx.requests(spark, d), fx.NOW)
    return got.select("request_id", F.col("age_days").cast("long").alias("age_days"), "deadline")


@query
def pending_flags(spark, d):
    return reports.pending_flags(fx.flags(spark, d))


@query
def flag_list_top100(spark, d):
    got = reports.flag_list(fx.flags(spark, d), fx.offers(spark, d))
    return got.select("shop_id", "order_gid", "offer_name", "risk_level", F.col("score").cast("long").alias("score"))


@query
def flag_list_dismissed(spark, d):
    """Each shop's newest dismissed flags of one offer."""
    got = reports.flag_list(fx.flags(spark, d), fx.offers(spark, d), action="dismissed", offer_id="shop_1:2")
    return got.select("shop_id", "order_gid", "offer_name", "risk_level", F.col("score").cast("long").alias("score"))


@query
def find_flag(spark, d):
    """The flag of the shop's first order."""
    flags = fx.flags(spark, d)
    first = flags.filter(F.col("shop_id") == "shop_2").agg(F.min("order_gid")).first()[0]
    got = reports.find_flag(flags, fx.offers(spark, d), "shop_2", first)
    return got.select("order_gid", "offer_name", "code", F.col("score").cast("long").alias("score"))


@query
def code_conflicts(spark, d):
    """Part brands as codes of a shop: many parts share one."""
    offers = fx.table(spark, d, "part").select(
        (F.col("p_partkey") % 5).alias("shop_id"), F.upper("p_brand").alias("code_upper"),
        F.when(F.col("p_partkey") % 3 == 0, F.to_timestamp(F.lit(fx.NOW))).alias("archived_at"),
    )
    return reports.code_conflicts(offers)


@query
def suggest_discounts(spark, d):
    got = reports.suggest_discounts(fx.discounts(spark, d), fx.offers(spark, d))
    return got.select("shop_id", "discount_id", "title", "once_per_customer", F.col("name_score").cast("long").alias("name_score"))


@query
def signal_contribution(spark, d):
    return reports.signal_contribution(fx.flags(spark, d))


@query
def daily_series(spark, d):
    got = reports.daily_series(fx.redemptions(spark, d), fx.flags(spark, d), fx.NOW)
    return got.select(F.col("day").cast("string").alias("day"), "redemptions", "flagged")


@query
def installs_per_day(spark, d):
    return reports.installs_per_day(fx.merchants(spark, d)).withColumn("day", F.col("day").cast("string"))


@query
def retention_cohorts(spark, d):
    got = reports.retention_cohorts(fx.merchants(spark, d), "2001-06-01 00:00:00")
    return got.select(F.col("cohort").cast("string").alias("cohort"), F.col("week").cast("long").alias("week"), "shops", "active")


@query
def hourly_redemptions(spark, d):
    return reports.hourly_redemptions(fx.redemptions(spark, d)).select(F.unix_timestamp("hour").alias("hour"), "redemptions")


@query
def flag_rate_histogram(spark, d):
    sales = fx.merchant_sales(spark, d)
    return reports.flag_rate_histogram(sales, sales.filter(F.col("flag") == "R"))


@query
def latency_percentiles(spark, d):
    return reports.latency_percentiles(fx.deliveries(spark, d), exact=True)


@query
def latency_report(spark, d):
    """Counts and distinct shops from hourly sketches, and whether each percentile's rank is within one hundredth."""
    start, end = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
    log = fx.deliveries(spark, d)
    told = reports.latency_report(reports.latency_sketches(log), start, end)
    within = log.filter((F.col("received_at") >= start) & (F.col("received_at") < end) & F.col("processed_at").isNotNull())
    ms = within.select("topic", (F.unix_millis("processed_at") - F.unix_millis("received_at")).alias("ms")).join(told.select("topic", "p50", "p95", "p99"), "topic")
    # The rank of a value that several rows share is an interval.
    near = lambda c, p: (F.avg((F.col("ms") < F.col(c)).cast("int")) <= p + 0.01) & (F.avg((F.col("ms") <= F.col(c)).cast("int")) >= p - 0.01)
    ranks = ms.groupBy("topic").agg((near("p50", 0.5) & near("p95", 0.95) & near("p99", 0.99)).alias("close"))
    return told.select("topic", "deliveries", "processed", "shops").join(ranks, "topic")


@query
def opened_redemptions(spark, d):
    """Each shop's newest hundred redemptions, opened."""
    got = reports.opened_redemptions(_sealed(spark, d), fx.shops(spark, d))
    return got.select("shop_id", "record_id", "order_name", "code_used", "email", "phone", F.col("address.address1").alias("address1"), _seconds("created_at"))


@query
def setup_status(spark, d):
    """Parts as offers of the merchant with three times their number."""
    offers = fx.table(spark, d, "part").select((F.col("p_partkey") * 3).alias("shop_id"))
    return reports.setup_status(fx.merchants(spark, d), offers, fx.merchant_sales(spark, d))


@query
def offers_not_enforced(spark, d):
    offers = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("offer_id"), F.when(F.col("p_size") > 10, "active").otherwise("inactive").alias("status"),
        (F.col("p_partkey") % 2 == 0).alias("enforced"), F.when(F.col("p_partkey") % 3 == 0, F.to_timestamp(F.lit(fx.NOW))).alias("archived_at"),
    )
    return reports.offers_not_enforced(offers).select("offer_id")


@query
def audit_search(spark, d):
    """Events as audit rows about a user."""
    log = fx.table(spark, d, "events").select(
        "event_id", F.lit("user").alias("target_type"), F.col("user_id").cast("string").alias("target_id"), F.col("ts").alias("created_at")
    )
    return reports.audit_search(log, "2024-01-05", "2024-01-20", "user/7").select("event_id")
