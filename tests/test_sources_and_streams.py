"""Order JSON, table sinks, and streams against batch replay."""

import json
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F


from oncekeep.operators import linkage, snapshot
from oncekeep.operators.signals import derive
from oncekeep.plans import fixtures as fx
from oncekeep.sources import orders as order_source
from oncekeep.sources import tables
from oncekeep.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="oncekeep-test-")


def test_read_orders(spark):
    ship = {"address1": "1 Main St", "zip": "94102", "country_code": "US"}
    bill = {"address1": "2 Side St", "zip": "94103", "country_code": "US"}
    full = {"admin_graphql_api_id": "o1", "name": "#1", "email": "a@b.org", "client_details": {"browser_ip": "1.2.3.4"},
            "discount_codes": [{"code": " welcome "}, {}], "shipping_address": ship, "billing_address": bill,
            "customer": {"admin_graphql_api_id": "c1", "phone": "+14155550123"}}
    only_bill = {"admin_graphql_api_id": "o2", "billing_address": bill, "browser_ip": "9.9.9.9", "phone": "1"}
    raw = spark.createDataFrame([("s", json.dumps(full)), ("s", json.dumps(only_bill)), ("s", "{broken"), ("s", "{}")], "shop_id string, payload string")
    one, two = order_source.read_orders(raw).orderBy("order_gid").collect()
    assert (one.codes, one.ip, one.phone, one.customer_gid, one.address.zip, one.billing.zip) == ([" welcome ", ""], "1.2.3.4", "+14155550123", "c1", "94102", "94103")
    assert (two.address.zip, two.billing, two.ip, two.phone, two.codes) == ("94103", None, "9.9.9.9", "1", [])
    node = {"id": "o3", "billingAddress": {"zip": "1", "countryCodeV2": "VN"}, "discountCodes": ["X"], "clientIp": "::1", "customer": {"id": "c"}}
    three = order_source.read_history(spark.createDataFrame([("s", json.dumps(node))], "shop_id string, payload string")).first()
    assert (three.address.country, three.billing.zip, three.codes, three.ip, three.customer_gid) == ("VN", "1", ["X"], "::1", "c")


def test_table_versions_and_documents(spark, folder):
    assert tables.read_table(spark, f"{folder}/t") is None
    tables.replace_table(spark.range(3), f"{folder}/t")
    tables.replace_table(tables.read_table(spark, f"{folder}/t").filter("id > 0"), f"{folder}/t")
    assert tables.versions(spark, f"{folder}/t") == [1, 2] and tables.read_table(spark, f"{folder}/t").count() == 2
    docs = spark.createDataFrame([("s1", '{"v":2}'), ("s2", "{}")], "shop_id string, document string")
    tables.write_snapshot(docs, f"{folder}/d")
    assert {tuple(r) for r in tables.read_snapshot(spark, f"{folder}/d").collect()} == {("s1", '{"v":2}'), ("s2", "{}")}


def test_delivery_stream_drops_repeats(spark, folder):
    fx.deliveries(spark, SF).repartition(2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    out = jobs.dedupe_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out")
    out.awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == got.select("webhook_gid").distinct().count() == 1000


def test_rolling_counts_equal_batch(spark, folder):
    fx.redemptions(spark, SF).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    query = jobs.rolling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("rolling").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("rolling").agg(F.sum("redemptions"), F.count("*")).first()
    want = fx.redemptions(spark, SF).groupBy("shop_id", F.date_trunc("hour", "created_at")).count().agg(F.sum("count"), F.count("*")).first()
    assert tuple(got) == tuple(want)


def test_scoring_stream_equals_batch_replay(spark, folder):
    shops, offers = fx.shops(spark, SF), fx.offers(spark, SF)
    orders = fx.orders(spark, SF).filter(F.col("record_id") < 600)
    schema = orders.schema
    # three files in order of time, one per micro-batch
    ordered = orders.withColumn("part", F.ntile(3).over(Window.orderBy("created_at", "record_id")))
    for i in (1, 2, 3):
        ordered.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = jobs.run_scoring(stream, shops, offers, f"{folder}/ledger", f"{folder}/flags", f"{folder}/cp", f"{folder}/entries")
    run.trigger(availableNow=True).start().awaitTermination()
    ledger = tables.read_ledger(spark, f"{folder}/ledger", jobs.LEDGER_SCHEMA)
    want = linkage.best_matches(linkage.match_codes(orders, offers), derive=lambda df: derive(df, shops))
    want = {(r.record_id, r.score, tuple(r.facts)) for r in want.filter("score >= 4").join(orders.select("record_id"), "record_id").collect()}
    got = spark.read.parquet(f"{folder}/flags")
    got = {(int(r.order_gid.split("/")[1]), r.score, tuple(r.facts)) for r in got.collect()}
    assert ledger.count() == linkage.match_codes(orders, offers).count() and got == want
    kept = tables.read_shops(spark, f"{folder}/entries")
    whole = snapshot.evict(snapshot.snapshot_entries(ledger, offers), shops)
    key = lambda df: {(r.shop_id, r.record_id, r.bytes) for r in df.collect()}
    assert key(kept) == key(whole)
    # a repeated batch changes nothing
    last = ordered.filter(F.col("part") == 3).drop("part")
    before = key(kept), tables.versions(spark, f"{folder}/entries/manifest")
    new = jobs.score_batch(last, 2, shops, offers, f"{folder}/ledger", f"{folder}/flags")
    jobs.update_snapshots(new, shops, offers, f"{folder}/entries")
    assert (key(tables.read_shops(spark, f"{folder}/entries")), tables.versions(spark, f"{folder}/entries/manifest")) == before
    again = spark.read.parquet(f"{folder}/flags")
    assert {(int(r.order_gid.split("/")[1]), r.score, tuple(r.facts)) for r in again.collect()} == want


def test_governance_stream(spark, folder):
    shops = fx.shops(spark, SF)
    ledger = derive(fx.orders(spark, SF), shops).drop("codes", "address", "billing")
    for name, df in (("shops", shops), ("ledger", ledger), ("flags", fx.flags(spark, SF))):
        tables.replace_table(df, f"{folder}/{name}")
    someone = ledger.filter("customer_gid is not null and shop_id = 'shop_1'").first()
    rows = [("customers/redact", "shop_1", someone.customer_gid, 1), ("app/uninstalled", "shop_2", None, 2), ("shop/redact", "shop_3", None, 3)]
    events = spark.createDataFrame(rows, "topic string, shop_id string, customer_gid string, t long").withColumn("received_at", F.timestamp_seconds("t")).drop("t")
    events.coalesce(1).write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
    jobs.run_governance(stream, folder, f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    after = tables.read_table(spark, f"{folder}/ledger")
    assert after.filter(F.col("shop_id") == "shop_3").count() == 0
    assert after.filter((F.col("shop_id") == "shop_1") & (F.col("customer_gid") == someone.customer_gid)).count() == 0
    cleared = after.filter(F.col("record_id") == someone.record_id).first()
    assert cleared.email_hash is None and cleared.billing_full_hash is None and cleared.address_sketch is None
    stamped = tables.read_table(spark, f"{folder}/shops").filter("shop_id = 'shop_2'").first()
    assert stamped.uninstalled_at is not None and stamped.salt_hex


def test_erasure_reaches_what_scoring_wrote(spark, folder):
    shops, offers = fx.shops(spark, SF), fx.offers(spark, SF)
    orders = fx.orders(spark, SF).filter(F.col("record_id") < 600)
    paths = {name: f"{folder}/{name}" for name in ("ledger", "flags")}
    entries = f"{folder}/entries"
    new = jobs.score_batch(orders, 0, shops, offers, paths["ledger"], paths["flags"])
    jobs.update_snapshots(new, shops, offers, entries)
    before = {r.record_id: r for r in tables.read_ledger(spark, paths["ledger"], jobs.LEDGER_SCHEMA).collect()}
    held = {r.record_id for r in tables.read_shops(spark, entries).collect()}
    one = next(r for r in before.values() if r.shop_id == "shop_1" and r.customer_gid and r.email_hash and r.record_id in held)
    tables.replace_table(shops, f"{folder}/tables/shops")
    tables.replace_table(fx.jobs(spark, SF).limit(500), f"{folder}/tables/jobs")
    asked = [("r1", "shop_1", "customers/redact", one.customer_gid, "pending"), ("r2", "shop_1", "customers/redact", "someone else", "pending"), ("r3", "shop_3", "shop/redact", None, "pending")]
    requests = spark.createDataFrame(asked, "request_id string, shop_id string, topic string, customer_gid string, status string")
    tables.replace_table(requests.withColumn("completed_at", F.lit(None).cast("timestamp")), f"{folder}/tables/requests")
    rows = [("customers/redact", "shop_1", one.customer_gid, 1), ("app/uninstalled", "shop_2", None, 2), ("shop/redact", "shop_3", None, 3)]
    events = spark.createDataFrame(rows, "topic string, shop_id string, customer_gid string, t long").withColumn("received_at", F.timestamp_seconds("t")).drop("t")
    events.coalesce(1).write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
    jobs.run_governance(stream, f"{folder}/tables", f"{folder}/cp", paths, offers, entries).trigger(availableNow=True).start().awaitTermination()

    after = {r.record_id: r for r in tables.read_ledger(spark, paths["ledger"], jobs.LEDGER_SCHEMA).collect()}
    gone = {i for i, r in before.items() if r.shop_id == "shop_1" and r.customer_gid == one.customer_gid}
    assert set(after) == {i for i, r in before.items() if r.shop_id != "shop_3"}
    for i, r in after.items():
        assert (r.email_hash is None and r.customer_gid is None and r.email_ciphertext is None and r.address_sketch is None) if i in gone else r == before[i]
    flags = spark.read.parquet(paths["flags"]).collect()
    assert all(r.shop_id != "shop_3" and not (r.shop_id == "shop_1" and r.customer_gid == one.customer_gid) for r in flags)
    left = tables.read_shops(spark, entries).collect()
    assert not gone & {r.record_id for r in left} and all(r.shop_id != "shop_3" for r in left)
    # Checkout no longer knows the customer's values unless another customer shares them.
    shared = {r.email_hash for i, r in after.items() if r.email_hash}
    buckets = snapshot.buckets(tables.read_shops(spark, entries)).filter("shop_id = 'shop_1'").collect()
    assert one.email_hash in shared or all(f"{one.email_hash:08x}" not in b.email_hashes for b in buckets)
    status = {r.request_id: r.status for r in tables.read_table(spark, f"{folder}/tables/requests").collect()}
    assert status == {"r1": "completed", "r2": "pending", "r3": "completed"}
    work = tables.read_table(spark, f"{folder}/tables/jobs").collect()
    assert all(r.shop_id != "shop_3" for r in work) and not any(r.shop_id == "shop_2" and r.status == "pending" for r in work)


def test_batch_reads_and_writes_its_shops_only(spark, folder):
    shops, offers = fx.shops(spark, SF), fx.offers(spark, SF)
    orders = fx.orders(spark, SF)
    paths = f"{folder}/ledger", f"{folder}/flags", f"{folder}/entries"
    new = jobs.score_batch(orders.filter("record_id < 900"), 0, shops, offers, *paths[:2])
    jobs.update_snapshots(new, shops, offers, paths[2])
    one = orders.filter("record_id >= 900 and shop_id = 'shop_1'")
    stored = tables.read_ledger(spark, paths[0], jobs.LEDGER_SCHEMA, 1, jobs.shops_in(one))
    assert all("shop_id=shop_1/" in f for f in stored.select(F.input_file_name().alias("f")).distinct().toPandas()["f"])
    new = jobs.score_batch(one, 1, shops, offers, *paths[:2])
    jobs.update_snapshots(new, shops, offers, paths[2])
    second = spark.read.parquet(f"{folder}/entries/data/gen=2")
    assert [r.shop_id for r in second.select("shop_id").distinct().collect()] == ["shop_1"]
    whole = snapshot.evict(snapshot.snapshot_entries(tables.read_ledger(spark, paths[0], jobs.LEDGER_SCHEMA), offers), shops)
    key = lambda df: {(r.shop_id, r.record_id, r.bytes) for r in df.collect()}
    assert key(tables.read_shops(spark, paths[2])) == key(whole)
    # scoring goes on over a merged ledger, with the same flags
    flags = spark.read.parquet(paths[1]).filter("batch = 1").count()
    tables.merge_ledger(spark, paths[0], jobs.LEDGER_SCHEMA)
    again = jobs.score_batch(one, 1, shops, offers, *paths[:2])
    assert again.count() == new.count() and spark.read.parquet(paths[1]).filter("batch = 1").count() == flags
    assert key(snapshot.evict(snapshot.snapshot_entries(tables.read_ledger(spark, paths[0], jobs.LEDGER_SCHEMA), offers), shops)) == key(whole)


def test_rejected_orders_keep_reason_and_payload(spark, folder):
    rows = [('{"admin_graphql_api_id":"o1","email":"a@b.org"}', None), ("{broken", "not_json"), (None, "not_json"), ("", "not_json"), ("{}", "no_order_id"), ('{"admin_graphql_api_id":""}', "no_order_id"),
            ('{"admin_graphql_api_id":"o2","discount_codes":true}', "wrong_type"), ('"text"', "wrong_type"), ('{"admin_graphql_api_id":"o1","email":"a@b.org"}', None)]
    raw = spark.createDataFrame([("s", p) for p, _ in rows], "shop_id string, payload string")
    checked = order_source.check_orders(raw)
    assert sorted(map(repr, ((r.raw_payload, r.reason) for r in checked.collect()))) == sorted(map(repr, rows))
    for _ in range(2):
        tables.store_checked(checked, f"{folder}/orders", 1)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in checked.schema)
    good, bad = (tables.read_checked(spark, f"{folder}/orders", schema, flag) for flag in (False, True))
    assert good.count() + bad.count() == len(rows) and [r.order_gid for r in good.collect()] == ["o1", "o1"] and "raw_payload" not in good.columns
    assert sorted(map(repr, ((r.raw_payload, r.reason) for r in bad.collect()))) == sorted(map(repr, (r for r in rows if r[1])))
    assert order_source.check_orders(raw.filter("shop_id = 'none'"), history=True).count() == 0


def _stored(spark, folder):
    """Shops, offers, and a scored ledger with snapshot entries under ``folder``."""
    shops, offers = fx.shops(spark, SF), fx.offers(spark, SF)
    paths = {name: f"{folder}/{name}" for name in ("tables", "ledger", "flags", "entries")}
    new = jobs.score_batch(fx.orders(spark, SF).filter("record_id < 900"), 0, shops, offers, paths["ledger"], paths["flags"])
    jobs.update_snapshots(new, shops, offers, paths["entries"])
    tables.replace_table(shops, f"{paths['tables']}/shops")
    tables.replace_table(offers, f"{paths['tables']}/offers")
    return paths


def _documents(spark, paths):
    shops = tables.read_table(spark, f"{paths['tables']}/shops")
    got = snapshot.documents(snapshot.buckets(tables.read_shops(spark, paths["entries"])), shops)
    return {r.shop_id: r.document for r in got.collect()}


def test_rotation_reaches_the_stored_snapshot(spark, folder):
    paths = _stored(spark, folder)
    before = _documents(spark, paths)
    others = {r.record_id: r for r in tables.read_ledger(spark, paths["ledger"], jobs.LEDGER_SCHEMA).filter("shop_id <> 'shop_1'").collect()}
    new = spark.createDataFrame([("shop_1", "ab" * 16)], "shop_id string, salt_hex string")
    for _ in range(2):
        jobs.rotate_stored(spark, new, paths["tables"], paths["ledger"], fx.offers(spark, SF), paths["entries"])
    shops = tables.read_table(spark, f"{paths['tables']}/shops")
    assert {r.shop_id: r.salt_version for r in shops.collect()} == {f"shop_{i}": 2 if i == 1 else 1 for i in range(5)}
    after = _documents(spark, paths)
    assert {s for s in after if after[s] != before[s]} == {"shop_1"} and "abab" in after["shop_1"]
    ledger = tables.read_ledger(spark, paths["ledger"], jobs.LEDGER_SCHEMA)
    assert {r.record_id: r for r in ledger.filter("shop_id <> 'shop_1'").collect()} == others
    # Hashes of the plain orders under the new salt, in the ledger and in the snapshot.
    fresh = {r.record_id: (r.email_hash, r.address_sketch) for r in derive(fx.orders(spark, SF), shops).collect()}
    mine = ledger.filter("shop_id = 'shop_1'").collect()
    assert mine and all((r.email_hash, r.address_sketch) == fresh[r.record_id] for r in mine)
    whole = snapshot.rebuild(ledger, fx.offers(spark, SF), shops)
    assert after == {r.shop_id: r.document for r in whole.collect()}


def test_archiving_reaches_the_stored_snapshot(spark, folder):
    paths = _stored(spark, folder)
    before = _documents(spark, paths)
    fields = "offer_id string, status string, mode string, archived boolean, t long"
    change = lambda *rows: spark.createDataFrame(list(rows), fields).withColumns({"changed_at": F.timestamp_seconds("t"), "archived_at": F.timestamp_seconds("t")})
    for _ in range(2):
        jobs.change_stored_offers(spark, change(("shop_1:1", None, None, True, 5)), paths["tables"], paths["ledger"], paths["entries"])
    after = _documents(spark, paths)
    assert '"shop_1:1"' in before["shop_1"] and '"shop_1:1"' not in after["shop_1"] and all(after[s] == before[s] for s in after if s != "shop_1")
    jobs.change_stored_offers(spark, change(("shop_1:1", None, None, False, 6)), paths["tables"], paths["ledger"], paths["entries"])
    assert _documents(spark, paths) == before


def test_backfill_goes_on_where_it_stopped(spark, folder):
    shops, offers = fx.shops(spark, SF), fx.offers(spark, SF)
    orders = fx.orders(spark, SF).filter("record_id < 900")
    place = lambda a: F.struct(F.col(f"{a}.address1"), F.col(f"{a}.zip"), F.col(f"{a}.country").alias("countryCodeV2"))
    node = F.to_json(F.struct(F.col("order_gid").alias("id"), F.col("order_name").alias("name"), "email", F.col("ip").alias("clientIp"), F.col("codes").alias("discountCodes"),
                              place("address").alias("shippingAddress"), place("billing").alias("billingAddress"), F.struct("phone").alias("customer")))
    history = orders.select("shop_id", "record_id", "created_at", F.when(F.col("record_id") % 50 == 0, "{broken").otherwise(node).alias("payload")).cache()
    # Half of the files, then a restart of the same checkpoint with all of them, one that repeats rows among them.
    history.filter("record_id < 500").repartition(2).write.parquet(f"{folder}/history")
    run = lambda: jobs.run_backfill(spark, f"{folder}/history", shops, offers, f"{folder}/ledger", f"{folder}/cp", f"{folder}/checked", files_per_batch=1).start().awaitTermination()
    run()
    half = {r.record_id for r in tables.read_ledger(spark, f"{folder}/ledger", jobs.LEDGER_SCHEMA).collect()}
    history.filter("record_id >= 400").repartition(2).write.mode("append").parquet(f"{folder}/history")
    run()
    ledger = tables.read_ledger(spark, f"{folder}/ledger", jobs.LEDGER_SCHEMA)
    sound = linkage.match_codes(orders.filter("record_id % 50 <> 0"), offers)
    want = sorted(r.record_id for r in sound.select("record_id").collect())
    assert sorted(r.record_id for r in ledger.collect()) == want and half == {i for i in want if i < 500}
    rejected = spark.read.parquet(f"{folder}/checked").filter("rejected = 'true'")
    assert {r.reason for r in rejected.collect()} == {"not_json"} and rejected.select("record_id").distinct().count() == history.filter("payload = '{broken'").count()
