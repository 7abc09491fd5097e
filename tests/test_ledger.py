"""Ledger jobs that the registered queries do not reach."""

import tempfile

from pyspark.sql import functions as F

from oncekeep.operators import ledger as ops
from oncekeep.operators import reports
from oncekeep.sources import tables
from oncekeep.streaming import jobs


def test_shredded_keys_open_nothing(spark):
    shops = spark.createDataFrame([("s1", "11" * 32), ("s2", "22" * 32)], "shop_id string, key_hex string")
    after = ops.shred_keys(shops, shops.filter("shop_id = 's1'"))
    assert {r.shop_id: r.key_hex for r in after.collect()} == {"s1": None, "s2": "22" * 32}
    sealed = shops.select("shop_id", ops.crypto.encrypt(F.lit("x"), F.unhex("key_hex")).alias("c"))
    opened = sealed.join(after, "shop_id").select("shop_id", ops.crypto.decrypt(F.col("c"), F.unhex("key_hex")).alias("p"))
    assert {r.shop_id: r.p for r in opened.collect()} == {"s1": None, "s2": "x"}


def test_requests_complete_once(spark):
    rows = [("a", "customers/redact", "pending", None), ("b", "customers/redact", "completed", 5), ("c", "shop/redact", "pending", None)]
    df = spark.createDataFrame(rows, "request_id string, topic string, status string, t long").withColumn("completed_at", F.timestamp_seconds("t")).drop("t")
    got = {r.request_id: (r.status, r.s) for r in ops.complete_requests(df, "customers/redact", "1970-01-01 00:01:40").withColumn("s", F.unix_timestamp("completed_at")).collect()}
    assert got == {"a": ("completed", 100), "b": ("completed", 5), "c": ("pending", None)}


def test_deliveries_already_logged_are_dropped(spark):
    df = spark.createDataFrame([("a", "p", 1), ("a", "p", 2), ("b", "q", 3)], "webhook_gid string, payload string, received_at long")
    got = ops.dedupe_deliveries(df, df.filter("webhook_gid = 'b'")).collect()
    assert [(r.webhook_gid, r.received_at) for r in got] == [("a", 1)] and len(got[0].payload_sha256) == 64


def test_repeated_batch_replaces_itself(spark):
    path = tempfile.mkdtemp(prefix="oncekeep-test-") + "/ledger"
    make = lambda a, b: spark.range(a, b).select("id", F.lit("s").alias("shop_id"), F.timestamp_seconds("id").alias("created_at"))
    tables.append_ledger(make(0, 5), path, 0)
    tables.append_ledger(make(5, 9), path, 1)
    tables.append_ledger(make(5, 9), path, 1)
    schema = "id bigint, created_at timestamp, shop_id string"
    assert sorted(r.id for r in tables.read_ledger(spark, path, schema).collect()) == list(range(9))
    assert sorted(r.id for r in tables.read_ledger(spark, path, schema, but_not=1).collect()) == list(range(5))


def test_merged_batches(spark):
    path, schema = tempfile.mkdtemp(prefix="oncekeep-test-") + "/ledger", "id bigint, created_at timestamp, shop_id string"
    shop = F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))
    make = lambda a, b: spark.range(a, b).select("id", shop.alias("shop_id"), F.timestamp_seconds("id").alias("created_at"))
    ids = lambda **how: sorted(r.id for r in tables.read_ledger(spark, path, schema, **how).collect())
    assert tables.read_ledger(spark, path, schema) is None and tables.merge_ledger(spark, path, schema) is None
    for i in range(12):
        tables.append_ledger(make(10 * i, 10 * i + 10), path, i)
    assert tables.merge_ledger(spark, path, schema) == 1 and tables.merge_ledger(spark, path, schema) is None
    files = spark.read.parquet(f"{path}/_merged/version=1").inputFiles()
    assert ids() == list(range(120)) and len(files) <= 3 * 8 and not [n for n in tables._children(spark, path) if n.startswith("batch=")]
    assert ids(but_not=3) == [i for i in range(120) if i // 10 != 3] and ids(shop_ids=["s1"]) == [i for i in range(120) if i % 3 == 1]
    # a batch repeated after the merge replaces its own rows, before and after the next merge
    tables.append_ledger(make(30, 35), path, 3)
    tables.append_ledger(make(120, 130), path, 12)
    want = [i for i in range(130) if not 35 <= i < 40]
    assert ids() == want and ids(but_not=3) == [i for i in want if i // 10 != 3]
    assert tables.merge_ledger(spark, path, schema) == 2 and ids() == want and tables.versions(spark, f"{path}/_merged") == [2]
    # a reader between the new version and the deletion of the loose files sees each row once
    tables.append_ledger(make(130, 140), path, 13)
    commit = next(n for n in tables._children(spark, f"{path}/_commits") if n.startswith("13@"))
    tables.merge_ledger(spark, path, schema)
    make(130, 140).withColumn("month", F.date_format("created_at", "yyyy-MM")).write.partitionBy("shop_id", "month").parquet(f"{path}/batch=13")
    open(f"{path}/_commits/{commit}", "w").close()
    assert ids() == want + list(range(130, 140))
    # erasure and purge reach merged rows
    tables.rewrite_shops(spark, path, ["s1"], lambda df: df.filter("id >= 60"))
    tables.drop_shops(spark, path, ["s2"])
    assert ids() == [i for i in [*want, *range(130, 140)] if i % 3 == 0 or (i % 3 == 1 and i >= 60)]


def test_table_replaced_shop_by_shop(spark):
    root = tempfile.mkdtemp(prefix="oncekeep-test-") + "/entries"
    rows = lambda shops, value: spark.createDataFrame([(s, value) for s in shops], "shop_id string, value int")
    names = [f"s{i}" for i in range(100)]
    assert tables.read_shops(spark, root) is None
    tables.put_shops(rows(names, 1), rows(names, 1), root)
    tables.put_shops(rows(["s7"], 2), rows(["s7"], 2), root)
    assert [f for f in spark.read.parquet(f"{root}/data/gen=2").inputFiles() if "shop_id=s7/" not in f] == []
    tables.put_shops(rows([], 3), rows(["s8"], 3), root)
    want = {(s, 2 if s == "s7" else 1) for s in names if s != "s8"}
    get = lambda **how: {(r.shop_id, r.value) for r in tables.read_shops(spark, root, **how).collect()}
    assert get() == want and get(shop_ids=["s7", "s8"]) == {("s7", 2)}
    # rows without a manifest never took place
    rows(["s9"], 9).write.partitionBy("shop_id").parquet(f"{root}/data/gen=4")
    assert get() == want
    tables.put_shops(rows(names, 5), rows(names, 5), root)
    tables.clear_generations(spark, root)
    assert get() == {(s, 5) for s in names} and tables.versions(spark, f"{root}/manifest") == [4]


def test_late_events_change_nothing(spark):
    shops = spark.createDataFrame([("a", None), ("b", None)], "shop_id string, uninstalled_at timestamp")
    event = lambda *rows: spark.createDataFrame(rows, "shop_id string, topic string, event_id string, t long").withColumn("received_at", F.timestamp_seconds("t"))
    state = lambda df: {r.shop_id: r.t for r in df.select("shop_id", F.unix_timestamp("uninstalled_at").alias("t")).collect()}
    one = ops.apply_shop_events(shops, event(("a", "app/uninstalled", "e1", 5), ("a", "app/installed", "e2", 9), ("b", "app/uninstalled", "e3", 7)))
    assert state(one) == {"a": None, "b": 7}
    late = ops.apply_shop_events(one, event(("a", "app/uninstalled", "e4", 8), ("b", "app/uninstalled", "e3", 7)))
    assert state(late) == {"a": None, "b": 7}
    assert state(ops.apply_shop_events(late, event(("a", "app/uninstalled", "e5", 10), ("b", "app/installed", "e6", 8)))) == {"a": 10, "b": None}


def test_each_field_takes_its_last_change(spark):
    offers = spark.createDataFrame([("o", "active", "block", None), ("p", "active", "block", 3)], "offer_id string, status string, mode string, t long")
    offers = offers.withColumn("archived_at", F.timestamp_seconds("t")).drop("t")
    rows = [("o", "inactive", None, None, None, 1), ("o", None, "watch", None, None, 2), ("o", None, None, 7, None, 3), ("p", None, None, None, False, 1)]
    changes = spark.createDataFrame(rows, "offer_id string, status string, mode string, t long, archived boolean, changed_at int").withColumn("archived_at", F.timestamp_seconds("t"))
    got = {r.offer_id: (r.status, r.mode, r.t) for r in ops.change_offers(offers, changes).withColumn("t", F.unix_timestamp("archived_at")).collect()}
    assert got == {"o": ("inactive", "watch", 7), "p": ("active", "block", None)}


def test_requests_keep_their_rows(spark):
    """A shop erasure that two events name, and two alike requests: each request stays one row with one time."""
    asked = [("r1", "s", "shop/redact", None, "pending"), ("r2", "s", "customers/redact", "c", "pending"), ("r2", "s", "customers/redact", "c", "pending"), ("r3", "t", "customers/redact", None, "pending")]
    requests = spark.createDataFrame(asked, "request_id string, shop_id string, topic string, customer_gid string, status string").withColumn("completed_at", F.lit(None).cast("timestamp"))
    done = [("shop/redact", "s", "c", 5), ("shop/redact", "s", "d", 6), ("customers/redact", "s", "c", 7)]
    events = spark.createDataFrame(done, "topic string, shop_id string, customer_gid string, t long").withColumn("received_at", F.timestamp_seconds("t"))
    got = sorted((r.request_id, r.status, r.t) for r in jobs._complete(requests, events).withColumn("t", F.unix_timestamp("completed_at")).collect())
    assert got == [("r1", "completed", 6), ("r2", "completed", 7), ("r2", "completed", 7), ("r3", "pending", None)]


def test_pages_and_search(spark):
    df = spark.range(45).select("id", F.concat(F.lit("Shop-"), F.col("id").cast("string")).alias("name"))
    assert [r.id for r in reports.page(df, [F.col("id").desc()], 3, 20).collect()] == [4, 3, 2, 1, 0]
    assert tuple(reports.page_count(df, 20).first()) == (45, 3) and reports.page_count(df.filter("id < 0"), 20).first().pages == 1
    assert reports.search(df, "sHOP-44", "name").count() == 1 and reports.search(df, "shop", "name", any_case=False).count() == 0
