"""Snapshot eviction against rendered JSON, tolerant parsing, and screening rules."""

import json
import random

from pyspark.sql import functions as F

from oncekeep.operators import reports, screening, snapshot

FIELDS = list(snapshot.ARRAYS.values())
ENTRY = "shop_id string, offer_id string, mode string, record_id long, ts long, " + ", ".join(f"{f} string" for f in FIELDS)


def random_entries(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        maybe = lambda digits, p: f"{rng.randrange(16**digits):0{digits}x}" if rng.random() < p else None
        offer = rng.randrange(4)
        values = [maybe(32 if f.endswith("sketch") else 8, 0.05 if f == "device" else 0.5) for f in FIELDS]
        rows.append((f"s{rng.randrange(2)}", f"offer-{offer}", "watch" if offer == 3 else "block", i, rng.randrange(999_999_900, 1_000_000_100), *values))
    return rows


def render(rows, salt):
    offers = {}
    for r in sorted(rows, key=lambda r: (r[4], r[3])):
        bucket = offers.setdefault(r[1], {"mode": r[2], "entry_ts": [], **{n: [] for n in snapshot.ARRAYS}})
        bucket["entry_ts"].append(r[4])
        for name, value in zip(snapshot.ARRAYS, r[5:]):
            if value is not None:
                bucket[name].append(value)
    doc = {"v": 2, "salt_hex": salt, "default_country_cc": None, "offers": dict(sorted(offers.items()))}
    return json.dumps(doc, separators=(",", ":"))


def newest_that_fit(rows, salt, cap):
    rows = sorted(rows, key=lambda r: (-r[4], -r[3]))
    while len(render(rows, salt)) > cap:
        rows = rows[:-1]
    return rows


def test_evict_equals_rendered_json(spark):
    shops = spark.createDataFrame([("s0", "ab" * 16, None), ("s1", "cd" * 16, None), ("s2", "ef" * 16, None)], "shop_id string, salt_hex string, default_prefix string")
    salts = {r.shop_id: r.salt_hex for r in shops.collect()}
    for cap in (400, 3_000, 10_240):
        rows = random_entries(cap)
        kept = snapshot.evict(spark.createDataFrame(rows, ENTRY), shops, cap)
        docs = {r.shop_id: r for r in snapshot.documents(snapshot.buckets(kept), shops).collect()}
        for shop in ("s0", "s1", "s2"):
            want = newest_that_fit([r for r in rows if r[0] == shop], salts[shop], cap)
            assert docs[shop].document == render(want, salts[shop])
            assert docs[shop].bytes == len(docs[shop].document) and docs[shop].entries == len(want)
        # adding the second half to the kept first half ends at the same entries
        half = snapshot.evict(spark.createDataFrame([r for r in rows if r[4] < 1_000_000_000], ENTRY), shops, cap)
        both = snapshot.append(half, spark.createDataFrame([r for r in rows if r[4] >= 1_000_000_000], ENTRY), shops, cap)
        assert {r.record_id for r in both.collect()} == {r.record_id for r in kept.collect()}


def test_parsing_tolerates_damage(spark):
    good = {"v": 2, "salt_hex": "00", "offers": {"a": {"mode": "watch", "entry_ts": [1, "x", 2], "phone_hashes": ["A1B2C3D4", "zz", 5], "email_sketches": ["0" * 32, "0" * 8]}, "b": {"mode": "odd"}, "": {}}}
    texts = [json.dumps(good), "{broken", json.dumps({**good, "v": 1}), None, "[]"]
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "shop_id string, document string")
    rows = {(r.shop_id, r.offer_id): r for r in snapshot.parse_documents(df).collect()}
    assert set(rows) == {("s0", "a"), ("s0", "b")}
    a, b = rows["s0", "a"], rows["s0", "b"]
    assert (a.mode, a.entry_ts, a.phone_hashes, a.email_sketches, a.email_hashes) == ("watch", [1, 2], ["a1b2c3d4"], ["0" * 32], [])
    assert (b.mode, b.entry_ts) == ("block", [])
    as_is = snapshot.parse_documents(df, lower=False).filter("offer_id = 'a'").first()
    assert as_is.phone_hashes == ["A1B2C3D4"]


def test_bucket_modes(spark):
    docs = spark.createDataFrame([("s", json.dumps({"v": 2, "offers": {"a": {"mode": "block", "entry_ts": [1]}, "b": {"mode": "block"}}}))], "shop_id string, document string")
    buckets = snapshot.parse_documents(docs).drop("salt_hex", "default_prefix")
    modes = spark.createDataFrame([("s", "a", "watch"), ("s", "c", "watch")], "shop_id string, offer_id string, mode string")
    got = {r.offer_id: (r.mode, r.entry_ts) for r in snapshot.set_modes(buckets, modes).collect()}
    assert got == {"a": ("watch", [1]), "b": ("block", []), "c": ("watch", [])}
    assert {r.offer_id for r in snapshot.drop_buckets(buckets, modes).collect()} == {"b"}


def test_screening_rules(spark):
    h = "0000000{}".format
    offers = {
        "blk": {"mode": "block", "phone_hashes": [h(1)], "email_hashes": [h(2)], "address_full_hashes": [h(3)], "address_house_hashes": [h(4)]},
        "wat": {"mode": "watch", "phone_hashes": [h(1)]},
    }
    docs = spark.createDataFrame([("s", json.dumps({"v": 2, "offers": offers}))], "shop_id string, document string")
    buyers = [("s", "phone", False, h(1), None, None, None), ("s", "house", False, None, None, h(9), h(4)), ("s", "full", False, None, None, h(3), h(4)),
              ("s", "tag", True, None, None, None, None), ("s", "none", False, h(9), h(9), None, None), ("t", "other", True, h(1), None, None, None)]
    df = spark.createDataFrame(buyers, "shop_id string, buyer_id string, has_tag boolean, phone_hash string, email_hash string, address_full_hash string, address_house_hash string")
    got = {(r.buyer_id, r.offer_id): (r.score, r.blocked) for r in screening.screen(df, snapshot.parse_documents(docs)).collect()}
    assert got == {
        ("phone", "blk"): (10, True), ("phone", "wat"): (10, False), ("house", "blk"): (8, False),
        ("full", "blk"): (10, True), ("tag", "blk"): (10, True), ("tag", "wat"): (10, False),
    }


def test_approximate_latency_is_close_to_exact(spark):
    df = spark.range(1, 1001).select(F.lit("t").alias("topic"), F.timestamp_millis(F.lit(0)).alias("received_at"), F.timestamp_millis("id").alias("processed_at"))
    exact, rough = (reports.latency_percentiles(df, exact=e).first() for e in (True, False))
    assert all(abs(a - b) <= 1 for a, b in zip(exact[1:], rough[1:]))


def test_ids_are_escaped_in_documents(spark):
    odd = 'a"b\\c\né'
    shops = spark.createDataFrame([("s", "00" * 16, 'x"')], "shop_id string, salt_hex string, default_prefix string")
    entry = dict.fromkeys(snapshot._FIELDS) | {"phone": "0a0b0c0d"}
    names = ", ".join(f"{n} string" for n in snapshot._FIELDS)
    entries = spark.createDataFrame([("s", odd, "block", 1, 5, *entry.values())], f"shop_id string, offer_id string, mode string, record_id long, ts long, {names}")
    kept = snapshot.evict(entries, shops)
    stored = snapshot.documents(snapshot.buckets(kept), shops)
    row = stored.first()
    assert list(json.loads(row.document)["offers"]) == [odd] and json.loads(row.document)["default_country_cc"] == 'x"'
    assert row.bytes == kept.first().bytes == len(row.document.encode())
    assert [(r.offer_id, r.phone_hashes) for r in snapshot.parse_documents(stored).collect()] == [(odd, ["0a0b0c0d"])]


def test_newest_records_are_those_that_reach_the_snapshot(spark):
    """Ten entries fit at most: rows without an IP do not count, and a shop with few IPs or without a salt keeps all rows."""
    shops = spark.createDataFrame([("a", "ab" * 16), ("b", "cd" * 16), ("c", None)], "shop_id string, salt_hex string")
    rows = [(s, i, f"10.0.{i}.1" if (i % 3 if s != "b" else i < 5) else None, 1_000_000 + i // 2) for s in "abc" for i in range(60)]
    rows.append(("a", None, "10.0.0.1", None))
    records = spark.createDataFrame(rows, "shop_id string, record_id long, ip string, ts long").withColumn("created_at", F.timestamp_seconds("ts"))
    kept = {s: sorted(r.record_id for r in records_ if r.record_id is not None) for s, records_ in groups(snapshot.newest_records(records, shops, 99).collect()).items()}
    # 59, 58, 56, ..., 46 are the ten newest with an IP.
    assert kept == {"a": list(range(46, 60)), "b": list(range(60)), "c": list(range(60))}


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shop_id, []).append(r)
    return out
