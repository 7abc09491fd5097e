"""Fixed vectors for canonical text, hashes, sketches, IP prefixes and envelopes."""

from pyspark.sql import functions as F

from oncekeep.functions import crypto, hashing, ip, sketch, text

SALT_HEX = "test-salt-xyz".encode().hex()
PAD = 4294967295


def column(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_canonical_email(spark):
    cases = {
        "Khoi.Nguyen@Gmail.com": "khoinguyen@gmail.com",
        "khoi.nguyen+promo@gmail.com": "khoinguyen@gmail.com",
        "khoi.nguyen@googlemail.com": "khoinguyen@googlemail.com",
        "  KHOI+anything@OUTLOOK.COM ": "khoi@outlook.com",
        "khoi.gia.nguyen@yahoo.com": "khoi.gia.nguyen@yahoo.com",
        "khoi.nguyen@": None,
        "@gmail.com": None,
        "khoi nguyen@gmail.com": "khoinguyen@gmail.com",
        "no-at-sign": None,
        "+tag@gmail.com": None,
        "a@b@Example.ORG": "a@b@example.org",
        " ab c@x.org﻿": "abc@x.org",
        "Ａbc@x.org": "abc@x.org",
        "Été@X.org": "Été@x.org",
    }
    assert column(spark, list(cases), text.canonical_email(F.col("v"))) == list(cases.values())
    assert column(spark, [None], text.canonical_email(F.col("v"))) == [None]


def test_canonical_phone(spark):
    cases = [
        ("+84 901 234 567", "+84", "+84901234567"),
        ("+84-901-234-567", "+84", "+84901234567"),
        ("0084901234567", "+84", "+84901234567"),
        ("0901234567", "+84", "+84901234567"),
        ("901234567", "+84", "+84901234567"),
        ("(090) 123 4567", "+84", "+84901234567"),
        ("", "+84", None),
        ("not-a-phone", "+84", None),
        ("+1", None, None),
        ("0901234567", None, None),
        ("+14155550123", None, "+14155550123"),
        (None, "+84", None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, raw string, prefix string, want string")
    out = df.withColumn("got", text.canonical_phone(F.col("raw"), F.col("prefix"))).orderBy("i").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_address_text(spark):
    cases = {
        "123 Main Street": "123 main st",
        "Số 12 Đường Lê Lợi": "so 12 duong le loi",
        "  hello   world  ": "hello world",
        "Apt. 4B": "apt 4b",
        "Streets Number 5 Str.": "streets no 5 st",
        "": "",
        None: "",
    }
    assert column(spark, list(cases), text.normalize_line(F.col("v"))) == list(cases.values())
    houses = {"123 main st": "main st", "12a main st": "main st", "main st": "main st", "": "", "7": ""}
    assert column(spark, list(houses), text.strip_house_number(F.col("v"))) == list(houses.values())


def test_address_keys_and_trigrams(spark):
    rows = [
        ("123 Main Street", "", "94102", "US", "123 main st||94102|US", "main st|94102|US"),
        ("123 Main St., Apt 4B", "", "94102", "us", "123 main st apt 4b||94102|US", "main st apt 4b|94102|US"),
        ("", "", "94102", "US", "||94102|US", "|94102|US"),
        ("Số 12 Đường Lê Lợi", None, "70000", "VN", "so 12 duong le loi||70000|VN", "so 12 duong le loi|70000|VN"),
    ]
    df = spark.createDataFrame(rows, "l1 string, l2 string, z string, cc string, full string, house string")
    n1, n2, z = (text.normalize_line(F.col(c)) for c in ("l1", "l2", "z"))
    for r in df.select("full", "house", text.address_full_key(n1, n2, z, F.col("cc")).alias("f"), text.address_house_key(n1, z, F.col("cc")).alias("h")).collect():
        assert (r.f, r.h) == (r.full, r.house)
    got = column(spark, ["main st"], sketch.address_trigrams(F.col("v"), F.lit("94102"), F.lit("us")))[0]
    assert got == sorted(["mai", "ain", "941", "410", "102"])
    assert column(spark, ["main st"], sketch.address_trigrams(F.col("v"), F.lit(""), F.lit("USA")))[0] == ["USA", "ain", "mai"]


def test_email_trigrams(spark):
    cases = ["khoinguyen@gmail.com", "testerkhoi", "kh@x.org", "éa@x.org"]
    got = column(spark, cases, sketch.email_trigrams(F.col("v")))
    assert got[0] == sorted(["kho", "hoi", "oin", "ing", "ngu", "guy", "uye", "yen"])
    assert got[1] == sorted(["tes", "est", "ste", "ter", "erk", "rkh", "kho", "hoi"])
    assert got[2] == []
    assert got[3] == ["éa"]
    assert column(spark, ["aéb@x.org"], sketch.email_trigrams(F.col("v")))[0] == ["aé", "éb"]
    assert column(spark, ["abcé@x.org"], sketch.email_trigrams(F.col("v")))[0] == ["abc", "bc�", "cé"]


def test_hashes(spark):
    plain = {"": "811c9dc5", "a": "e40c292c", "hello": "4f9f2cab", "khoinguyen@gmail.com": "48d63c41", "é": "1e9de8c1"}
    assert column(spark, list(plain), hashing.hex8(hashing.fnv1a(F.col("v")))) == list(plain.values())
    salted = {"": "cdcc61a2", "khoinguyen@gmail.com": "84956b56"}
    expr = hashing.hex8(hashing.fnv1a(F.col("v"), hashing.salt_state(F.lit(SALT_HEX))))
    assert column(spark, list(salted), expr) == list(salted.values())
    assert column(spark, [None, "a"], hashing.fnv1a(F.col("v")))[0] is None
    tagged = [
        ("email_canonical", "khoinguyen@gmail.com", "63c49bd1"),
        ("phone", "+14155550123", "671d3dc5"),
        ("addr_full", "1 main st 94102 us", "bf07fb4a"),
        ("ip_v4_24", "192.168.1", "c7f67cb3"),
        ("ip_v6_48", "2402:800:63a2", "b8d00759"),
    ]
    df = spark.createDataFrame(tagged, "tag string, value string, want string")
    expr = hashing.hex8(hashing.fnv1a(F.col("value"), hashing.lookup_state(F.lit(SALT_HEX), F.col("tag"))))
    assert all(r.got == r.want for r in df.withColumn("got", expr).collect())
    assert column(spark, ["63c49bd1"], hashing.from_hex8(F.col("v"))) == [0x63C49BD1]


def test_sketches(spark):
    cases = [
        (["khoinguyen"], [466682748, 733189310, 846147091, 1741988834]),
        (["mai", "ain", " st", "t  "], [222153778, 810471649, 3647606906, 4159444007]),
        (None, None),
        (["abc"], [2927993670, PAD, PAD, PAD]),
        (["abc", "abc", "ab"], [2927993670, PAD, PAD, PAD]),
        ([], [PAD] * 4),
        (None, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, words array<string>, want array<long>").coalesce(1)
    got = df.withColumn("got", hashing.bottom4(F.col("words"), hashing.salt_state(F.lit(SALT_HEX)))).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_sketch_of_non_ascii_text_hashes_replaced_windows(spark):
    words = [["abcé"], ["éé", "abc"], ["ééé"]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    tri = df.select("i", "w", F.explode(F.flatten(F.transform("w", sketch._windows))).alias("t")).distinct()
    want = tri.select("i", hashing.fnv1a(F.col("t")).alias("h")).groupBy("i").agg(F.sort_array(F.collect_list("h")).alias("want"))
    got = df.select("i", hashing.bottom4(F.col("w"), F.lit(hashing.FNV_OFFSET).cast("long")).alias("got")).join(want, "i").collect()
    assert len(got) == 3 and all(r.got == (r.want + [PAD] * 4)[:4] for r in got)


def test_jaccard_and_codecs(spark):
    a = [466682748, 733189310, 846147091, 1741988834]
    pairs = [
        (a, a, 1.0),
        (a, [222153778, 810471649, 3647606906, 4159444007], 0.0),
        (a, [466682748, 1741988834, 1869618924, 2441791470], 0.5),
        (a, [1741988834, 2576159517, 2927993670, 2997788190], 0.25),
        ([5, PAD, PAD, PAD], [6, PAD, PAD, PAD], 0.25),
    ]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, want double")
    rows = df.select("want", sketch.jaccard(F.col("a"), F.col("b")).alias("got"), sketch.overlaps(F.col("a"), F.col("b"), 0.5).alias("half")).collect()
    assert all(r.got == r.want and r.half == (r.want >= 0.5) for r in rows)
    texts = ["[1,2,3,4]", "[1,2,3]", "nope", "[0,0,0,0]", None, '[1,"x",3,4]']
    assert column(spark, texts, sketch.parse_sketch(F.col("v"))) == [[1, 2, 3, 4], None, None, None, None, None]
    assert column(spark, ["[1,2,3,255]", "[0,0,0,0]"], sketch.sketch_hex(sketch.parse_sketch(F.col("v")))) == ["000000010000000200000003000000ff", None]


def test_ip_prefixes(spark):
    cases = {
        "192.168.1.100": ("192.168.1", "ip_v4_24"),
        "  10.0.0.5  ": ("10.0.0", "ip_v4_24"),
        "010.001.0.5": ("10.1.0", "ip_v4_24"),
        "999.0.0.1": None,
        "10.0.0.256": None,
        "1.2.3": None,
        "a.b.c.d": None,
        "": None,
        None: None,
        "2402:0800:63a2:be1c:1234:5678:9abc:def0": ("2402:800:63a2", "ip_v6_48"),
        "2402:800:63a2::1": ("2402:800:63a2", "ip_v6_48"),
        "::1": ("0:0:0", "ip_v6_48"),
        "2402:800:63A2:BE1C::": ("2402:800:63a2", "ip_v6_48"),
        "fe80::1%eth0": ("fe80:0:0", "ip_v6_48"),
        "1::2::3": None,
        "1:2:3": None,
        "1:2:3:4:5:6:7:8::": ("1:2:3", "ip_v6_48"),
        "1::5:6:7:8": ("1:0:0", "ip_v6_48"),
        "::2:3:4:5:6:7:8": ("0:2:3", "ip_v6_48"),
        "0001:0000:0a0b::": ("1:0:a0b", "ip_v6_48"),
        ":::": None,
        ":1::2": None,
        "::": ("0:0:0", "ip_v6_48"),
        "zzzz::1": None,
        "::ffff:1.2.3.4": None,
        "1:2:3:4:5:6:7:8::9": None,
    }
    got = column(spark, list(cases), F.struct(ip.ip_key(F.col("v")), ip.ip_tag(ip.ip_key(F.col("v")))))
    assert [tuple(g) if g[0] else None for g in got] == list(cases.values())


def test_codes_facts_and_names(spark):
    df = spark.createDataFrame([([" welcome10 ", "WELCOME10", "", "  ", "x"],)], "v array<string>")
    assert df.select(text.normalize_codes(F.col("v"))).first()[0] == ["WELCOME10", "X"]
    facts = ['["phone",""]', "broken", None, '["a","b"]']
    assert column(spark, facts, text.parse_facts(F.col("v"))) == [["phone"], [], [], ["a", "b"]]
    assert column(spark, facts[:1], text.describe_facts(text.parse_facts(F.col("v")), "earlier {} seen")) == [["earlier phone seen"]]
    names = ["Welcome first", "First order", "new here", "renewal", "Intro", "x"]
    assert column(spark, names, text.discount_name_score(F.col("v"), F.array(F.lit("C1")))) == [4, 3, 2, 0, 1, 0]
    assert column(spark, ["a" * 300], F.length(text.clip(F.col("v")))) == [200]


def test_envelopes(spark):
    key, other = "unhex('%s')" % ("11" * 32), "unhex('%s')" % ("22" * 32)
    df = spark.createDataFrame([("hello",), (None,), ("",)], "v string")
    sealed = df.select("v", crypto.encrypt(F.col("v"), F.expr(key)).alias("c"))
    rows = sealed.select("v", "c", crypto.decrypt(F.col("c"), F.expr(key)).alias("p"), crypto.decrypt(F.col("c"), F.expr(other)).alias("bad")).collect()
    assert all(r.p == r.v and r.bad is None for r in rows)
    damaged = column(spark, ["AAAA", "not base64!", None, "AQ=="], crypto.decrypt(F.col("v"), F.expr(key)))
    assert damaged == [None] * 4
    wrapped = spark.createDataFrame([("k",)], "v string").select(crypto.encrypt(F.lit("11" * 16), F.expr(key)).alias("w"))
    moved = wrapped.select(crypto.rewrap(F.col("w"), F.expr(key), F.expr(other)).alias("w"))
    assert moved.select(crypto.decrypt(F.col("w"), F.expr(other))).first()[0] == "11" * 16


def test_sketches_of_batches_equal_a_plain_count():
    """Windows that repeat, words under three bytes, text beyond ASCII, empty lists and nulls, each row with its own state."""
    import random

    import numpy as np
    import pyarrow as pa

    from oncekeep.functions import hashing

    rng = random.Random(9)
    words = [[("".join(rng.choice("abc1") for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(4))] for _ in range(200)] + [None, [], ["héhéhé", "abcabc"]]
    states = [rng.randrange(1 << 32) for _ in words]

    def plain(row, state):
        windows = {w.encode()[i : i + 3].decode("utf-8", "replace").encode() for w in row for i in range(len(w.encode()) - 2)}
        out = []
        for w in windows:
            h = state
            for byte in w:
                h = ((h ^ byte) * hashing.FNV_PRIME) & 0xFFFFFFFF
            out.append(h)
        return (sorted(out) + [4294967295] * 4)[:4]

    got = hashing._bottom4.func(pa.array(words, pa.list_(pa.string())), pa.array(states, pa.int64())).to_pylist()
    assert got == [None if w is None else plain(w, s) for w, s in zip(words, states, strict=True)]
