"""Shops, offers, orders and the tables around them, derived by Spark from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole; times without a zone are taken as the session's."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def _shop(nation_key) -> object:
    return F.concat(F.lit("shop_"), (nation_key % 5).cast("string"))


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five shops, one per residue of the nation key."""
    n = F.col("n_nationkey") % 5
    return (
        table(spark, sf_dir, "nation")
        .select(_shop(F.col("n_nationkey")).alias("shop_id"), n.alias("n"))
        .distinct()
        .select(
            "shop_id",
            F.concat("shop_id", F.lit(".example.com")).alias("shop_domain"),
            F.md5(F.concat(F.lit("salt:"), "shop_id")).alias("salt_hex"),
            F.lit(1).alias("salt_version"),
            F.concat(F.md5(F.concat(F.lit("dek:"), "shop_id")), F.md5(F.concat(F.lit("dek2:"), "shop_id"))).alias("key_hex"),
            F.when(F.col("n") == 0, 0).otherwise(F.col("n") * 365).alias("retention_days"),
            F.lit(None).cast("string").alias("default_prefix"),
            F.to_timestamp(F.lit("1995-01-01")).alias("installed_at"),
            F.when(F.col("n") == 4, F.to_timestamp(F.lit("2001-08-14"))).alias("uninstalled_at"),
        )
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer per shop and order priority; priority 5 archived, priority 4 in watch mode."""
    priorities = F.array(*[F.lit(str(p)) for p in range(1, 6)])
    return (
        shops(spark, sf_dir)
        .select("shop_id", F.explode(priorities).alias("p"))
        .select(
            F.concat("shop_id", F.lit(":"), "p").alias("offer_id"),
            "shop_id",
            F.concat(F.lit("Welcome "), "p").alias("name"),
            F.lit("active").alias("status"),
            F.when(F.col("p") == "4", "watch").otherwise("block").alias("mode"),
            F.concat(F.lit("Welcome"), "p").alias("code"),
            F.concat(F.lit("WELCOME"), "p").alias("code_upper"),
            F.to_timestamp(F.lit("1995-01-01")).alias("created_at"),
            F.when(F.col("p") == "5", F.to_timestamp(F.lit("2001-01-01"))).alias("archived_at"),
        )
    )


def _street(number, base, parity) -> object:
    ending = F.when(parity, F.lit(" Street")).otherwise(F.lit(" St."))
    return F.concat(number.cast("string"), F.lit(" "), F.substring(F.md5(base.cast("string")), 1, 8), ending)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical order rows with emails, phones, addresses and IPs made from the keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    digits = F.lpad((c % 10000).cast("string"), 4, "0")
    code = F.concat(F.lit("welcome"), F.substring("o_orderpriority", 1, 1))
    domain = (
        F.when(c % 4 == 0, "gmail.com").when(c % 4 == 1, "googlemail.com").when(c % 4 == 2, "outlook.com").otherwise("Example.ORG")
    )
    zip_ = (10000 + (c * 7919) % 90000).cast("string")
    address = lambda line1: F.struct(
        line1.alias("address1"), F.lit(None).cast("string").alias("address2"), F.lit(None).cast("string").alias("city"),
        zip_.alias("zip"), F.lit("us").alias("country"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .join(customer, c == F.col("c_custkey"))
        .select(
            k.alias("record_id"),
            _shop(F.col("c_nationkey")).alias("shop_id"),
            F.concat(F.lit("order/"), k.cast("string")).alias("order_gid"),
            F.concat(F.lit("#"), k.cast("string")).alias("order_name"),
            F.when(k % 17 != 0, F.concat(F.lit("customer/"), c.cast("string"))).alias("customer_gid"),
            F.array(F.concat(F.lit(" "), code, F.lit(" ")), F.upper(code), F.lit("")).alias("codes"),
            F.when(
                k % 11 != 0,
                F.concat(
                    F.substring(F.md5((c % 400).cast("string")), 1, 9), (k % 3).cast("string"), F.lit("+"),
                    (k % 7).cast("string"), F.lit("@"), domain,
                ),
            ).alias("email"),
            F.when(k % 4 == 0, F.concat(F.lit("+1 (415) 555-"), digits))
            .when(k % 4 == 1, F.concat(F.lit("001415555"), digits))
            .when(k % 4 == 2, F.concat(F.lit("0415555"), digits))
            .alias("phone"),
            F.when(
                k % 13 == 0,
                F.concat(F.lit("2402:0800:"), F.lower(F.hex(c % 200)), F.lit("::"), F.lower(F.hex(k % 250))),
            )
            .otherwise(F.concat_ws(".", F.lit("10"), (c % 8).cast("string"), (c % 200).cast("string"), (k % 250).cast("string")))
            .alias("ip"),
            address(_street(c % 200, c % 200, k % 2 == 0)).alias("address"),
            F.when(k % 3 != 0, address(_street(c, c, k % 2 == 1))).alias("billing"),
            (F.col("o_orderdate") + F.make_interval(secs=k % 86400)).alias("created_at"),
        )
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as event payloads. Of ten, one is cut off, one has no id, and in one the codes are no list."""
    k = F.col("record_id")
    address = lambda a: F.when(F.col(a).isNotNull(), F.struct(F.col(f"{a}.address1").alias("address1"), F.col(f"{a}.zip").alias("zip"), F.col(f"{a}.country").alias("country_code")))
    field = lambda name, value, end=",": F.coalesce(F.concat(F.lit(f'"{name}":'), value, F.lit(end)), F.lit(""))
    text = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    codes = F.to_json(F.transform("codes", lambda c: F.struct(c.alias("code"))))
    payload = F.concat(
        F.lit("{"),
        field("admin_graphql_api_id", F.when(k % 10 != 1, text(F.col("order_gid")))),
        field("email", text(F.col("email"))),
        field("phone", F.when(k % 3 == 0, text(F.col("phone")))),
        field("browser_ip", F.when(k % 4 != 0, text(F.col("ip")))),
        field("client_details", F.concat(F.lit('{"browser_ip":'), text(F.col("ip")), F.lit("}"))),
        field("shipping_address", F.when(k % 5 != 0, F.to_json(address("address")))),
        field("billing_address", F.to_json(address("billing"))),
        field("customer", F.concat(F.lit('{"phone":'), text(F.col("phone")), F.lit("}"))),
        field("discount_codes", F.when(k % 10 == 2, F.lit("true")).otherwise(codes), ""),
        F.lit("}"),
    )
    cut = F.when(k % 10 == 3, F.substring(payload, F.lit(1), F.length(payload) - F.lit(9))).otherwise(payload)
    return orders(spark, sf_dir).select("record_id", "shop_id", "created_at", cut.alias("payload"))


# -- tables around the orders ----------------------------------------------------------------


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a flag, for the reports."""
    k = F.col("record_id")
    score = (4 + k % 14).cast("int")
    name = F.when(k % 3 == 0, F.array(F.lit("phone"))).when(k % 3 == 1, F.array(F.lit("email_canonical"), F.lit("ip_v4_24")))
    return orders(spark, sf_dir).select(
        "shop_id",
        F.concat("shop_id", F.lit(":"), F.substring(F.col("codes")[1], 8, 1)).alias("offer_id"),
        "order_gid",
        "order_name",
        "customer_gid",
        F.when(score >= 10, "HIGH").otherwise("MEDIUM").alias("risk_level"),
        score.alias("score"),
        name.otherwise(F.array(F.lit("address_full"))).alias("facts"),
        F.when(k % 60 == 0, "dismissed").otherwise("pending").alias("merchant_action"),
        F.lit(None).cast("timestamp").alias("merchant_action_at"),
        "created_at",
    )


def redemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as plain ledger rows: ids and times only."""
    offer = F.concat("shop_id", F.lit(":"), F.substring(F.col("codes")[1], 8, 1))
    return orders(spark, sf_dir).select("record_id", "shop_id", offer.alias("offer_id"), "order_gid", "order_name", "customer_gid", "created_at")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as webhook deliveries; every tenth is delivered twice."""
    e = table(spark, sf_dir, "events")
    repeated = e.filter(F.col("event_id") % 10 == 0).withColumn("ts", F.col("ts") + F.make_interval(mins=F.lit(5)))
    return e.unionByName(repeated).select(
        F.concat(F.lit("wh/"), F.col("event_id").cast("string")).alias("webhook_gid"),
        F.concat(F.lit("shop_"), (F.col("user_id") % 5).cast("string")).alias("shop_id"),
        F.col("event_type").alias("topic"),
        F.col("props").alias("payload"),
        F.col("ts").alias("received_at"),
        F.when(F.col("event_id") % 9 != 0, F.col("ts") + F.make_interval(secs=F.col("event_id") % 97)).alias("processed_at"),
        F.when(F.col("event_id") % 9 == 0, "failed").otherwise("done").alias("status"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queued jobs."""
    k = F.col("event_id")
    status = F.when(k % 6 == 0, "pending").when(k % 6 == 1, "running").when(k % 6 < 4, "failed").otherwise("complete")
    return table(spark, sf_dir, "events").select(
        k.alias("job_id"),
        F.concat(F.lit("shop_"), (F.col("user_id") % 5).cast("string")).alias("shop_id"),
        F.col("event_type").alias("type"),
        status.alias("status"),
        (k % 7).cast("int").alias("attempts"),
        F.repeat(F.col("props"), 40).alias("payload"),
        F.col("ts").alias("created_at"),
        F.when(k % 6 >= 4, F.col("ts") + F.make_interval(secs=k % 50)).alias("completed_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks for something."""
    c = F.col("c_custkey")
    topic = F.when(c % 3 == 0, "customers/redact").when(c % 3 == 1, "customers/data_request").otherwise("shop/redact")
    received = F.to_timestamp(F.lit(NOW)) - F.make_interval(days=(c % 20).cast("int"), secs=c % 1000)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("req/"), c.cast("string")).alias("request_id"),
        _shop(F.col("c_nationkey")).alias("shop_id"),
        topic.alias("topic"),
        F.concat(F.lit("customer/"), c.cast("string")).alias("customer_gid"),
        received.alias("received_at"),
        F.when(c % 4 == 0, received + F.make_interval(days=(c % 11).cast("int"))).alias("completed_at"),
        F.when(c % 4 == 0, "completed").otherwise("pending").alias("status"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as shops: a shop dimension that grows with the data."""
    s = F.col("s_suppkey")
    installed = F.to_timestamp(F.lit("2001-01-01")) + F.make_interval(days=((s * 37) % 200).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        s.alias("shop_id"),
        F.concat(F.lit("Shop-"), s.cast("string"), F.lit(".example.com")).alias("shop_domain"),
        installed.alias("installed_at"),
        F.when(s % 4 == 0, installed + F.make_interval(days=((s * 13) % 60).cast("int"))).alias("uninstalled_at"),
    )


def merchant_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as redemptions of a merchant."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("shop_id"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("created_at")
    )


def discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as discounts with a title, one or two codes and a status."""
    p = F.col("p_partkey")
    word = F.when(p % 5 == 0, "Welcome").when(p % 5 == 1, "first").when(p % 5 == 2, "new").when(p % 5 == 3, "Intro").otherwise("plain")
    codes = F.when(p % 13 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("welcome"), (p % 40).cast("string")), F.concat(F.lit("code"), p.cast("string")))
    )
    return table(spark, sf_dir, "part").select(
        p.alias("discount_id"),
        F.concat(F.lit("shop_"), (p % 5).cast("string")).alias("shop_id"),
        F.concat_ws(" ", word, "p_name").alias("title"),
        codes.alias("codes"),
        (p % 2 == 0).alias("once_per_customer"),
        F.when(p % 7 == 0, "EXPIRED").when(p % 7 == 1, "SCHEDULED").otherwise("ACTIVE").alias("status"),
        (F.to_timestamp(F.lit("2001-01-01")) + F.make_interval(days=(p % 100).cast("int"))).alias("created_at"),
    )
