"""Stored sketches against exact figures, and the list that opens late."""

from pyspark.sql import functions as F

from oncekeep.operators import reports

SF = "/root/testdata/sf0.001"


def log_of(spark, rows=200_000):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 36_000)
    ms = (F.pmod(F.xxhash64("id"), F.lit(1_000)) * F.pmod(F.xxhash64("id"), F.lit(977))).cast("long")
    done = F.when(F.col("id") % 10 != 0, F.timestamp_millis(F.unix_millis(at) + ms))
    shop = F.concat(F.lit("s"), (F.col("id") % 5_000).cast("string"))
    return spark.range(rows).select(F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("topic"), shop.alias("shop_id"), at.alias("received_at"), done.alias("processed_at"))


def test_any_range_from_stored_sketches(spark, tmp_path):
    log = log_of(spark)
    reports.latency_sketches(log).write.parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    for start, end in ((None, None), ("2023-11-14 23:00:00", "2023-11-15 04:00:00")):
        within = log if start is None else log.filter((F.col("received_at") >= start) & (F.col("received_at") < end))
        values = within.withColumn("ms", F.unix_millis("processed_at") - F.unix_millis("received_at"))
        for r in reports.latency_report(stored, start, end).collect():
            mine = values.filter(F.col("topic") == r.topic)
            exact = mine.agg(F.count("*").alias("n"), F.count("ms").alias("m"), F.countDistinct("shop_id").alias("s"),
                             *[F.avg((F.col("ms") <= getattr(r, p)).cast("int")).alias(p) for p in ("p50", "p95", "p99")]).first()
            assert (r.deliveries, r.processed) == (exact.n, exact.m) and abs(r.shops - exact.s) <= 0.06 * exact.s
            assert abs(exact.p50 - 0.5) < 0.02 and abs(exact.p95 - 0.95) < 0.02 and abs(exact.p99 - 0.99) < 0.01


def test_sketches_of_little(spark):
    empty = log_of(spark, 0)
    assert reports.latency_report(reports.latency_sketches(empty)).count() == 0
    waiting = log_of(spark, 1)  # not processed yet
    one = reports.latency_report(reports.latency_sketches(waiting)).first()
    assert (one.deliveries, one.processed, one.shops, one.p50) == (1, 0, 1, None)


def test_only_listed_rows_are_opened(spark):
    from oncekeep.plans import fixtures as fx
    from oncekeep.plans.queries import _sealed

    spark.conf.set("spark.sql.debug.maxToStringFields", 500)
    plan = reports.opened_redemptions(_sealed(spark, SF), fx.shops(spark, SF), 3)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    # Outermost first: all decryption stands above the limit per shop.
    assert 0 <= plan.index("aesDecrypt") and plan.rindex("aesDecrypt") < plan.index("row_number")
