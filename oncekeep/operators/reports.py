"""Reports for merchants and for the platform. ``now`` is always a literal, never the clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, discount_name_score, parse_facts
from .ledger import unseal

DEAD_AFTER = 5
# Size of the stored sketches: items of a level of the latency's, log2 of the registers of the shops'.
SKETCH_K = 400
SKETCH_LOG = 12


def since(now: str, **span: int) -> Column:
    """``now`` minus a span, e.g. ``since(now, days=30)``."""
    return F.to_timestamp(F.lit(now)) - F.make_interval(**{k: F.lit(v) for k, v in span.items()})


def _counts(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def _with_counts(base: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Left-join grouped counts; missing counts become 0."""
    for t in tables:
        base = base.join(t, key, "left").fillna(0, [c for c in t.columns if c != key])
    return base


def one_row(*tables: DataFrame) -> DataFrame:
    """Single-row aggregates side by side."""
    keyed = [t.withColumn("_one", F.lit(1)) for t in tables]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


# -- offers ----------------------------------------------------------------------------------


def offer_counts(offers: DataFrame, ledger: DataFrame, flags: DataFrame, now: str) -> DataFrame:
    """Redemptions and flags of the last 30 days per unarchived offer."""
    recent = F.col("created_at") >= since(now, days=30)
    listed = offers.filter(F.col("archived_at").isNull()).select("offer_id", "shop_id", "name", "status")
    return _with_counts(
        listed,
        "offer_id",
        _counts(ledger.filter(recent), ["offer_id"], redemptions=F.lit(True)),
        _counts(flags.filter(recent), ["offer_id"], flagged=F.lit(True)),
    )


def offer_detail(offers: DataFrame, ledger: DataFrame, flags: DataFrame, now: str) -> DataFrame:
    recent = F.col("created_at") >= since(now, days=30)
    listed = offers.filter(F.col("archived_at").isNull()).select("offer_id", "name", "status", "mode")
    return _with_counts(
        listed,
        "offer_id",
        _counts(ledger, ["offer_id"], redemptions_30d=recent),
        _counts(flags, ["offer_id"], flagged_30d=recent, flagged_total=F.lit(True)),
    )


def recent_flags(flags: DataFrame, per_offer: int = 10) -> DataFrame:
    newest = Window.partitionBy("offer_id").orderBy(F.col("created_at").desc(), F.col("order_gid"))
    return flags.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= per_offer)


def offers_not_enforced(offers: DataFrame) -> DataFrame:
    return offers.filter((F.col("status") == "active") & ~F.col("enforced") & F.col("archived_at").isNull())


def code_conflicts(offers: DataFrame) -> DataFrame:
    """Unarchived offers of a shop that share an upper-case code."""
    live = offers.filter(F.col("archived_at").isNull())
    return live.groupBy("shop_id", "code_upper").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def signal_contribution(flags: DataFrame) -> DataFrame:
    """Share of each signal among the matched signals of an offer's flags."""
    each = flags.select("offer_id", F.explode("facts").alias("fact")).groupBy("offer_id", "fact").agg(F.count("*").alias("n"))
    return each.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("offer_id")), 6))


def _first_per_shop(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each shop; Spark cuts each task's share of a shop before the shuffle."""
    first = Window.partitionBy("shop_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)


def suggest_discounts(discounts: DataFrame, offers: DataFrame, limit: int = 100) -> DataFrame:
    """Each shop's discounts with codes not protected yet, best welcome-offer candidates first."""
    live = discounts.filter(F.col("status").isin("ACTIVE", "SCHEDULED") & (F.size("codes") > 0))
    taken = offers.filter(F.col("archived_at").isNull()).select("shop_id", F.col("code_upper").alias("code")).distinct()
    used = live.select("shop_id", "discount_id", F.explode(F.transform("codes", F.upper)).alias("code"))
    clash = used.join(taken, ["shop_id", "code"]).select("shop_id", "discount_id").distinct()
    free = live.join(clash, ["shop_id", "discount_id"], "left_anti")
    ranked = free.withColumn("name_score", discount_name_score(F.col("title"), F.col("codes")))
    order = [F.col("once_per_customer").desc(), F.col("name_score").desc(), F.col("created_at").desc(), F.col("discount_id")]
    return _first_per_shop(ranked, order, limit)


# -- flags -----------------------------------------------------------------------------------


def pending_flags(flags: DataFrame) -> DataFrame:
    return _counts(flags, ["shop_id"], pending=F.col("merchant_action") == "pending")


def flag_list(flags: DataFrame, offers: DataFrame, limit: int = 100, action: str | None = None, offer_id: str | None = None) -> DataFrame:
    """Each shop's newest flags with the offer's name, of one merchant action and offer if given."""
    wanted = flags if action is None else flags.filter(F.col("merchant_action") == action)
    wanted = wanted if offer_id is None else wanted.filter(F.col("offer_id") == offer_id)
    top = _first_per_shop(wanted, [F.col("created_at").desc(), F.col("order_gid")], limit)
    return top.join(offers.select("offer_id", F.col("name").alias("offer_name")), "offer_id", "left")


def find_flag(flags: DataFrame, offers: DataFrame, shop_id: str, order_gid: str) -> DataFrame:
    one = flags.filter((F.col("shop_id") == shop_id) & (F.col("order_gid") == order_gid))
    return one.join(offers.select("offer_id", F.col("name").alias("offer_name"), "code"), "offer_id", "left")


def parsed_flags(flags: DataFrame, facts: str = "facts") -> DataFrame:
    return flags.withColumn(facts, parse_facts(F.col(facts)))


# -- platform --------------------------------------------------------------------------------


def dashboard(shops: DataFrame, ledger: DataFrame, flags: DataFrame, jobs: DataFrame, deliveries: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """24-hour and 1-hour counters, one scan per table."""
    day, hour = since(now, hours=24), since(now, hours=1)
    pending = lambda topic: F.count_if((F.col("topic") == topic) & (F.col("status") == "pending"))
    return one_row(
        shops.agg(F.count_if(F.col("installed_at") >= day).alias("installs_24h"), F.count_if(F.col("uninstalled_at") >= day).alias("uninstalls_24h")),
        ledger.filter(F.col("created_at") >= day).agg(F.count("*").alias("redemptions_24h")),
        flags.filter(F.col("created_at") >= day).agg(F.count("*").alias("flagged_24h")),
        jobs.agg(
            F.count_if(F.col("status") == "pending").alias("jobs_pending"),
            F.count_if(F.col("status") == "running").alias("jobs_running"),
            F.count_if((F.col("status") == "complete") & (F.col("completed_at") >= hour)).alias("jobs_done_1h"),
            F.count_if(F.col("status") == "failed").alias("jobs_failed"),
        ),
        deliveries.agg(F.count_if((F.col("status") == "failed") & (F.col("received_at") >= day)).alias("delivery_failures_24h")),
        requests.agg(
            pending("customers/data_request").alias("pending_exports"),
            pending("customers/redact").alias("pending_erasures"),
            pending("shop/redact").alias("pending_purges"),
        ),
    )


def platform_metrics(shops: DataFrame, ledger: DataFrame, flags: DataFrame, now: str) -> DataFrame:
    """Installs, uninstalls, 30-day volumes and the share of flags that merchants dismissed."""
    week, month = since(now, days=7), since(now, days=30)
    recent = F.col("created_at") >= month
    row = one_row(
        shops.agg(
            F.count_if(F.col("installed_at") >= week).alias("installs_7d"),
            F.count_if(F.col("uninstalled_at") >= week).alias("uninstalls_7d"),
            F.count_if(F.col("installed_at") >= month).alias("installs_30d"),
        ),
        ledger.filter(recent).agg(F.count("*").alias("redemptions_30d")),
        flags.filter(recent).agg(F.count("*").alias("flagged_30d"), F.count_if(F.col("merchant_action") == "dismissed").alias("dismissed_30d")),
    )
    rate = F.when(F.col("flagged_30d") == 0, 0.0).otherwise(F.floor(F.col("dismissed_30d") * 1000.0 / F.col("flagged_30d") + 0.5) / 10)
    return row.withColumn("false_positive_pct", rate)


def shop_lifecycle(shops: DataFrame, now: str) -> DataFrame:
    """active, uninstalling (under 48 hours) or gone."""
    state = F.when(F.col("uninstalled_at").isNull(), "active").when(F.col("uninstalled_at") >= since(now, hours=48), "uninstalling")
    return shops.withColumn("lifecycle", state.otherwise("gone"))


def shop_overview(shops: DataFrame, offers: DataFrame, ledger: DataFrame, flags: DataFrame, deliveries: DataFrame, now: str) -> DataFrame:
    month, week = since(now, days=30), since(now, days=7)
    return _with_counts(
        shops.select("shop_id", "shop_domain"),
        "shop_id",
        _counts(offers, ["shop_id"], offers=F.col("archived_at").isNull()),
        _counts(ledger.filter(F.col("created_at") >= month), ["shop_id"], redemptions_30d=F.lit(True)),
        _counts(flags.filter(F.col("created_at") >= month), ["shop_id"], flagged_30d=F.lit(True)),
        _counts(deliveries.filter(F.col("received_at") >= week), ["shop_id"], failures_7d=F.col("status") == "failed"),
    )


def shop_rollup(shops: DataFrame, offers: DataFrame, ledger: DataFrame, flags: DataFrame) -> DataFrame:
    """Offers, redemptions and flags per shop."""
    every = F.lit(True)
    return _with_counts(
        shops,
        "shop_id",
        _counts(offers, ["shop_id"], offers=every),
        _counts(ledger, ["shop_id"], redemptions=every),
        _counts(flags, ["shop_id"], flags=every),
    )


def search(df: DataFrame, needle: str, *columns: str, any_case: bool = True) -> DataFrame:
    """Rows where any of the columns contains the text."""
    hay = (lambda c: F.lower(F.col(c))) if any_case else F.col
    text = needle.lower() if any_case else needle
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.contains(hay(c), F.lit(text)), F.lit(False)) for c in columns]))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page in the given order, sorted before paging."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 50) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return total.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))


def status_depth(jobs: DataFrame) -> DataFrame:
    """Queue depth by status; a failed job is dead after five attempts."""
    status, tries = F.col("status"), F.col("attempts")
    return jobs.agg(
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "running").alias("running"),
        F.count_if((status == "failed") & (tries < DEAD_AFTER)).alias("failed"),
        F.count_if((status == "failed") & (tries >= DEAD_AFTER)).alias("dead"),
    )


def newest(df: DataFrame, time_col: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(time_col).desc(), tie).limit(limit)


def dead_letters(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest failed jobs that are not tried again."""
    dead = (F.col("status") == "failed") & (F.col("attempts") >= DEAD_AFTER)
    failed = newest(jobs.filter(dead), "created_at", "job_id", limit)
    return failed.withColumn("payload", clip(F.col("payload")))


def requests_by_topic(requests: DataFrame, shops: DataFrame, limit: int = 200) -> DataFrame:
    """The newest requests, grouped by topic, newest first."""
    top = newest(requests, "received_at", "request_id", limit).join(shops.select("shop_id", "shop_domain"), "shop_id", "left")
    entry = F.struct(-F.unix_timestamp("received_at"), F.col("request_id"), F.col("shop_domain"), F.col("status"))
    return top.groupBy("topic").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["request_id"]).alias("request_ids"))


def request_age(requests: DataFrame, now: str, deadline_days: int = 7) -> DataFrame:
    """Age in days and standing against the deadline."""
    ended = F.coalesce("completed_at", F.to_timestamp(F.lit(now)))
    age = F.datediff(ended, F.col("received_at"))
    state = F.when(F.col("completed_at").isNotNull(), F.when(age <= deadline_days, "met").otherwise("missed")).when(age > deadline_days, "overdue")
    return requests.withColumn("age_days", age).withColumn("deadline", state.otherwise("open"))


def daily_series(ledger: DataFrame, flags: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Redemptions and flags per day, days without any shown as 0."""
    end = F.to_date(F.lit(now))
    span = F.sequence(F.date_sub(end, days - 1), end, F.expr("interval 1 day"))
    calendar = ledger.sparkSession.range(1).select(F.explode(span).alias("day"))
    per_day = lambda df, name: (
        df.filter((F.col("created_at") >= F.to_timestamp(F.date_sub(end, days - 1))) & (F.col("created_at") < F.to_timestamp(F.date_add(end, 1))))
        .groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias(name))
    )
    return _with_counts(calendar, "day", per_day(ledger, "redemptions"), per_day(flags, "flagged"))


def installs_per_day(shops: DataFrame) -> DataFrame:
    moves = shops.select(
        F.inline(
            F.array(
                F.struct(F.to_date("installed_at").alias("day"), F.lit("install").alias("kind")),
                F.struct(F.to_date("uninstalled_at").alias("day"), F.lit("uninstall").alias("kind")),
            )
        )
    )
    return _counts(moves.filter(F.col("day").isNotNull()), ["day"], installs=F.col("kind") == "install", uninstalls=F.col("kind") == "uninstall")


def retention_cohorts(shops: DataFrame, now: str, weeks: int = 8) -> DataFrame:
    """Per install week: shops still installed at the start of each following week up to ``now``."""
    end = F.to_timestamp(F.lit(now))
    cohort = shops.select(F.to_date(F.date_trunc("week", "installed_at")).alias("cohort"), "installed_at", "uninstalled_at")
    each = cohort.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks))))
    at = F.to_timestamp(F.date_add("cohort", F.col("week") * 7))
    reached = each.withColumn("_at", at).filter(F.col("_at") <= end)
    active = F.col("uninstalled_at").isNull() | (F.col("uninstalled_at") >= F.col("_at"))
    return reached.groupBy("cohort", "week").agg(F.count("*").alias("shops"), F.count_if(active).alias("active"))


def hourly_redemptions(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("redemptions"))


def flag_rate_histogram(ledger: DataFrame, flags: DataFrame, bins: int = 10) -> DataFrame:
    """How many shops fall in each tenth of flags per redemption."""
    every = F.lit(True)
    rates = _with_counts(_counts(ledger, ["shop_id"], r=every), "shop_id", _counts(flags, ["shop_id"], f=every))
    bucket = F.least(F.floor(F.col("f") * bins / F.col("r")), F.lit(bins - 1))
    return rates.groupBy(bucket.cast("long").alias("bin")).agg(F.count("*").alias("shops"))


def latency_percentiles(deliveries: DataFrame, exact: bool = False) -> DataFrame:
    """P50, P95 and P99 of processing seconds per topic.

    The exact form keeps distinct values with counts, so it suits values of bounded resolution
    (whole milliseconds here); the approximate form keeps a fixed-size sketch per topic.
    """
    ms = (F.unix_millis("processed_at") - F.unix_millis("received_at")).alias("ms")
    timed = deliveries.filter(F.col("processed_at").isNotNull()).select("topic", ms)
    pick = (lambda p: F.percentile("ms", F.lit(p))) if exact else (lambda p: F.percentile_approx("ms", F.lit(p), F.lit(10_000)).cast("double"))
    return timed.groupBy("topic").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))


def latency_sketches(deliveries: DataFrame) -> DataFrame:
    """Per hour and topic: the number of deliveries, and mergeable sketches of their latency and of the shops.

    A few kilobytes an hour and topic, whatever the deliveries; ``latency_report`` merges them for
    any range of hours. ``latency`` is null where nothing has been processed yet.
    """
    ms = F.when(F.col("processed_at").isNotNull(), F.unix_millis("processed_at") - F.unix_millis("received_at"))
    return (
        deliveries.withColumns({"hour": F.date_trunc("hour", "received_at"), "_ms": ms})
        .groupBy("hour", "topic")
        .agg(
            F.count("*").alias("deliveries"), F.count("_ms").alias("processed"),
            F.kll_sketch_agg_bigint("_ms", F.lit(SKETCH_K)).alias("latency"),
            F.hll_sketch_agg("shop_id", F.lit(SKETCH_LOG)).alias("shops"),
        )
        .withColumn("latency", F.when(F.col("processed") > 0, F.col("latency")))
    )


def latency_report(sketches: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Per topic over the hours in [start, end): deliveries, distinct shops, and P50, P95, P99 of the latency in milliseconds.

    Reads the stored sketches alone. The rank of a percentile is off by less than one hundredth
    (99 times in 100), the number of shops by about two hundredths; few values are exact.
    """
    wanted = sketches if start is None else sketches.filter(F.col("hour") >= F.to_timestamp(F.lit(start)))
    wanted = wanted if end is None else wanted.filter(F.col("hour") < F.to_timestamp(F.lit(end)))
    merged = wanted.groupBy("topic").agg(
        F.sum("deliveries").alias("deliveries"), F.sum("processed").alias("processed"),
        F.kll_merge_agg_bigint("latency").alias("latency"), F.hll_sketch_estimate(F.hll_union_agg("shops")).alias("shops"),
    )
    at = lambda p: F.when(F.col("processed") > 0, F.kll_sketch_get_quantile_bigint("latency", F.lit(p)))
    return merged.select("topic", "deliveries", "processed", "shops", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), "latency")


def opened_redemptions(ledger: DataFrame, shops: DataFrame, limit: int = 100, offer_id: str | None = None) -> DataFrame:
    """Each shop's newest redemptions of a sealed ledger, personal values opened.

    The newest are chosen by keys and times alone; only rows that are listed are decrypted.
    """
    wanted = ledger if offer_id is None else ledger.filter(F.col("offer_id") == offer_id)
    return unseal(_first_per_shop(wanted, [F.col("created_at").desc(), F.col("record_id").desc()], limit), shops)


def setup_status(shops: DataFrame, offers: DataFrame, ledger: DataFrame) -> DataFrame:
    every = F.lit(True)
    joined = _with_counts(shops.select("shop_id"), "shop_id", _counts(offers, ["shop_id"], _o=every), _counts(ledger, ["shop_id"], _r=every))
    return joined.select("shop_id", (F.col("_o") > 0).alias("has_offer"), (F.col("_r") > 0).alias("has_redemption"))


def audit_search(log: DataFrame, start: str, end: str, target: str | None = None) -> DataFrame:
    """Audit rows of a time range and, if given, a target; write the result with ``df.write.csv``."""
    within = log.filter((F.col("created_at") >= F.to_timestamp(F.lit(start))) & (F.col("created_at") < F.to_timestamp(F.lit(end))))
    return within if target is None else within.filter(F.concat_ws("/", "target_type", "target_id") == target)
