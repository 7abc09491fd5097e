"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import BROADCAST_ROWS, attach
from .common import written

# Hex digits of the digest that the join runs on; the whole of it only confirms.
PREFIX_DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host ends at ``/``, ``?`` or ``#``, A-Z become lower case; the path ends at ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has (host, path, action).

    A rule fits its host and every subdomain when the url's path starts with the rule's path.
    The longest rule (host and path together) wins, of equally long ones a ``block``; where no
    rule fits, rule is null and the verdict is ``default``.

    Each distinct url becomes a few expressions: its host suffixes of at most as many labels as
    any rule has, each with the path prefixes of the lengths that rules have. So nothing is lost
    and a very long url makes no more rows than a short one. They meet the rules on the first
    ``PREFIX_DIGITS`` digits of a SHA-256, the full digest confirms. The rules are broadcast only
    after they were counted. Copies of a url are collapsed first, so a hot url is one row, and the
    verdicts of hot urls are broadcast back to their pages.

    Null urls, urls without ``://`` and empty ones have an empty host and path and fit no rule.
    Repeated rows stay, each with the same verdict. Columns named host, path, rule or verdict in
    ``pages`` are replaced. An empty rule table gives the default everywhere.
    """
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "_url")]
    pages = pages.select(*own, F.col(url).alias("_url"))
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        F.concat("host", "path").alias("rule"),
        F.col("action").alias("_action"),
        F.size(F.split("host", r"\.")).alias("_labels"),
        F.length("path").alias("_path_len"),
        _digest(F.concat("host", "path")).alias("_digest"),
    )
    shape = rules.agg(
        F.count("*").alias("n"), F.max("_labels").alias("labels"), F.collect_set("_path_len").alias("lengths")
    ).first()
    host, path = url_parts(F.col("_url"))
    parts = [host.alias("host"), path.alias("path")]
    if not shape["n"]:
        return pages.select(*own, *parts, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.slice(F.split("host", r"\."), -F.least(F.lit(shape["labels"]), F.size(F.split("host", r"\."))), F.lit(shape["labels"]))
    urls = written(pages.select("_url").filter("_url IS NOT NULL").groupBy("_url").agg(F.count("*").alias("_n")), "urls")
    expanded = (
        urls.select("_url", "_n", *parts)
        .withColumn("_tail", labels)
        .withColumn("_host", F.explode(F.expr("transform(sequence(1, size(_tail)), i -> array_join(slice(_tail, i, size(_tail)), '.'))")))
        .withColumn("_len", F.explode(F.array(*[F.lit(n) for n in sorted(shape["lengths"])])))
        .filter(F.length("path") >= F.col("_len"))
        .select("_url", "_n", _digest(F.concat("_host", F.substr("path", F.lit(1), F.col("_len")))).alias("_digest"))
    )
    short = F.substring("_digest", 1, PREFIX_DIGITS).alias("_short")
    table = rules.select("rule", "_action", "_digest", short)
    table = F.broadcast(table) if shape["n"] <= BROADCAST_ROWS else table
    left, right = expanded.select("_url", "_n", "_digest", short).alias("l"), table.alias("r")
    # Digests are of one length, so one starts with the other only if they are equal. As an equality Spark
    # would make it a second join key; so candidates meet by prefix and are confirmed then.
    same = (F.col("l._short") == F.col("r._short")) & F.startswith(F.col("l._digest"), F.col("r._digest"))
    best = written(
        left.join(right, same)
        .groupBy("_url", "_n")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("_action") == "block").alias("b"), "rule", "_action")).alias("_best")),
        "url-rules",
    )
    judged = attach(pages, best, ["_url"], "_n", pages.count())
    verdict = F.coalesce(F.col("_best._action"), F.lit(default)).alias("verdict")
    return judged.select(*own, *parts, F.col("_best.rule").alias("rule"), verdict)
