"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, written


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL condition over the columns of ``measure`` and ``_text``."""

    name: str
    rejects: str


BASE_RULES = [
    Rule("too_short", "n_words < 50"),
    Rule("repetitive", "100 * n_repeat_words > 50 * n_words"),
]

# Integer comparisons only, so that any engine gives the same verdict.
RULES = [
    *BASE_RULES,
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "2 * length(regexp_replace(_text, '[^A-Z]', '')) > length(regexp_replace(_text, '[^A-Za-z]', ''))"),
    Rule("exclamations", "5 * (length(_text) - length(replace(_text, '!', ''))) > n_words"),
    Rule("no_letters", "2 * length(regexp_replace(_text, '[^\\\\p{L}]', '')) < word_chars"),
]

_NO_GRAMS = "CAST(array() AS array<struct<g: string, i: int>>)"
_GRAMS = f"""CASE WHEN size(_words) < 3 THEN {_NO_GRAMS} ELSE sort_array(transform(sequence(0, size(_words) - 3),
    i -> struct(concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]) AS g, i AS i))) END"""
_REPEATED = """sort_array(filter(transform(_grams,
    (x, k) -> CASE WHEN x.g = get(_grams, k - 1).g OR x.g = get(_grams, k + 1).g THEN x.i END), p -> p IS NOT NULL))"""
_COVERED = """aggregate(transform(_at, (p, k) -> least(3, coalesce(get(_at, k + 1) - p, 3))), 0L, (a, b) -> a + b)"""


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures that the rules use: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    All in one pass over the row with built-in functions. Repeated three-word windows are found by
    sorting the windows of the text beside each other, so a long text costs n log n, and no row
    leaves its task. A null text has no words.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "_text", "_words", "_lines", "_grams", "_at"]
    body = text_of(text)
    out = df.select(*[c for c in df.columns if c.lower() not in names or c == text], body.alias("_text"))
    out = out.withColumns(
        {
            "_words": F.array_remove(F.split("_text", f"{SPACE}+"), ""),
            "_lines": F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            "word_chars": F.length(F.regexp_replace("_text", f"{SPACE}+", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "_grams": F.expr(_GRAMS),
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_words", "_lines")
    out = out.withColumn("_at", F.expr(_REPEATED)).drop("_grams")
    return out.withColumn("n_repeat_words", F.expr(_COVERED)).drop("_at")


def profile(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) for each rule, on a sample of about ``sample_rows`` measured documents.

    Each rule runs alone over the stored sample, twice; the second run is timed, when its code is
    compiled. A run without any rule is taken off, so that a rule counts with what it adds.
    """
    total = docs.count()
    sample = docs.sample(min(1.0, sample_rows / total), seed) if total > sample_rows else docs
    sample = written(measure(sample.select("text")), "quality-sample").drop("text")

    def run(condition: str) -> tuple[float, float]:
        start = time.perf_counter()
        share = sample.agg(F.avg(F.expr(f"CAST(({condition}) AS int)"))).first()[0]
        return time.perf_counter() - start, float(share or 0.0)

    def timed(condition: str) -> tuple[float, float]:
        run(condition)
        return run(condition)

    floor = timed("length(_text) < 0")[0]
    return [(rule, max(s - floor, 1e-4), share) for rule in rules for s, share in [timed(rule.rejects)]]


def order_rules(profiled: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per second first; the name settles ties."""
    return [r for r, *_ in sorted(profiled, key=lambda x: (-x[2] / x[1], x[0].name))]


def first_rejection(rules: list[Rule]) -> Column:
    """The first rule that rejects, null if none does; later rules are not evaluated."""
    out = None
    for rule in rules:
        out = F.when(F.expr(rule.rejects), F.lit(rule.name)) if out is None else out.when(F.expr(rule.rejects), F.lit(rule.name))
    return out


def judge_quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """``docs`` with the measures, base_failed, rejected_by and kept.

    The rules run as one CASE in the order that ``profile`` and ``order_rules`` give. Which rule
    is named depends on that order, kept does not. A document that fails a base rule is never
    kept. Null and empty texts have no words and fail as too short; repeated rows get the same
    verdict; columns of ``docs`` named like a result are replaced; an empty table stays empty.
    """
    rules = RULES if rules is None else rules
    names = {"base_failed", "rejected_by", "kept"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in names])
    ordered = order_rules(profile(docs, rules, sample_rows))
    measured = measure(docs)
    base = F.expr(" OR ".join(f"({r.rejects})" for r in BASE_RULES))
    judged = measured.withColumns({"base_failed": base, "rejected_by": first_rejection(ordered)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("_text")


def kept_documents(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The documents that ``judge_quality`` keeps, with its measures.

    The row number in the filter holds it above the measures. Pushed below them, it would take
    their expressions along and evaluate them again for every element of the word lists.
    """
    judged = judge_quality(docs, rules, sample_rows).withColumn("_seen", F.monotonically_increasing_id())
    return judged.filter("kept AND _seen >= 0").drop("_seen")
