"""Trigram sets and 4-value sketches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = 4294967295


def _windows(text: Column) -> Column:
    """3-byte windows of the UTF-8 bytes, as text (bytes cut mid-character become U+FFFD)."""
    data = F.encode(text, "UTF-8")
    one = lambda i: F.make_valid_utf8(F.substring(data, i, F.lit(3)).cast("string"))
    at = F.when(F.octet_length(text) >= 3, F.sequence(F.lit(1), F.octet_length(text) - 2))
    return F.coalesce(F.transform(at, one), F.array().cast("array<string>"))


def email_words(canonical: Column) -> Column:
    """The local part as a one-word list; null stays null."""
    return F.when(canonical.isNotNull(), F.array(F.regexp_replace(canonical, r"@[^@]*\z", "")))


def address_words(n1: Column, zip_: Column, country: Column) -> Column:
    """Words of line 1, zip and country with at least 3 characters; null when line 1 is null."""
    words = F.filter(F.split(F.concat_ws(" ", n1, zip_, country), " "), lambda w: F.length(w) >= 3)
    return F.when(n1.isNotNull(), words)


def _trigrams(words: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.transform(words, _windows))))


def email_trigrams(canonical: Column) -> Column:
    """Sorted distinct windows of the local part; null stays null."""
    return _trigrams(email_words(canonical))


def address_trigrams(n1: Column, zip_: Column, country: Column) -> Column:
    """Sorted distinct windows inside each word of line 1, zip and country."""
    return _trigrams(address_words(n1, zip_, country))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the 4 smallest union values found in both sketches, always over 4."""
    smallest = F.slice(F.sort_array(F.array_union(a, b)), 1, 4)
    both = F.filter(smallest, lambda v: F.array_contains(a, v) & F.array_contains(b, v))
    return F.size(both) / F.lit(4.0)


def overlaps(a: Column, b: Column, threshold: float) -> Column:
    return jaccard(a, b) >= threshold


def parse_sketch(text: Column) -> Column:
    """JSON text to a sketch; malformed, wrong length or all zero means absent (null)."""
    parsed = F.from_json(text, "array<bigint>")
    good = (F.size(parsed) == 4) & F.forall(parsed, lambda v: v.isNotNull()) & F.exists(parsed, lambda v: v != 0)
    return F.when(good, parsed)


def sketch_json(sketch: Column) -> Column:
    return F.to_json(sketch)


def sketch_hex(sketch: Column) -> Column:
    """32 hex digits; an absent or all-zero sketch gives null."""
    digits = F.concat_ws("", F.transform(sketch, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")))
    return F.when(sketch.isNotNull() & F.exists(sketch, lambda v: v != 0), digits)
