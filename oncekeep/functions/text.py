"""Canonical email, phone and address text as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The white-space characters of the source system's language (more than Java's \\s).
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Domains whose local part ignores dots. They are not merged with each other.
DOTLESS_DOMAINS = ("gmail.com", "googlemail.com")

# Street-word abbreviations.
STREET_WORDS = {
    "street": "st",
    "str": "st",
    "avenue": "ave",
    "av": "ave",
    "road": "rd",
    "boulevard": "blvd",
    "drive": "dr",
    "lane": "ln",
    "place": "pl",
    "court": "ct",
    "terrace": "ter",
    "apartment": "apt",
    "suite": "ste",
    "number": "no",
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Local part up to its first plus sign, then the text after the last at sign.
_EMAIL_PARTS = r"(?s)^([^+]+)(?:\+.*)?@([^@]+)\z"
_E164 = r"^\+[1-9][0-9]{6,14}\z"


def _without_marks(value: str) -> str:
    parts = unicodedata.normalize("NFKD", value).replace("đ", "d").replace("Đ", "d")
    return "".join(ch for ch in parts if unicodedata.category(ch) != "Mn")


@F.pandas_udf(StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def _strip_marks(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _without_marks(v))


@F.pandas_udf(ArrayType(StringType()))
def _normalize_row(rows: pd.Series) -> pd.Series:
    def one(row):
        if row is None:
            return None
        head, *rest = row
        return [None if head is None else unicodedata.normalize("NFKC", head), *[None if v is None else _without_marks(v) for v in rest]]

    return rows.map(one)


def _ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _UPPER.lower())


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def _only_non_ascii(col: Column, udf) -> Column:
    """Send text through the Arrow UDF only where it is not plain ASCII (others go as nulls)."""
    needs = col.rlike(r"[^\x00-\x7F]")
    return F.coalesce(udf(F.when(needs, col)), col)


def compose(col: Column) -> Column:
    """NFKC."""
    return _only_non_ascii(col, _compose)


def strip_marks(col: Column) -> Column:
    """NFKD without combining marks; the stroked d becomes a plain one."""
    return _only_non_ascii(col, _strip_marks)


def normalize_row(email: Column, *address_parts: Column) -> Column:
    """One Arrow call for all texts of a row: NFKC of the email, then the parts without marks.

    Null for the common row that is plain ASCII throughout.
    """
    texts = F.array(email, *address_parts)
    return _normalize_row(F.when(F.concat_ws("", texts).rlike(r"[^\x00-\x7F]"), texts))


def normalize_codes(codes: Column) -> Column:
    """Trimmed, upper-case, non-empty, distinct codes."""
    cleaned = F.transform(codes, lambda c: F.upper(trim(c)))
    return F.array_distinct(F.filter(cleaned, lambda c: c != ""))


def canonical_email(raw: Column, composed: bool = False) -> Column:
    """Canonical address or null. ``composed`` says that ``raw`` is NFKC (or ASCII) already."""
    text = raw if composed else compose(raw)
    flat = F.translate(text, _UPPER + WHITESPACE, _UPPER.lower())
    domain = F.regexp_extract(flat, _EMAIL_PARTS, 2)
    local = F.regexp_extract(flat, _EMAIL_PARTS, 1)
    local = F.when(domain.isin(*DOTLESS_DOMAINS), F.translate(local, ".", "")).otherwise(local)
    return F.when(local != "", F.concat(local, F.lit("@"), domain))


def canonical_phone(raw: Column, default_prefix: Column | None = None) -> Column:
    """E.164 or null; numbers without a country prefix need ``default_prefix``."""
    prefix = F.lit(None).cast("string") if default_prefix is None else default_prefix
    stripped = F.translate(raw, WHITESPACE + "-().", "")
    digits = F.regexp_replace(stripped, "[^0-9]", "")
    candidate = (
        F.when(stripped == "", None)
        .when(F.startswith(stripped, F.lit("+")), F.concat(F.lit("+"), digits))
        .when(F.startswith(stripped, F.lit("00")), F.concat(F.lit("+"), F.substr(digits, F.lit(3))))
        .when(F.startswith(stripped, F.lit("0")), F.concat(prefix, F.substr(digits, F.lit(2))))
        .otherwise(F.concat(prefix, digits))
    )
    return F.when(candidate.rlike(_E164), candidate)


def normalize_line(raw: Column, stripped: bool = False) -> Column:
    """Address text to lower-case words with street words abbreviated; null becomes ''."""
    text = F.coalesce(raw, F.lit(""))
    text = text if stripped else strip_marks(text)
    words = F.trim(F.regexp_replace(_ascii_lower(text), "[^a-z0-9]+", " "))
    table = F.create_map(*[F.lit(x) for pair in STREET_WORDS.items() for x in pair])
    mapped = F.concat_ws(" ", F.transform(F.split(words, " "), lambda t: F.coalesce(table[t], t)))
    has_street_word = words.rlike(r"\b(" + "|".join(STREET_WORDS) + r")\b")
    return F.when(has_street_word, mapped).otherwise(words)


def strip_house_number(line: Column) -> Column:
    """Drop a leading house-number word from a normalised line."""
    return F.regexp_replace(line, r"^[0-9]+[a-z]?( |\z)", "")


def address_full_key(n1: Column, n2: Column, zip_: Column, country: Column) -> Column:
    return F.concat_ws("|", n1, n2, zip_, F.upper(F.coalesce(country, F.lit(""))))


def address_house_key(n1: Column, zip_: Column, country: Column) -> Column:
    return F.concat_ws("|", strip_house_number(n1), zip_, F.upper(F.coalesce(country, F.lit(""))))


def discount_name_score(title: Column, codes: Column) -> Column:
    """How much a discount reads like a welcome offer (first matching rule wins)."""
    # The patterns and their points.
    hay = F.concat_ws(" ", F.coalesce(title, F.lit("")), codes)
    return (
        F.when(hay.rlike("(?i)welcome"), 4)
        .when(hay.rlike("(?i)first"), 3)
        .when(hay.rlike(r"(?i)\bnew\b|newbie|newcustomer"), 2)
        .when(hay.rlike("(?i)intro"), 1)
        .otherwise(0)
    )


def clip(col: Column, size: int = 200) -> Column:
    return F.substring(col, 1, size)


def parse_facts(raw: Column) -> Column:
    """JSON text to a list of non-empty strings; malformed text to an empty list."""
    parsed = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return F.filter(parsed, lambda x: x.isNotNull() & (x != ""))


def describe_facts(facts: Column, template: str) -> Column:
    """Each fact put in the place of ``{}`` in the template."""
    before, after = template.split("{}")
    return F.transform(facts, lambda f: F.concat(F.lit(before), f, F.lit(after)))
