"""IP prefixes: /24 for IPv4, /48 for IPv6."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

TAG_V4 = "ip_v4_24"
TAG_V6 = "ip_v6_48"

_OCTET = r"(?=[0-9]{1,3}(?:\.|\z))0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def ipv4_prefix(raw: Column) -> Column:
    """First three octets without leading zeros; null for anything but a dotted quad in range."""
    text = trim(raw)
    return F.when(text.rlike(_V4), F.regexp_replace(text, _V4, "$1.$2.$3"))


def ipv6_prefix(raw: Column) -> Column:
    """First three groups, lower-case, without leading zeros; the double colon is filled with zeros."""
    text = F.lower(F.substring_index(trim(raw), "%", 1))
    left, right = F.substring_index(text, "::", 1), F.substring_index(text, "::", -1)
    size = lambda part: F.when(part == "", 0).otherwise(F.length(part) - F.length(F.translate(part, ":", "")) + 1)
    fill = 8 - size(left) - size(right)
    plain = text.rlike(rf"^{_GROUPS}\z") & (size(text) == 8)
    folded = text.rlike(rf"^(?:{_GROUPS})?::(?:{_GROUPS})?\z") & (fill >= 0)
    parts = lambda part: F.when(part != "", part)
    expanded = F.when(plain, text).when(folded, F.concat_ws(":", parts(left), F.when(fill > 0, F.substring(F.lit("0:0:0:0:0:0:0:0"), F.lit(1), 2 * fill - 1)), parts(right)))
    return F.regexp_replace(F.substring_index(expanded, ":", 3), r"(?<![0-9a-f])0+(?=[0-9a-f])", "")


def ip_key(raw: Column) -> Column:
    """The prefix of an IP literal, or null. IPv6 is tried only on text with a colon."""
    return F.when(F.contains(raw, F.lit(":")), ipv6_prefix(raw)).otherwise(ipv4_prefix(raw))


def ip_tag(key: Column) -> Column:
    return F.when(F.contains(key, F.lit(":")), TAG_V6).when(key.isNotNull(), TAG_V4)
