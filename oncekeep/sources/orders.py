"""Raw order JSON, in the event form and in the history form, to canonical order rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ADDRESS = "address1: string, address2: string, city: string, zip: string"
EVENT_ORDER = f"""admin_graphql_api_id string, name string, email string, phone string, browser_ip string,
  client_details struct<browser_ip: string>, discount_codes array<struct<code: string>>,
  shipping_address struct<{_ADDRESS}, country_code: string>, billing_address struct<{_ADDRESS}, country_code: string>,
  customer struct<admin_graphql_api_id: string, phone: string>"""
HISTORY_ORDER = f"""id string, name string, email string, phone string, clientIp string, discountCodes array<string>,
  shippingAddress struct<{_ADDRESS}, countryCodeV2: string>, billingAddress struct<{_ADDRESS}, countryCodeV2: string>,
  customer struct<id: string, phone: string>"""

# Where the parser puts a payload that it could not read, or not read whole.
_DAMAGED = "_damaged"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _DAMAGED}


def _address(source: str, country: str) -> Column:
    part = lambda name: F.col(f"{source}.{name}")
    fields = F.struct(part("address1").alias("address1"), part("address2").alias("address2"), part("city").alias("city"), part("zip").alias("zip"), part(country).alias("country"))
    return F.when(F.col(source).isNotNull(), fields)


def _canonical(o: DataFrame, keep: list[str | Column], gid: str, codes: Column, ip: Column, ship: Column, bill: Column, customer: str, always_billing: bool) -> DataFrame:
    """Canonical rows; those without an order id stay, with a null in ``order_gid``."""
    rows = o.select(
        *keep,
        F.col(gid).alias("order_gid"),
        F.coalesce("o.name", F.lit("")).alias("order_name"),
        F.col(customer).alias("customer_gid"),
        codes.alias("codes"),
        F.col("o.email").alias("email"),
        F.coalesce("o.phone", "o.customer.phone").alias("phone"),
        ip.alias("ip"),
        ship.alias("_ship"),
        bill.alias("_bill"),
    )
    # The billing slot of an event is filled only next to a shipping address; history always fills it.
    slot = F.col("_bill") if always_billing else F.when(F.col("_ship").isNotNull(), F.col("_bill"))
    return rows.withColumns({"address": F.coalesce("_ship", "_bill"), "billing": slot}).drop("_ship", "_bill")


def _events(raw: DataFrame, keep: list[str | Column], payload: str) -> DataFrame:
    o = raw.withColumn("o", F.from_json(payload, f"{EVENT_ORDER}, {_DAMAGED} string", _OPTIONS)).withColumn(_DAMAGED, F.col(f"o.{_DAMAGED}"))
    codes = F.transform(F.coalesce("o.discount_codes", F.array().cast("array<struct<code:string>>")), lambda d: F.coalesce(d["code"], F.lit("")))
    return _canonical(
        o, [*keep, _DAMAGED], "o.admin_graphql_api_id", codes, F.coalesce("o.browser_ip", "o.client_details.browser_ip"),
        _address("o.shipping_address", "country_code"), _address("o.billing_address", "country_code"), "o.customer.admin_graphql_api_id", False,
    )


def _history(raw: DataFrame, keep: list[str | Column], payload: str) -> DataFrame:
    o = raw.withColumn("o", F.from_json(payload, f"{HISTORY_ORDER}, {_DAMAGED} string", _OPTIONS)).withColumn(_DAMAGED, F.col(f"o.{_DAMAGED}"))
    codes = F.coalesce("o.discountCodes", F.array().cast("array<string>"))
    return _canonical(
        o, [*keep, _DAMAGED], "o.id", codes, F.col("o.clientIp"),
        _address("o.shippingAddress", "countryCodeV2"), _address("o.billingAddress", "countryCodeV2"), "o.customer.id", True,
    )


def _others(raw: DataFrame, payload: str) -> list[str]:
    return [c for c in raw.columns if c != payload]


def read_orders(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Event orders. Other columns (shop_id, created_at, record_id) pass through.

    Rows without an order id go; :func:`check_orders` tells which these are, and why.
    """
    return _events(raw, _others(raw, payload), payload).filter(F.col("order_gid").isNotNull()).drop(_DAMAGED)


def read_history(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Historical orders, with the same output columns as :func:`read_orders`."""
    return _history(raw, _others(raw, payload), payload).filter(F.col("order_gid").isNotNull()).drop(_DAMAGED)


def check_orders(raw: DataFrame, payload: str = "payload", history: bool = False) -> DataFrame:
    """Every row of ``raw`` once, as an order or with the ``reason`` why it is none, and its raw payload.

    ``not_json``: the payload is null or no JSON text; ``wrong_type``: a field, or the whole, is of
    another type than an order's; ``no_order_id``: no id or an empty one. Sound rows have no reason.
    """
    parsed = (_history if history else _events)(raw, [*_others(raw, payload), F.col(payload).alias("raw_payload")], payload)
    reason = (
        F.when(F.try_parse_json("raw_payload").isNull(), "not_json")
        .when(F.col(_DAMAGED).isNotNull(), "wrong_type")
        .when(F.coalesce("order_gid", F.lit("")) == "", "no_order_id")
    )
    return parsed.withColumn("reason", reason).drop(_DAMAGED)
