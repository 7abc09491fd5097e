"""SQL counterparts of the registered queries, for a check by another engine on the same tables."""

from __future__ import annotations

from ..functions.hashing import FNV_OFFSET, FNV_PRIME
from ..functions.sketch import PAD
from ..functions.text import STREET_WORDS
from ..operators.signals import TAGS
from ..operators.snapshot import ARRAYS, MAX_BYTES
from .fixtures import NOW

EVENTS_NOW = "2024-01-30 12:00:00"


def _step(h: str, byte: str) -> str:
    return f"((xor({h}, ({byte})::BIGINT) * {FNV_PRIME}) & 4294967295)"


def _bytes(s: str) -> str:
    return f"list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)"


def _fnv(items: str, start: str) -> str:
    return f"list_reduce({items}, lambda h, b: {_step('h', 'b')}, {start})"


def _hash(value: str, state: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN {_fnv(_bytes(value), state)} END"


def _hex(value: str) -> str:
    return f"lpad(lower(to_hex({value})), 8, '0')"


def _sketch(trigrams: str) -> str:
    one = "state_salt"
    for i in (1, 2, 3):
        one = _step(one, f"ascii(substr(t, {i}, 1))")
    return (
        f"CASE WHEN {trigrams} IS NOT NULL THEN list_slice(list_concat(list_sort(list_transform({trigrams}, lambda t: {one})), "
        f"[{PAD}, {PAD}, {PAD}, {PAD}]::BIGINT[]), 1, 4) END"
    )


def _windows(word: str) -> str:
    return f"list_transform(range(1, length({word}) - 1), lambda i: substr({word}, i, 3))"


def _words(text: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STREET_WORDS.items())
    cleaned = f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"
    return f"array_to_string(list_transform(string_split({cleaned}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


def _states(salt: str) -> str:
    raw = f"list_transform(range(0, 16), lambda i: ('0x' || substr({salt}, 2 * i + 1, 2))::BIGINT)"
    tagged = [
        f"{_fnv(f'list_concat(list_concat({raw}, [0::BIGINT]), list_concat({_bytes(repr(tag))}, [0::BIGINT]))', f'{FNV_OFFSET}::BIGINT')} AS state_{name}"
        for name, tag in TAGS.items()
    ]
    return ", ".join([*tagged, f"{_fnv(raw, f'{FNV_OFFSET}::BIGINT')} AS state_salt"])


SHOPS = """shops AS MATERIALIZED (
  SELECT shop_id, shop_id || '.example.com' AS shop_domain, md5('salt:' || shop_id) AS salt_hex, n,
         CASE WHEN n = 0 THEN 0 ELSE n * 365 END AS retention_days,
         CASE WHEN n = 4 THEN TIMESTAMP '2001-08-14' END AS uninstalled_at
  FROM (SELECT DISTINCT 'shop_' || (n_nationkey % 5) AS shop_id, n_nationkey % 5 AS n FROM nation))"""

SRC = """src AS MATERIALIZED (
  SELECT o_orderkey AS record_id, 'shop_' || (c_nationkey % 5) AS shop_id, 'order/' || o_orderkey AS order_gid,
    '#' || o_orderkey AS order_name, CASE WHEN o_orderkey % 17 <> 0 THEN 'customer/' || o_custkey END AS customer_gid,
    substr(o_orderpriority, 1, 1) AS p, 'shop_' || (c_nationkey % 5) || ':' || substr(o_orderpriority, 1, 1) AS offer_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN substr(md5((o_custkey % 400)::VARCHAR), 1, 9) || (o_orderkey % 3) || '+' || (o_orderkey % 7) || '@' ||
      CASE o_custkey % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'googlemail.com' WHEN 2 THEN 'outlook.com' ELSE 'Example.ORG' END END AS email,
    o_orderkey % 4 AS phone_kind, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS digits,
    o_orderkey % 13 = 0 AS is_v6, o_custkey AS c, o_orderkey AS k,
    (o_custkey % 200) || ' ' || substr(md5((o_custkey % 200)::VARCHAR), 1, 8) || CASE WHEN o_orderkey % 2 = 0 THEN ' Street' ELSE ' St.' END AS line1,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey || ' ' || substr(md5(o_custkey::VARCHAR), 1, 8) || CASE WHEN o_orderkey % 2 = 1 THEN ' Street' ELSE ' St.' END END AS billing1,
    (10000 + (o_custkey * 7919) % 90000)::VARCHAR AS zip,
    (o_orderdate + to_seconds(o_orderkey % 86400))::TIMESTAMP AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

CANON = f"""canon AS MATERIALIZED (
  SELECT *,
    CASE WHEN email IS NOT NULL THEN
      replace(split_part(split_part(lower(email), '@', 1), '+', 1), CASE WHEN split_part(lower(email), '@', 2) IN ('gmail.com', 'googlemail.com') THEN '.' ELSE ' ' END, '')
      || '@' || split_part(lower(email), '@', 2) END AS canonical_email,
    CASE WHEN phone_kind IN (0, 1) THEN '+1415555' || digits END AS canonical_phone,
    {_words('line1')} AS n1, CASE WHEN billing1 IS NOT NULL THEN {_words('billing1')} END AS b1,
    CASE WHEN is_v6 THEN '2402:800:' || lower(to_hex(c % 200)) ELSE '10.' || (c % 8) || '.' || (c % 200) END AS ip_key,
    CASE WHEN is_v6 THEN 'ip_v6_48' ELSE 'ip_v4_24' END AS ip_tag
  FROM src)"""

KEYS = """keys AS MATERIALIZED (
  SELECT *, n1 || '||' || zip || '|US' AS full_key, regexp_replace(n1, '^[0-9]+[a-z]?( |$)', '') || '|' || zip || '|US' AS house_key,
    b1 || '||' || zip || '|US' AS billing_key, split_part(canonical_email, '@', 1) AS local FROM canon)"""


def _tri_email() -> str:
    return f"CASE WHEN local IS NOT NULL THEN list_sort(list_distinct({_windows('local')})) END"


def _tri_address() -> str:
    words = "list_filter(string_split(n1 || ' ' || zip || ' US', ' '), lambda w: length(w) >= 3)"
    return f"list_sort(list_distinct(flatten(list_transform({words}, lambda w: {_windows('w')}))))"


def _sig(salt: str = "salt_hex", name: str = "sig", shops: str = "shops") -> str:
    return f"""states_{name} AS MATERIALIZED (SELECT shop_id, {_states(salt)} FROM {shops}),
tri_{name} AS MATERIALIZED (SELECT keys.*, st.* EXCLUDE (shop_id), {_tri_email()} AS tri_email, {_tri_address()} AS tri_address
  FROM keys JOIN states_{name} st USING (shop_id)),
{name} AS MATERIALIZED (SELECT record_id, shop_id, order_gid, order_name, offer_id, p, customer_gid, created_at, ip_tag,
  {_hash('canonical_phone', 'state_phone')} AS phone_hash, {_hash('canonical_email', 'state_email')} AS email_hash,
  {_hash('full_key', 'state_full')} AS address_full_hash, {_hash('house_key', 'state_house')} AS address_house_hash,
  {_hash('billing_key', 'state_full')} AS billing_full_hash,
  {_hash('ip_key', 'CASE WHEN is_v6 THEN state_v6 ELSE state_v4 END')} AS ip_hash,
  {_sketch('tri_email')} AS email_sketch, {_sketch('tri_address')} AS address_sketch FROM tri_{name})"""


BASE = f"WITH {SHOPS},\n{SRC},\n{CANON},\n{KEYS}"
SIG = f"{BASE},\n{_sig()}"
REC = f"""{SIG},
rec AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY created_at, record_id) AS pos FROM sig WHERE p <> '5')"""


def _list(col: str) -> str:
    return f"coalesce(array_to_string({col}, ','), '')"


def _jaccard(a: str, b: str) -> str:
    return (
        f"len(list_filter(list_slice(list_sort(list_distinct(list_concat({a}, {b}))), 1, 4), "
        f"lambda v: list_contains({a}, v) AND list_contains({b}, v))) / 4.0"
    )


def _linked(exact: bool) -> str:
    """Scored pairs and the best of each order; ``exact`` = with the exact signals."""
    sketches = """SELECT offer_id, pos, 4 AS space, unnest(list_distinct(email_sketch)) AS v FROM rec
  UNION ALL SELECT offer_id, pos, 5, unnest(list_distinct(address_sketch)) FROM rec"""
    exacts = """ UNION ALL SELECT offer_id, pos, 0, phone_hash FROM rec UNION ALL SELECT offer_id, pos, 1, email_hash FROM rec
  UNION ALL SELECT offer_id, pos, 2, address_full_hash FROM rec UNION ALL SELECT offer_id, pos, 2, billing_full_hash FROM rec
  UNION ALL SELECT offer_id, pos, 3, ip_hash FROM rec"""
    on = lambda cond: cond if exact else "FALSE"
    address = " OR ".join(f"coalesce(x.{a} = y.{b}, FALSE)" for a in ("address_full_hash", "billing_full_hash") for b in ("address_full_hash", "billing_full_hash"))
    return f"""{REC},
facet AS MATERIALIZED ({sketches}{exacts if exact else ''}),
cand AS MATERIALIZED (SELECT DISTINCT f.offer_id, f.pos, g.pos AS prior FROM facet f JOIN facet g
  ON f.offer_id = g.offer_id AND f.space = g.space AND f.v = g.v AND g.pos < f.pos{' AND (f.space < 4 OR f.pos - g.pos <= 10000)' if exact else ''}),
feat AS MATERIALIZED (SELECT cand.*, y.record_id AS prior_id, x.ip_tag,
  {on('coalesce(x.phone_hash = y.phone_hash, FALSE)')} AS phone, {on('coalesce(x.email_hash = y.email_hash, FALSE)')} AS email,
  {on(f'({address})')} AS addr, {on('coalesce(x.ip_hash = y.ip_hash, FALSE)')} AS ip,
  coalesce({_jaccard('x.email_sketch', 'y.email_sketch')}, 0) AS je, coalesce({_jaccard('x.address_sketch', 'y.address_sketch')}, 0) AS ja
  FROM cand JOIN rec x ON x.offer_id = cand.offer_id AND x.pos = cand.pos JOIN rec y ON y.offer_id = cand.offer_id AND y.pos = cand.prior),
scored AS MATERIALIZED (SELECT *, CASE WHEN phone THEN 10 ELSE 0 END
    + CASE WHEN email THEN 10 WHEN je >= 0.5 THEN 6 WHEN je >= 0.25 THEN 4 ELSE 0 END
    + CASE WHEN addr THEN 10 WHEN ja >= 0.5 THEN 6 WHEN ja >= 0.25 THEN 4 ELSE 0 END + CASE WHEN ip THEN 2 ELSE 0 END AS score,
  list_filter([CASE WHEN addr THEN 'address_full' WHEN ja >= 0.5 THEN 'address_fuzzy_strong' WHEN ja >= 0.25 THEN 'address_fuzzy_weak' END,
    CASE WHEN email THEN 'email_canonical' WHEN je >= 0.5 THEN 'email_fuzzy_strong' WHEN je >= 0.25 THEN 'email_fuzzy_weak' END,
    CASE WHEN ip THEN ip_tag END, CASE WHEN phone THEN 'phone' END], lambda f: f IS NOT NULL) AS facts FROM feat),
top AS MATERIALIZED (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY offer_id, pos) AS best FROM scored) WHERE score = best AND score > 0),
best AS MATERIALIZED (SELECT rec.offer_id, rec.record_id, rec.shop_id, rec.order_gid, rec.customer_gid, coalesce(max(best), 0)::BIGINT AS score,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(facts) FILTER (facts IS NOT NULL)))), ','), '') AS facts
  FROM rec LEFT JOIN top ON top.offer_id = rec.offer_id AND top.pos = rec.pos GROUP BY ALL)"""


_LINKED = _linked(True)

_FIELD = {
    "phone": _hex("phone_hash"), "email": _hex("email_hash"), "addr_full": _hex("address_full_hash"), "addr_house": _hex("address_house_hash"),
    "ip": _hex("ip_hash"), "device": "NULL::VARCHAR",
    "email_sketch": f"array_to_string(list_transform(email_sketch, lambda v: {_hex('v')}), '')",
    "addr_sketch": f"array_to_string(list_transform(address_sketch, lambda v: {_hex('v')}), '')",
}
_EMPTY_BUCKET = '{"mode":"\' || mode || \'","entry_ts":[],' + ",".join(f'"{n}":[]' for n in ARRAYS) + "}"


def _kept() -> str:
    running = "OVER (PARTITION BY shop_id, offer_id ORDER BY rank)"
    cost = " + ".join(f"coalesce(length({f}) + 3, 0) - CASE WHEN {f} IS NOT NULL AND count({f}) {running} = 1 THEN 1 ELSE 0 END" for f in ARRAYS.values())
    return f"""{REC},
entry AS MATERIALIZED (SELECT shop_id, offer_id, record_id, CASE WHEN p = '4' THEN 'watch' ELSE 'block' END AS mode, epoch(created_at)::BIGINT AS ts,
  {', '.join(f'{v} AS {k}' for k, v in _FIELD.items())} FROM rec),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY ts DESC, record_id DESC) AS rank FROM entry),
cost AS MATERIALIZED (SELECT *, {cost} + length(ts::VARCHAR) + 1 - CASE WHEN count(*) {running} = 1 THEN 1 ELSE 0 END
  + CASE WHEN count(*) {running} = 1 THEN length('"' || offer_id || '":{_EMPTY_BUCKET}') + 1 ELSE 0 END AS cost FROM ranked),
kept AS MATERIALIZED (SELECT * FROM (SELECT cost.*, salt_hex, (length('{{"v":2,"salt_hex":"' || salt_hex || '","default_country_cc":null,"offers":{{}}}}') - 1
  + sum(cost) OVER (PARTITION BY shop_id ORDER BY rank))::BIGINT AS bytes FROM cost JOIN shops USING (shop_id)) WHERE bytes <= {MAX_BYTES}),
bucket AS MATERIALIZED (SELECT shop_id, offer_id, min(mode) AS mode, list(ts ORDER BY ts, record_id) AS entry_ts,
  {', '.join(f"coalesce(list({f} ORDER BY ts, record_id) FILTER ({f} IS NOT NULL), []) AS {n}" for n, f in ARRAYS.items())} FROM kept GROUP BY ALL)"""


def _screen(kept: str) -> str:
    return f"""{kept}, hit AS (SELECT s.record_id, k.offer_id, max((k.phone = {_hex('s.phone_hash')})::INT) AS ph, max((k.email = {_hex('s.email_hash')})::INT) AS em,
  max((k.addr_full = {_hex('s.address_full_hash')})::INT) AS fu, max((k.addr_house = {_hex('s.address_house_hash')})::INT) AS ho
  FROM sig s JOIN kept k ON s.shop_id = k.shop_id GROUP BY 1, 2),
points AS (SELECT s.record_id, b.offer_id, b.mode, (10 * coalesce(ph, 0) + 10 * coalesce(em, 0) + CASE WHEN fu = 1 THEN 10 WHEN ho = 1 THEN 8 ELSE 0 END
  + CASE WHEN s.record_id % 50 = 0 THEN 10 ELSE 0 END)::BIGINT AS score
  FROM sig s JOIN bucket b ON s.shop_id = b.shop_id LEFT JOIN hit ON hit.record_id = s.record_id AND hit.offer_id = b.offer_id)
SELECT record_id AS buyer_id, offer_id, mode, score, score >= 10 AND mode = 'block' AS blocked FROM points WHERE score > 0"""


def _quoted(col: str) -> str:
    return f"CASE WHEN len({col}) = 0 THEN '[]' ELSE '[\"' || array_to_string({col}, '\",\"') || '\"]' END"


_BUCKET_JSON = (
    "'\"' || offer_id || '\":{\"mode\":\"' || mode || '\",\"entry_ts\":[' || array_to_string(entry_ts, ',') || ']' || "
    + " || ".join(f"',\"{n}\":' || {_quoted(n)}" for n in ARRAYS)
    + " || '}'"
)

FLAGS = f"""flags AS MATERIALIZED (SELECT shop_id, offer_id, order_gid, order_name, customer_gid, created_at, k,
  (4 + k % 14)::BIGINT AS score, CASE WHEN 4 + k % 14 >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
  CASE WHEN k % 60 = 0 THEN 'dismissed' ELSE 'pending' END AS merchant_action,
  CASE k % 3 WHEN 0 THEN ['phone'] WHEN 1 THEN ['email_canonical', 'ip_v4_24'] ELSE ['address_full'] END AS facts
  FROM src)"""
OFFERS = """offers AS MATERIALIZED (SELECT shop_id || ':' || p AS offer_id, shop_id, 'Welcome ' || p AS name, 'active' AS status, p,
  CASE WHEN p = '4' THEN 'watch' ELSE 'block' END AS mode, CASE WHEN p = '5' THEN TIMESTAMP '2001-01-01' END AS archived_at
  FROM (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS p FROM orders), shops)"""
REQUESTS = f"""reqs AS MATERIALIZED (SELECT *, CASE WHEN c % 4 = 0 THEN received_at + to_days((c % 11)::INTEGER) END AS completed_at FROM (
  SELECT c_custkey AS c, 'req/' || c_custkey AS request_id, 'shop_' || (c_nationkey % 5) AS shop_id, 'customer/' || c_custkey AS customer_gid,
  CASE c_custkey % 3 WHEN 0 THEN 'customers/redact' WHEN 1 THEN 'customers/data_request' ELSE 'shop/redact' END AS topic,
  TIMESTAMP '{NOW}' - to_days((c_custkey % 20)::INTEGER) - to_seconds(c_custkey % 1000) AS received_at,
  CASE WHEN c_custkey % 4 = 0 THEN 'completed' ELSE 'pending' END AS status FROM customer))"""
DELIVERIES = """deliveries AS MATERIALIZED (SELECT 'wh/' || event_id AS webhook_gid, 'shop_' || (user_id % 5) AS shop_id, event_type AS topic, props AS payload, ts AS received_at,
  CASE WHEN event_id % 9 <> 0 THEN ts + to_seconds(event_id % 97) END AS processed_at, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'done' END AS status
  FROM (SELECT event_id, user_id, event_type, props, ts FROM events UNION ALL SELECT event_id, user_id, event_type, props, ts + to_minutes(5) FROM events WHERE event_id % 10 = 0))"""
JOBS = """jobs AS MATERIALIZED (SELECT event_id AS job_id, 'shop_' || (user_id % 5) AS shop_id, event_type AS type, event_id % 7 AS attempts, repeat(props, 40) AS payload, ts AS created_at,
  CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' ELSE 'complete' END AS status,
  CASE WHEN event_id % 6 >= 4 THEN ts + to_seconds(event_id % 50) END AS completed_at FROM events)"""
MERCHANTS = """merchants AS MATERIALIZED (SELECT s_suppkey AS shop_id, 'Shop-' || s_suppkey || '.example.com' AS shop_domain,
  TIMESTAMP '2001-01-01' + to_days(((s_suppkey * 37) % 200)::INTEGER) AS installed_at,
  CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '2001-01-01' + to_days(((s_suppkey * 37) % 200)::INTEGER) + to_days(((s_suppkey * 13) % 60)::INTEGER) END AS uninstalled_at FROM supplier)"""
DISCOUNTS = """discounts AS MATERIALIZED (SELECT p_partkey AS discount_id, 'shop_' || (p_partkey % 5) AS shop_id,
  CASE p_partkey % 5 WHEN 0 THEN 'Welcome' WHEN 1 THEN 'first' WHEN 2 THEN 'new' WHEN 3 THEN 'Intro' ELSE 'plain' END || ' ' || p_name AS title,
  CASE WHEN p_partkey % 13 = 0 THEN [] ELSE ['welcome' || (p_partkey % 40), 'code' || p_partkey] END AS codes, p_partkey % 2 = 0 AS once_per_customer,
  CASE p_partkey % 7 WHEN 0 THEN 'EXPIRED' WHEN 1 THEN 'SCHEDULED' ELSE 'ACTIVE' END AS status,
  TIMESTAMP '2001-01-01' + to_days((p_partkey % 100)::INTEGER) AS created_at FROM part)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


_REPORT = _with(SHOPS, SRC, FLAGS, OFFERS)
_IP = "CASE WHEN is_v6 THEN '2402:0800:' || lower(to_hex(c % 200)) || '::' || lower(to_hex(k % 250)) ELSE '10.' || (c % 8) || '.' || (c % 200) || '.' || (k % 250) END"
_MONTH = f"created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY"
_ROLLUP = (
    _with(MERCHANTS)
    + """, rollup AS (SELECT m.shop_id, shop_domain, coalesce(o, 0)::BIGINT AS offers, coalesce(r, 0)::BIGINT AS redemptions, coalesce(f, 0)::BIGINT AS flags
  FROM merchants m LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_linenumber) AS o, count(*) AS r, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1) ON l_suppkey = m.shop_id)"""
)

ORACLES: dict[str, str] = {
    "canonical_email": f"{BASE} SELECT record_id, canonical_email FROM canon",
    "canonical_phone": f"{BASE} SELECT record_id, canonical_phone, CASE WHEN phone_kind < 2 THEN '+1415555' || digits WHEN phone_kind = 2 THEN '+1415555' || digits END AS phone_with_prefix FROM canon",
    "address_keys": f"{BASE} SELECT record_id, full_key, house_key FROM keys",
    "ip_prefix": f"{BASE} SELECT record_id, ip_key, ip_tag FROM canon",
    "email_trigrams": f"{BASE} SELECT record_id, array_to_string({_tri_email()}, ',') AS trigrams FROM keys WHERE local IS NOT NULL",
    "address_trigrams": f"{BASE} SELECT record_id, array_to_string({_tri_address()}, ',') AS trigrams FROM keys",
    "fnv_lookup_hash": f"{SIG} SELECT record_id, " + ", ".join(f"{_hex(c)} AS {c}" for c in ("phone_hash", "email_hash", "address_full_hash", "address_house_hash", "billing_full_hash", "ip_hash")) + " FROM sig",
    "minhash_sketch": f"{SIG} SELECT record_id, {_list('email_sketch')} AS email_sketch, {_FIELD['addr_sketch']} AS address_sketch FROM sig",
    "check_orders": f"""{_with(SRC)}, raw AS (SELECT *, CASE k % 10 WHEN 1 THEN 'no_order_id' WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'not_json' END AS reason,
  CASE phone_kind WHEN 0 THEN '+1 (415) 555-' || digits WHEN 1 THEN '001415555' || digits WHEN 2 THEN '0415555' || digits END AS raw_phone, {_IP} AS raw_ip FROM src)
SELECT record_id, reason, CASE WHEN reason IS NULL THEN order_gid END AS order_gid, CASE WHEN reason IS NULL THEN raw_phone END AS phone,
  CASE WHEN reason IS NULL THEN raw_ip END AS ip, CASE WHEN reason IS NULL THEN CASE WHEN k % 5 <> 0 THEN line1 ELSE billing1 END END AS ship1,
  CASE WHEN reason IS NULL AND k % 5 <> 0 THEN billing1 END AS bill1, CASE WHEN reason IS NULL THEN 'WELCOME' || p END AS code, TRUE AS has_payload FROM raw""",
    "match_codes": f"{BASE} SELECT record_id, shop_id, offer_id, 'WELCOME' || p AS code_used, CASE WHEN p = '4' THEN 'watch' ELSE 'block' END AS offer_mode FROM src WHERE p <> '5'",
    "exact_candidates": f"""{REC}, facet AS (SELECT DISTINCT * FROM (
  SELECT offer_id, record_id, pos, 'phone' AS signal, phone_hash AS hash FROM rec UNION ALL SELECT offer_id, record_id, pos, 'email', email_hash FROM rec
  UNION ALL SELECT offer_id, record_id, pos, 'address', address_full_hash FROM rec UNION ALL SELECT offer_id, record_id, pos, 'address', billing_full_hash FROM rec
  UNION ALL SELECT offer_id, record_id, pos, 'ip', ip_hash FROM rec) WHERE hash IS NOT NULL)
SELECT offer_id, record_id, signal, hash, n_prior, first_prior_id FROM (SELECT *, row_number() OVER w - 1 AS n_prior,
  first_value(record_id) OVER w AS first_prior_id FROM facet WINDOW w AS (PARTITION BY offer_id, signal, hash ORDER BY pos)) WHERE n_prior > 0""",
    "recent_candidates": f"""{BASE}, r AS (SELECT offer_id, record_id, row_number() OVER (PARTITION BY offer_id ORDER BY created_at, record_id) AS pos FROM src WHERE p <> '5')
SELECT x.offer_id, x.record_id, x.pos, least(x.pos - 1, 10000) AS n_recent, y.record_id AS oldest_id
FROM r x LEFT JOIN r y ON x.offer_id = y.offer_id AND x.pos > 1 AND y.pos = x.pos - least(x.pos - 1, 10000)""",
    "fuzzy_best": f"{_linked(False)} SELECT offer_id, record_id, score, facts FROM best",
    "score_orders_hot": f"{_LINKED} SELECT offer_id, record_id, score, facts FROM best",
    "score_orders": f"{_LINKED} SELECT offer_id, record_id, score, facts FROM best",
    "match_attribution": f"""{_LINKED}, w AS (SELECT DISTINCT offer_id, pos, prior FROM top)
SELECT x.offer_id, x.record_id, array_to_string(list_sort(list_distinct(list(y.record_id))), ',') AS matched_ids
FROM w JOIN rec x ON x.offer_id = w.offer_id AND x.pos = w.pos JOIN rec y ON y.offer_id = w.offer_id AND y.pos = w.prior GROUP BY 1, 2""",
    "flagged_orders": f"{_LINKED} SELECT shop_id, order_gid, offer_id, customer_gid, CASE WHEN score >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, score, facts FROM best WHERE score >= 4",
    "backfill_new": f"{BASE} SELECT record_id, shop_id, order_gid, offer_id, 'WELCOME' || p AS code_used, epoch(created_at)::BIGINT AS created_at FROM src WHERE p <> '5' AND record_id % 3 <> 0",
    "dedupe_deliveries": f"{_with(DELIVERIES)} SELECT webhook_gid, topic, sha256(payload) AS payload_sha256, epoch_us(received_at) AS received_at FROM (SELECT *, row_number() OVER (PARTITION BY webhook_gid ORDER BY received_at) AS r FROM deliveries) WHERE r = 1",
    "retention_keep": f"""{BASE} SELECT record_id, shop_id, epoch(created_at)::BIGINT AS created_at FROM src JOIN shops USING (shop_id)
WHERE uninstalled_at IS NOT NULL OR retention_days = 0 OR created_at >= TIMESTAMP '{NOW}' - to_days(retention_days)""",
    "redact_customers": f"""{SIG}, {REQUESTS}, hit AS (SELECT DISTINCT shop_id, customer_gid, TRUE AS hit FROM reqs WHERE topic = 'customers/redact')
SELECT record_id, CASE WHEN hit IS NULL THEN sig.customer_gid END AS customer_gid, CASE WHEN hit IS NULL THEN email_hash END AS email_hash,
  CASE WHEN hit IS NULL THEN billing_full_hash END AS billing_full_hash, CASE WHEN hit IS NULL THEN {_list('address_sketch')} ELSE '' END AS address_sketch
FROM sig LEFT JOIN hit ON sig.shop_id = hit.shop_id AND sig.customer_gid = hit.customer_gid""",
    "redact_flags": f"""{_REPORT}, {REQUESTS} SELECT order_gid, score, CASE WHEN NOT EXISTS (SELECT 1 FROM reqs r WHERE r.topic = 'customers/redact'
  AND r.shop_id = flags.shop_id AND r.customer_gid = flags.customer_gid) THEN customer_gid END AS customer_gid FROM flags""",
    "purge_shop": f"{_REPORT} SELECT 'ledger' AS table_name, shop_id, order_gid FROM src WHERE shop_id <> 'shop_4' UNION ALL SELECT 'flags', shop_id, order_gid FROM flags WHERE shop_id <> 'shop_4'",
    "backfill_ip": f"{SIG} SELECT record_id, ip_hash, ip_tag FROM sig",
    "backfill_billing": f"""{SIG} SELECT record_id, CASE WHEN record_id % 2 = 1 OR billing_full_hash <> address_full_hash THEN billing_full_hash END AS billing_full_hash,
  billing_full_hash IS NOT NULL AND (record_id % 2 = 1 OR billing_full_hash <> address_full_hash) AS has_cipher FROM sig""",
    "rotate_salt": f"""{BASE}, turned AS (SELECT shop_id, CASE WHEN shop_id <= 'shop_2' THEN md5('new:' || shop_id) ELSE salt_hex END AS salt_hex FROM shops),
{_sig('salt_hex', 'sig2', 'turned')} SELECT record_id, phone_hash, email_hash, address_full_hash, address_house_hash, billing_full_hash, ip_hash,
  {_list('email_sketch')} AS email_sketch, {_list('address_sketch')} AS address_sketch FROM sig2""",
    "rotate_salt_versions": f"{BASE} SELECT shop_id, CASE WHEN shop_id <= 'shop_2' THEN md5('new:' || shop_id) ELSE salt_hex END AS salt_hex, CASE WHEN shop_id <= 'shop_2' THEN 2 ELSE 1 END::BIGINT AS salt_version FROM shops WHERE shop_id IN (SELECT shop_id FROM src)",
    "encrypt_roundtrip": f"{BASE} SELECT record_id, canonical_email AS email, canonical_phone AS phone, line1 AS address1, {_IP} AS ip, CASE WHEN email IS NOT NULL THEN TRUE END AS sealed FROM canon",
    "rewrap_keys": "SELECT c_custkey, TRUE AS kept FROM customer",
    "export_decrypted": f"""{_with(SHOPS, SRC, CANON, FLAGS)}, {REQUESTS}, items AS (SELECT shop_id, customer_gid, 'redemption' AS kind, order_gid, canonical_email AS email, canonical_phone AS phone, line1 AS address1, {_IP} AS ip, NULL::BIGINT AS score FROM canon
  UNION ALL SELECT shop_id, customer_gid, 'flag', order_gid, NULL, NULL, NULL, NULL, score FROM flags)
SELECT request_id, kind, order_gid, email, phone, address1, ip, score FROM reqs r LEFT JOIN items i ON r.shop_id = i.shop_id AND r.customer_gid = i.customer_gid WHERE topic = 'customers/data_request'""",
    "export_subject": f"""{_REPORT}, {REQUESTS}, items AS (SELECT shop_id, customer_gid, 'redemption' AS kind, order_gid FROM src UNION ALL SELECT shop_id, customer_gid, 'flag', order_gid FROM flags)
SELECT request_id, r.customer_gid, kind, order_gid FROM reqs r LEFT JOIN items i ON r.shop_id = i.shop_id AND r.customer_gid = i.customer_gid WHERE topic = 'customers/data_request'""",
    "export_envelopes": f"""{_REPORT}, {REQUESTS}, items AS (SELECT shop_id, customer_gid, 'redemption' AS kind, order_gid FROM src UNION ALL SELECT shop_id, customer_gid, 'flag', order_gid FROM flags)
SELECT request_id, r.customer_gid, '{NOW}' AS generated_at, coalesce(string_agg(order_gid, ',' ORDER BY order_gid) FILTER (kind = 'redemption'), '') AS redemptions,
  coalesce(string_agg(order_gid, ',' ORDER BY order_gid) FILTER (kind = 'flag'), '') AS flagged
FROM reqs r LEFT JOIN items i ON r.shop_id = i.shop_id AND r.customer_gid = i.customer_gid WHERE topic = 'customers/data_request' GROUP BY ALL""",
    "archive_logs": f"{_with(DELIVERIES)} SELECT webhook_gid, epoch_us(received_at) AS received_at FROM deliveries WHERE received_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 10 DAY",
    "dispose_flags": f"{_REPORT} SELECT order_gid, CASE WHEN score % 3 = 0 THEN 'confirmed' ELSE merchant_action END AS merchant_action, CASE WHEN score % 3 = 0 THEN epoch(created_at + INTERVAL 2 DAY)::BIGINT END AS merchant_action_at FROM flags",
    "settle_dead_letters": f"""{_with(JOBS)} SELECT job_id, CASE WHEN status = 'failed' AND job_id % 4 <> 0 THEN CASE WHEN job_id % 2 = 0 THEN 'pending' ELSE 'archived' END ELSE status END AS status,
  CASE WHEN status = 'failed' AND job_id % 4 <> 0 AND job_id % 2 = 0 THEN 0 ELSE attempts END::BIGINT AS attempts,
  CASE WHEN status = 'failed' AND job_id % 4 <> 0 AND job_id % 2 = 1 THEN epoch_us(TIMESTAMP '{EVENTS_NOW}') ELSE epoch_us(completed_at) END AS completed_at FROM jobs""",
    "uninstall_shops": f"""{_with(MERCHANTS)}, last AS (SELECT user_id, arg_max(event_type, ts) AS t, max(ts) AS seen FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1)
SELECT shop_id, epoch_us(CASE WHEN t IS NULL THEN uninstalled_at WHEN t = 'error' THEN seen END) AS uninstalled_at FROM merchants LEFT JOIN last ON user_id = shop_id""",
    "cancel_pending": f"{_with(JOBS)} SELECT shop_id, CASE WHEN status = 'pending' AND shop_id = 'shop_4' THEN 'cancelled' ELSE status END AS status, count(*) AS n, count(completed_at) AS completed FROM jobs GROUP BY ALL",
    "change_offers": f"""{_REPORT}, ranked AS (SELECT offer_id, k, row_number() OVER (PARTITION BY offer_id ORDER BY created_at DESC, k DESC) AS r FROM src),
last AS (SELECT offer_id, bool_or(k % 2 = 0) AS s, bool_or(k % 3 = 0) AS m, arg_min(k % 7, r) FILTER (k % 7 < 2) AS a FROM ranked GROUP BY 1)
SELECT offer_id, CASE WHEN s THEN 'inactive' ELSE status END AS status, CASE WHEN m THEN 'watch' ELSE mode END AS mode,
  CASE WHEN a IS NULL THEN archived_at IS NOT NULL ELSE a = 0 END AS archived FROM offers LEFT JOIN last USING (offer_id)""",
    "redeemer_tags": f"""{BASE}, {REQUESTS} SELECT DISTINCT shop_id, customer_gid FROM src WHERE customer_gid IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM reqs r WHERE r.topic = 'customers/redact' AND r.shop_id = src.shop_id AND r.customer_gid = src.customer_gid)""",
    "snapshot_evict": f"{_kept()} SELECT shop_id, record_id, rank, bytes FROM kept",
    "offer_buckets": f"{_kept()} SELECT shop_id, offer_id, mode, array_to_string(entry_ts, ',') AS entry_ts, " + ", ".join(f"array_to_string({n}, ',') AS {n}" for n in ARRAYS) + " FROM bucket",
    "snapshot_documents": f"""{_kept()}, doc AS (SELECT shop_id, '{{"v":2,"salt_hex":"' || salt_hex || '","default_country_cc":null,"offers":{{' || coalesce(body, '') || '}}}}' AS document
  FROM shops LEFT JOIN (SELECT shop_id, string_agg({_BUCKET_JSON}, ',' ORDER BY offer_id) AS body FROM bucket GROUP BY 1) USING (shop_id))
SELECT shop_id, strlen(document)::BIGINT AS bytes, coalesce(n, 0)::BIGINT AS entries, oldest_ts, newest_ts, md5(document) AS document_md5
FROM doc LEFT JOIN (SELECT shop_id, count(*) AS n, min(ts) AS oldest_ts, max(ts) AS newest_ts FROM kept GROUP BY 1) USING (shop_id)""",
    "screen_buyers": _screen(_kept()),
    "screen_after_rotation": _screen(_kept().replace("md5('salt:' || shop_id) AS salt_hex", "CASE WHEN n <= 2 THEN md5('new:' || shop_id) ELSE md5('salt:' || shop_id) END AS salt_hex")),
    "screen_after_archiving": _screen(_kept().replace("WHERE p <> '5'", "WHERE p <> '1'")),
    "offer_counts_30d": f"""{_REPORT} SELECT offer_id, shop_id, name, status, (SELECT count(*) FROM src s WHERE s.offer_id = o.offer_id AND {_MONTH}) AS redemptions,
  (SELECT count(*) FROM flags f WHERE f.offer_id = o.offer_id AND {_MONTH}) AS flagged FROM offers o WHERE archived_at IS NULL""",
    "offer_detail": f"""{_REPORT} SELECT offer_id, name, status, mode, (SELECT count(*) FROM src s WHERE s.offer_id = o.offer_id AND {_MONTH}) AS redemptions_30d,
  (SELECT count(*) FROM flags f WHERE f.offer_id = o.offer_id AND {_MONTH}) AS flagged_30d, (SELECT count(*) FROM flags f WHERE f.offer_id = o.offer_id) AS flagged_total FROM offers o WHERE archived_at IS NULL""",
    "recent_offer_flags": f"{_REPORT} SELECT offer_id, order_gid, rank FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY created_at DESC, order_gid) AS rank FROM flags) WHERE rank <= 10",
    "platform_dashboard": f"""{_with(SHOPS, SRC, FLAGS, MERCHANTS, JOBS, DELIVERIES, REQUESTS)}, d AS (SELECT TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR AS day, TIMESTAMP '{EVENTS_NOW}' - INTERVAL 1 HOUR AS hr)
SELECT (SELECT count(*) FROM merchants, d WHERE installed_at >= day) AS installs_24h, (SELECT count(*) FROM merchants, d WHERE uninstalled_at >= day) AS uninstalls_24h,
  (SELECT count(*) FROM src, d WHERE created_at >= day) AS redemptions_24h, (SELECT count(*) FROM flags, d WHERE created_at >= day) AS flagged_24h,
  (SELECT count(*) FROM jobs WHERE status = 'pending') AS jobs_pending, (SELECT count(*) FROM jobs WHERE status = 'running') AS jobs_running,
  (SELECT count(*) FROM jobs, d WHERE status = 'complete' AND completed_at >= hr) AS jobs_done_1h, (SELECT count(*) FROM jobs WHERE status = 'failed') AS jobs_failed,
  (SELECT count(*) FROM deliveries, d WHERE status = 'failed' AND received_at >= day) AS delivery_failures_24h,
  (SELECT count(*) FROM reqs WHERE topic = 'customers/data_request' AND status = 'pending') AS pending_exports,
  (SELECT count(*) FROM reqs WHERE topic = 'customers/redact' AND status = 'pending') AS pending_erasures, (SELECT count(*) FROM reqs WHERE topic = 'shop/redact' AND status = 'pending') AS pending_purges""",
    "platform_metrics": f"""{_with(SHOPS, SRC, FLAGS, MERCHANTS)}, d AS (SELECT TIMESTAMP '2001-07-25' - INTERVAL 7 DAY AS wk, TIMESTAMP '2001-07-25' - INTERVAL 30 DAY AS mo),
m AS (SELECT count(*) FILTER (installed_at >= wk) AS installs_7d, count(*) FILTER (uninstalled_at >= wk) AS uninstalls_7d, count(*) FILTER (installed_at >= mo) AS installs_30d FROM merchants, d),
r AS (SELECT count(*) AS redemptions_30d FROM src, d WHERE created_at >= mo), f AS (SELECT count(*) AS flagged_30d, count(*) FILTER (merchant_action = 'dismissed') AS dismissed_30d FROM flags, d WHERE created_at >= mo)
SELECT *, CASE WHEN flagged_30d = 0 THEN 0.0 ELSE floor(dismissed_30d * 1000.0::DOUBLE / flagged_30d + 0.5) / 10 END::DOUBLE AS false_positive_pct FROM m, r, f""",
    "shop_overview": f"""{_with(SHOPS, SRC, FLAGS, OFFERS, DELIVERIES)} SELECT shop_id, shop_domain, (SELECT count(*) FROM offers o WHERE o.shop_id = s.shop_id AND archived_at IS NULL) AS offers,
  (SELECT count(*) FROM src r WHERE r.shop_id = s.shop_id AND {_MONTH}) AS redemptions_30d, (SELECT count(*) FROM flags f WHERE f.shop_id = s.shop_id AND {_MONTH}) AS flagged_30d,
  (SELECT count(*) FROM deliveries d WHERE d.shop_id = s.shop_id AND status = 'failed' AND received_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS failures_7d FROM shops s""",
    "shop_rollup_page": f"{_ROLLUP} SELECT * FROM rollup WHERE shop_domain ILIKE '%SHOP-%' ORDER BY redemptions DESC, shop_id LIMIT 20 OFFSET 20",
    "shop_page_count": f"{_with(MERCHANTS)} SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM merchants WHERE shop_domain ILIKE '%7%'",
    "shop_lifecycle": f"{_with(MERCHANTS)} SELECT CASE WHEN uninstalled_at IS NULL THEN 'active' WHEN uninstalled_at >= TIMESTAMP '2001-06-01' - INTERVAL 48 HOUR THEN 'uninstalling' ELSE 'gone' END AS lifecycle, count(*) AS n FROM merchants GROUP BY 1",
    "status_depth": f"{_with(JOBS)} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed' AND attempts < 5) AS failed, count(*) FILTER (status = 'failed' AND attempts >= 5) AS dead FROM jobs",
    "job_list": f"{_with(JOBS)} SELECT job_id, type, status FROM jobs WHERE type LIKE '%err%' ORDER BY created_at DESC, job_id LIMIT 100",
    "dead_letters": f"{_with(JOBS)} SELECT job_id, substr(payload, 1, 200) AS payload FROM jobs WHERE status = 'failed' AND attempts >= 5 ORDER BY created_at DESC, job_id LIMIT 50",
    "requests_by_topic": f"{_with(REQUESTS)} SELECT topic, count(*) AS n, string_agg(request_id, ',' ORDER BY received_at DESC, request_id) AS request_ids FROM (SELECT * FROM reqs ORDER BY received_at DESC, request_id LIMIT 200) GROUP BY 1",
    "request_age": f"""{_with(REQUESTS)} SELECT request_id, age AS age_days, CASE WHEN completed_at IS NOT NULL THEN CASE WHEN age <= 7 THEN 'met' ELSE 'missed' END WHEN age > 7 THEN 'overdue' ELSE 'open' END AS deadline
FROM (SELECT *, date_diff('day', received_at::DATE, coalesce(completed_at, TIMESTAMP '{NOW}')::DATE) AS age FROM reqs)""",
    "pending_flags": f"{_REPORT} SELECT shop_id, count(*) FILTER (merchant_action = 'pending') AS pending FROM flags GROUP BY 1",
    "flag_list_top100": f"{_REPORT} SELECT f.shop_id, order_gid, name AS offer_name, risk_level, score FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY created_at DESC, order_gid) AS r FROM flags) f LEFT JOIN offers o ON f.offer_id = o.offer_id WHERE r <= 100",
    "flag_list_dismissed": f"{_REPORT} SELECT f.shop_id, order_gid, name AS offer_name, risk_level, score FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY created_at DESC, order_gid) AS r FROM flags WHERE merchant_action = 'dismissed' AND offer_id = 'shop_1:2') f LEFT JOIN offers o ON f.offer_id = o.offer_id WHERE r <= 100",
    "find_flag": f"{_REPORT} SELECT order_gid, name AS offer_name, 'Welcome' || p AS code, score FROM flags f LEFT JOIN offers o ON f.offer_id = o.offer_id WHERE f.shop_id = 'shop_2' AND order_gid = (SELECT min(order_gid) FROM flags WHERE shop_id = 'shop_2')",
    "code_conflicts": "SELECT p_partkey % 5 AS shop_id, upper(p_brand) AS code_upper, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2 HAVING count(*) > 1",
    "suggest_discounts": f"""{_with(SHOPS, OFFERS, DISCOUNTS)}, ranked AS (SELECT *, CASE WHEN hay ILIKE '%welcome%' THEN 4 WHEN hay ILIKE '%first%' THEN 3 WHEN regexp_matches(lower(hay), '\\bnew\\b|newbie|newcustomer') THEN 2 WHEN hay ILIKE '%intro%' THEN 1 ELSE 0 END AS name_score
  FROM (SELECT *, title || ' ' || array_to_string(codes, ' ') AS hay FROM discounts WHERE status <> 'EXPIRED' AND len(codes) > 0) d
  WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.shop_id = d.shop_id AND archived_at IS NULL AND list_contains(list_transform(d.codes, lambda c: upper(c)), 'WELCOME' || o.p)))
SELECT shop_id, discount_id, title, once_per_customer, name_score::BIGINT AS name_score FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY once_per_customer DESC, name_score DESC, created_at DESC, discount_id) AS r FROM ranked) WHERE r <= 100""",
    "signal_contribution": f"{_REPORT}, e AS (SELECT offer_id, unnest(facts) AS fact FROM flags), c AS (SELECT offer_id, fact, count(*) AS n FROM e GROUP BY 1, 2) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY offer_id), 6) AS share FROM c",
    "daily_series": f"""{_REPORT}, cal AS (SELECT (DATE '{NOW[:10]}' - i::INTEGER) AS day FROM range(0, 30) t(i))
SELECT day::VARCHAR AS day, (SELECT count(*) FROM src WHERE created_at::DATE = day) AS redemptions, (SELECT count(*) FROM flags WHERE created_at::DATE = day) AS flagged FROM cal""",
    "installs_per_day": f"""{_with(MERCHANTS)}, e AS (SELECT installed_at::DATE AS day, 1 AS i, 0 AS u FROM merchants UNION ALL SELECT uninstalled_at::DATE, 0, 1 FROM merchants WHERE uninstalled_at IS NOT NULL)
SELECT day::VARCHAR AS day, sum(i)::BIGINT AS installs, sum(u)::BIGINT AS uninstalls FROM e GROUP BY 1""",
    "retention_cohorts": f"""{_with(MERCHANTS)}, e AS (SELECT date_trunc('week', installed_at)::DATE AS cohort, w AS week, uninstalled_at, date_trunc('week', installed_at)::TIMESTAMP + to_days((w * 7)::INTEGER) AS week_start FROM merchants, range(0, 9) t(w))
SELECT cohort::VARCHAR AS cohort, week, count(*) AS shops, count(*) FILTER (uninstalled_at IS NULL OR uninstalled_at >= week_start) AS active FROM e WHERE week_start <= TIMESTAMP '2001-06-01' GROUP BY 1, 2""",
    "hourly_redemptions": f"{BASE} SELECT epoch(date_trunc('hour', created_at))::BIGINT AS hour, count(*) AS redemptions FROM src GROUP BY 1",
    "flag_rate_histogram": "SELECT least(f * 10 // r, 9)::BIGINT AS bin, count(*) AS shops FROM (SELECT l_suppkey, count(*) AS r, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1) GROUP BY 1",
    "latency_percentiles": f"""{_with(DELIVERIES)}, t AS (SELECT topic, epoch_ms(processed_at) - epoch_ms(received_at) AS ms FROM deliveries WHERE processed_at IS NOT NULL)
SELECT topic, quantile_cont(ms::DOUBLE, 0.5) AS p50, quantile_cont(ms::DOUBLE, 0.95) AS p95, quantile_cont(ms::DOUBLE, 0.99) AS p99 FROM t GROUP BY 1""",
    "latency_report": f"""{_with(DELIVERIES)} SELECT topic, count(*) AS deliveries, count(processed_at) AS processed, count(DISTINCT shop_id) AS shops, TRUE AS close
FROM deliveries WHERE received_at >= TIMESTAMP '2024-01-05' AND received_at < TIMESTAMP '2024-01-20' GROUP BY 1""",
    "opened_redemptions": f"""{BASE} SELECT shop_id, record_id, order_name, 'WELCOME' || p AS code_used, canonical_email AS email, canonical_phone AS phone, line1 AS address1, epoch(created_at)::BIGINT AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY created_at DESC, record_id DESC) AS r FROM canon) WHERE r <= 100""",
    "setup_status": f"""{_with(MERCHANTS)} SELECT shop_id, EXISTS (SELECT 1 FROM part WHERE 3 * p_partkey = shop_id) AS has_offer, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = shop_id) AS has_redemption FROM merchants""",
    "offers_not_enforced": "SELECT p_partkey AS offer_id FROM part WHERE p_size > 10 AND p_partkey % 2 = 1 AND p_partkey % 3 <> 0",
    "audit_search": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND user_id = 7",
}
