"""DuckDB twins of the registered queries (same columns, same names).

The model rules of ``hitlens.sources.model`` are restated once as SQL views
(CTEs) and every query text is built from them.
"""

from __future__ import annotations

from ..functions.status import BAD_UUID, EMAIL_ALREADY_EXISTS
from ..functions.validation import EMAIL_MESSAGE, EMAIL_PATTERN, LENGTH_MESSAGE, MIN_PASSWORD_LENGTH
from ..functions.windows import FIVE_MINUTES, ONE_DAY, StatDefinition
from ..operators.stats import FRAGMENTS

LOGS = r"""logs AS (
  SELECT CAST(user_id AS VARCHAR) AS site_id, CAST(event_id AS VARCHAR) AS log_id,
         ts AS log_time, '/' || event_type AS url,
         '10.0.0.' || regexp_extract(props, '(\d+)', 1) AS ip_address,
         'agent-' || CAST(event_id % 5 AS VARCHAR) AS user_agent
  FROM events)"""


def windowed(stat: StatDefinition, name: str = "w") -> str:
    r_us, r_ms = stat.range_ms * 1000, stat.range_ms
    return f"""{name} AS (
  SELECT *, make_timestamp((epoch_us(log_time) // {r_us} + 1) * {r_us}) AS stat_time
  FROM logs WHERE (epoch_us(log_time) // 1000) % {r_ms} <> 0)"""


def stamp(stat: StatDefinition) -> str:
    return f"CAST(year(stat_time) AS INTEGER) AS year, stat_time, '{stat.stat_type}' AS stat_type"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["logs_scan"] = with_(LOGS) + "SELECT * FROM logs"
ORACLE["logs_in_window"] = with_(LOGS) + """SELECT * FROM logs
WHERE log_time >= TIMESTAMP '2024-01-09 00:00:00.001' AND log_time < TIMESTAMP '2024-01-10 00:00:00'"""


def _requests(stat):
    return with_(LOGS, windowed(stat)) + f"""SELECT site_id, {stamp(stat)}, count(*) AS requests
FROM w GROUP BY site_id, stat_time"""


def _keyed(stat, key, name):
    return with_(LOGS, windowed(stat)) + f"""SELECT site_id, {stamp(stat)}, {key} AS {name},
  CAST(count(*) AS INTEGER) AS requests
FROM w GROUP BY site_id, stat_time, {key}"""


ORACLE["partial_stats_requests"] = _requests(FIVE_MINUTES)
ORACLE["partial_stats_requests_1d"] = _requests(ONE_DAY)
ORACLE["partial_stats_ip"] = _keyed(ONE_DAY, "ip_address", "ip")
ORACLE["partial_stats_browser"] = _keyed(ONE_DAY, "user_agent", "browser")
ORACLE["partial_stats_url"] = _keyed(ONE_DAY, "url", "url")
ORACLE["partial_stats_url_5m"] = _keyed(FIVE_MINUTES, "url", "url")



def _partial_stats(fragments: int) -> str:
    """The count on fragment 0, the keys spread over all fragments by md5."""
    return with_(LOGS, windowed(ONE_DAY), f"""lv AS (
  SELECT site_id, stat_time, 'ip' AS level, ip_address AS key, count(*) AS n FROM w GROUP BY ALL
  UNION ALL
  SELECT site_id, stat_time, 'browser', user_agent, count(*) FROM w GROUP BY ALL),
e AS (
  SELECT *, CAST(('0x' || substr(md5(key), 1, 8))::BIGINT % {fragments} AS INTEGER) AS fragment, 0 AS requests FROM lv
  UNION ALL
  SELECT site_id, stat_time, 'site', NULL, NULL, 0, count(*) FROM w GROUP BY site_id, stat_time)""") + f"""SELECT site_id,
  {stamp(ONE_DAY)}, fragment, CAST(sum(requests) AS BIGINT) AS requests,
  coalesce(string_agg(key || '=' || n, ',' ORDER BY key) FILTER (WHERE level = 'ip'), '') AS ip,
  coalesce(string_agg(key || '=' || n, ',' ORDER BY key) FILTER (WHERE level = 'browser'), '') AS browser
FROM e GROUP BY site_id, stat_time, fragment"""


ORACLE["partial_stats"] = _partial_stats(FRAGMENTS)
ORACLE["partial_stats_4"] = _partial_stats(4)
ORACLE["partial_stats_sized"] = with_(LOGS, windowed(ONE_DAY), """lv AS (
  SELECT site_id, stat_time, 'ip' AS level, ip_address AS key, count(*) AS n FROM w GROUP BY ALL
  UNION ALL
  SELECT site_id, stat_time, 'browser', user_agent, count(*) FROM w GROUP BY ALL),
f AS (SELECT site_id, stat_time, CAST(ceil(count(*) / 4.0) AS INTEGER) AS fragments FROM lv GROUP BY site_id, stat_time),
e AS (
  SELECT lv.*, fragments, CAST(('0x' || substr(md5(key), 1, 8))::BIGINT % fragments AS INTEGER) AS fragment, 0 AS requests
  FROM lv JOIN f USING (site_id, stat_time)
  UNION ALL
  SELECT site_id, stat_time, 'site', NULL, NULL, fragments, 0, count(*) FROM w JOIN f USING (site_id, stat_time) GROUP BY site_id, stat_time, fragments)""") + f"""SELECT site_id,
  {stamp(ONE_DAY)}, fragment, fragments, CAST(sum(requests) AS BIGINT) AS requests,
  coalesce(string_agg(key || '=' || n, ',' ORDER BY key) FILTER (WHERE level = 'ip'), '') AS ip,
  coalesce(string_agg(key || '=' || n, ',' ORDER BY key) FILTER (WHERE level = 'browser'), '') AS browser
FROM e GROUP BY site_id, stat_time, fragment, fragments"""
ORACLE["partial_stats_whole"] = with_(LOGS, windowed(ONE_DAY), """h AS (
  SELECT site_id, stat_time, 'ip' AS level, ip_address AS key, count(*) AS n FROM w GROUP BY ALL
  UNION ALL SELECT site_id, stat_time, 'browser', user_agent, count(*) FROM w GROUP BY ALL)""") + f"""SELECT site_id, {stamp(ONE_DAY)},
  CAST(sum(n) FILTER (WHERE level = 'ip') AS BIGINT) AS requests,
  string_agg(key || '=' || n, ',' ORDER BY key) FILTER (WHERE level = 'ip') AS ip,
  string_agg(key || '=' || n, ',' ORDER BY key) FILTER (WHERE level = 'browser') AS browser
FROM h GROUP BY site_id, stat_time"""

ORACLE["stats_all_levels"] = with_(LOGS, windowed(ONE_DAY)) + """SELECT
  CASE grouping(url, ip_address, user_agent) WHEN 7 THEN 'site' WHEN 3 THEN 'url'
       WHEN 5 THEN 'ip' WHEN 6 THEN 'browser' END AS level,
  site_id, stat_time, coalesce(url, ip_address, user_agent) AS key, count(*) AS requests
FROM w
GROUP BY GROUPING SETS ((site_id, stat_time), (site_id, stat_time, url),
                        (site_id, stat_time, ip_address), (site_id, stat_time, user_agent))"""

_BOUNDARY = """FROM (
  SELECT * REPLACE (CASE WHEN event_id % 60 = 0 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
    WHEN event_id % 20 = 0 THEN make_timestamp(epoch_us(ts) // 300000000 * 300000000) ELSE ts END AS ts) FROM events)"""
ORACLE["stats_days_from_minutes"] = ORACLE["stats_all_levels"].replace("FROM events", _BOUNDARY, 1)
ORACLE["stats_all_levels_bucketed"] = ORACLE["stats_all_levels"]

ORACLE["global_stats"] = with_(LOGS, windowed(FIVE_MINUTES)) + """SELECT site_id,
  CAST(count(*) AS BIGINT) AS requests FROM w GROUP BY site_id"""
ORACLE["global_stats_url"] = with_(LOGS, windowed(FIVE_MINUTES)) + """SELECT site_id, url,
  CAST(count(*) AS BIGINT) AS requests FROM w GROUP BY site_id, url"""


ORACLE["global_stats_levels"], ORACLE["global_stats_url_levels"] = ORACLE["global_stats"], ORACLE["global_stats_url"]


def _calendar(stat):
    r_us = stat.range_ms * 1000
    return f"""cal AS (
  SELECT make_timestamp((epoch_us(min(log_time)) // {r_us} + 1) * {r_us}) AS first,
         make_timestamp((epoch_us(max(log_time)) // {r_us} + 1) * {r_us}) AS last FROM logs),
due AS (
  SELECT '{stat.stat_type}' AS stat_type, unnest(generate_series(first, last, INTERVAL {stat.range_ms} MILLISECOND)) AS stat_time
  FROM cal)"""


def _reference(stat):
    return with_(LOGS, windowed(stat), _calendar(stat)) + """SELECT due.stat_type, due.stat_time,
  CAST(coalesce(c.n, 0) AS BIGINT) AS affected_records
FROM due LEFT JOIN (SELECT stat_time, count(*) AS n FROM w GROUP BY stat_time) c USING (stat_time)"""


ORACLE["stats_reference"] = _reference(FIVE_MINUTES)
ORACLE["stats_reference_1d"] = _reference(ONE_DAY)
ORACLE["stats_due_windows"] = with_(LOGS, _calendar(ONE_DAY)) + """SELECT stat_type, stat_time FROM due
WHERE day(stat_time) % 2 <> 0"""


# ---------------------------------------------------------------- id helpers (SQL)

_UUID_RE = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_EMAIL_RE = EMAIL_PATTERN.replace("'", "''")


def is_uuid(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '{_UUID_RE}'), false)"


def uuid_from_text(x: str) -> str:
    m = f"md5(CAST({x} AS VARCHAR))"
    return (f"concat_ws('-', substr({m}, 1, 8), substr({m}, 9, 4), substr({m}, 13, 4), "
            f"substr({m}, 17, 4), substr({m}, 21, 12))")


def time_uuid(ts: str, node: str) -> str:
    ticks = f"((epoch_us({ts}) // 1000) * 10000 + 122192928000000000)"
    h = f"lpad(lower(hex({ticks})), 15, '0')"
    return (f"concat_ws('-', substr({h}, 8, 8), substr({h}, 4, 4), '1' || substr({h}, 1, 3), "
            f"'8000', lpad(lower(hex(CAST({node} AS BIGINT))), 12, '0'))")


def user_time(k: str) -> str:
    return f"(TIMESTAMP '2020-01-01 00:00:00' + to_minutes(CAST({k} AS BIGINT)))"


def user_id(k: str) -> str:
    return time_uuid(user_time(k), k)


def site_id(k: str, d: str = "o_orderdate") -> str:
    return time_uuid(d, k)


_UNKNOWN = 1_000_000_000

# ---------------------------------------------------------------- ingestion

RAW = f"""raw AS (
  SELECT log_id AS hit_id,
    CASE WHEN CAST(log_id AS BIGINT) % 41 = 0 THEN 'not-an-id' ELSE {uuid_from_text('site_id')} END AS tracking_id,
    log_time,
    CASE WHEN CAST(log_id AS BIGINT) % 97 = 0 THEN '<html>' || log_id
         WHEN CAST(log_id AS BIGINT) % 89 = 0 THEN '{{"url":' || log_id || ',"ipAddress":"1.2.3.4","userAgent":"a"}}'
         WHEN CAST(log_id AS BIGINT) % 83 = 0 THEN whole || ' and more'
         WHEN CAST(log_id AS BIGINT) % 79 = 0 THEN whole || whole
         WHEN CAST(log_id AS BIGINT) % 73 = 0 THEN replace(whole, '"', chr(39))
         WHEN CAST(log_id AS BIGINT) % 50 = 0 THEN '{{"url":"' || url || '","ipAddress":"' || ip_address || '"}}'
         ELSE whole END AS body
  FROM (SELECT *, '{{"url":"' || url || '","ipAddress":"' || ip_address || '","userAgent":"' || user_agent || '"}}' AS whole FROM logs)),
dec0 AS (
  SELECT *, coalesce(CASE WHEN json_valid(body) THEN json_type(body) END = 'OBJECT', false) AS is_object FROM raw),
dec AS (
  SELECT hit_id, tracking_id, log_time,
    CASE WHEN is_object THEN json_extract_string(body, '$.url') END AS url,
    CASE WHEN is_object THEN json_extract_string(body, '$.ipAddress') END AS ip_address,
    CASE WHEN is_object THEN json_extract_string(body, '$.userAgent') END AS user_agent,
    is_object,
    CASE WHEN is_object THEN [coalesce(json_type(body, '$.url'), 'NULL'), coalesce(json_type(body, '$.ipAddress'), 'NULL'),
      coalesce(json_type(body, '$.userAgent'), 'NULL')] END AS kinds FROM dec0),
dec2 AS (
  SELECT *, CASE WHEN NOT is_object THEN 'malformed' WHEN list_contains(kinds, 'NULL') THEN 'missing_field'
                 WHEN len(list_distinct(kinds)) > 1 OR kinds[1] <> 'VARCHAR' THEN 'wrong_type' END AS reason
  FROM dec),
reg AS (
  SELECT {uuid_from_text('CAST(s_suppkey AS VARCHAR)')} AS tracking_id, CAST(s_suppkey AS VARCHAR) AS site_id
  FROM supplier),
res AS (
  SELECT d.hit_id, d.tracking_id, d.log_time, d.url, d.ip_address, d.user_agent, r.site_id,
    CASE WHEN NOT {is_uuid('d.tracking_id')} THEN 400 WHEN r.site_id IS NULL THEN 404 ELSE 202 END AS status
  FROM (SELECT * FROM dec2 WHERE reason IS NULL) d
  LEFT JOIN reg r ON r.tracking_id = d.tracking_id AND {is_uuid('d.tracking_id')})"""

ORACLE["ingest_decode"] = with_(LOGS, RAW) + """SELECT hit_id, tracking_id, log_time, url, ip_address, user_agent
FROM dec2 WHERE reason IS NULL"""
ORACLE["ingest_quarantine"] = with_(LOGS, RAW) + """SELECT hit_id, tracking_id, reason, 400 AS status
FROM dec2 WHERE reason IS NOT NULL"""
ORACLE["ingest_outcomes"] = with_(LOGS, RAW) + """SELECT outcome, status, count(*) AS hits FROM (
  SELECT CASE status WHEN 400 THEN 'bad_tracking_id' WHEN 404 THEN 'unknown_site' ELSE 'accepted' END AS outcome, status
  FROM res
  UNION ALL SELECT reason, 400 FROM dec2 WHERE reason IS NOT NULL) GROUP BY outcome, status"""
ORACLE["resolve_hits"] = with_(LOGS, RAW) + """SELECT hit_id, site_id, log_time, url, ip_address, user_agent, status
FROM res WHERE status = 202"""
ORACLE["unresolved_hits"] = with_(LOGS, RAW) + """SELECT hit_id, tracking_id, status FROM res WHERE status <> 202"""
HISTORY = f"""intervals AS (
  SELECT {uuid_from_text('CAST(s_suppkey AS VARCHAR)')} AS tracking_id, CAST(s_suppkey AS VARCHAR) AS site_id,
    TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 10 AS INTEGER)) AS valid_from,
    CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 10 + 10 AS INTEGER)) END AS valid_to
  FROM supplier
  UNION ALL
  SELECT {uuid_from_text('CAST(s_suppkey AS VARCHAR)')}, 'new-' || s_suppkey, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 10 + 15 AS INTEGER)), NULL
  FROM supplier WHERE s_suppkey % 6 = 0)"""
ORACLE["resolve_hits_as_of"] = with_(LOGS, RAW, HISTORY) + f"""SELECT hit_id, tracking_id, log_time, CASE WHEN holds THEN site_id END AS site_id,
  CASE WHEN NOT valid THEN 400 WHEN holds THEN 202 ELSE 404 END AS status
FROM (
  SELECT d.hit_id, d.tracking_id, d.log_time, i.site_id, {is_uuid('d.tracking_id')} AS valid,
    coalesce({is_uuid('d.tracking_id')} AND i.site_id IS NOT NULL AND (i.valid_to IS NULL OR d.log_time < i.valid_to + INTERVAL 60 MINUTE), false) AS holds
  FROM (SELECT * FROM dec2 WHERE reason IS NULL) d
  ASOF LEFT JOIN intervals i ON d.tracking_id = i.tracking_id AND d.log_time >= i.valid_from)"""
ORACLE["dedupe_hits"] = with_(LOGS) + """SELECT DISTINCT * FROM (
  SELECT * FROM logs UNION ALL SELECT * FROM logs WHERE CAST(log_id AS BIGINT) % 10 = 0)"""

# ---------------------------------------------------------------- ids, dates

ORACLE["uuid_check"] = f"""SELECT request_id, id, {is_uuid('id')} AS valid,
  CASE WHEN {is_uuid('id')} THEN 200 ELSE 400 END AS status
FROM (SELECT o_orderkey AS request_id,
             CASE WHEN o_orderkey % 10 = 0 THEN 'not-an-id' ELSE {uuid_from_text('o_orderkey')} END AS id
      FROM orders)"""
ORACLE["timeuuid_time"] = with_(LOGS) + f"""SELECT log_id, {time_uuid('log_time', 'CAST(log_id AS BIGINT)')} AS time_id,
  date_trunc('millisecond', log_time) AS created_at FROM logs"""
ORACLE["date_text"] = with_(LOGS) + """SELECT log_id, strftime(log_time, '%d:%m:%y:%H:%M:%S.%g') AS date_text,
  strptime(strftime(log_time, '%d:%m:%y:%H:%M:%S.%g'), '%d:%m:%y:%H:%M:%S.%g') AS parsed FROM logs"""

# ---------------------------------------------------------------- registry

USERS = f"""users AS (
  SELECT {user_id('c_custkey')} AS id, lower(c_name) || '@example.com' AS email, c_name AS full_name,
         {user_time('c_custkey')} AS created
  FROM customer)"""
SITES = f"""sites AS (
  SELECT {site_id('o_orderkey')} AS id, 'site' || CAST(o_orderkey AS VARCHAR) || '.example.com' AS domain,
         {user_id('o_custkey')} AS user_id, {uuid_from_text('o_orderkey')} AS tracking_id,
         date_trunc('millisecond', o_orderdate) AS created
  FROM orders)"""
REQ = f"""req AS (
  SELECT c_custkey AS request_id, c_custkey AS arrival,
    CASE WHEN c_custkey % 10 = 0 THEN 'no-at-sign'
         WHEN c_custkey % 5 = 0 THEN lower(c_name) || '@example.com'
         WHEN c_custkey % 7 = 0 THEN 'shared' || CAST(c_custkey % 3 AS VARCHAR) || '@example.com'
         ELSE 'new' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
    'pw' || CAST(c_custkey AS VARCHAR) AS password, c_name AS full_name,
    TIMESTAMP '2024-02-01 00:00:00' + to_seconds(c_custkey) AS requested_at
  FROM customer),
v AS (
  SELECT *, NOT coalesce(trim(email) <> '' AND regexp_matches(email, '{_EMAIL_RE}'), false) AS bad_email,
         coalesce(length(password) < 6, true) AS bad_pw
  FROM req),
valid AS (SELECT * FROM v WHERE NOT bad_email AND NOT bad_pw),
fresh AS (SELECT * FROM valid WHERE email NOT IN (SELECT email FROM users)),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY arrival, request_id) AS rn FROM fresh)
  WHERE rn = 1)"""
_ERRORS = (f"concat_ws('; ', CASE WHEN bad_email THEN 'email: {EMAIL_MESSAGE.format(field='email')}' END, "
           f"CASE WHEN bad_pw THEN 'password: {LENGTH_MESSAGE.format(field='password', n=MIN_PASSWORD_LENGTH)}' END)")

ORACLE["validate_users"] = with_(USERS, REQ) + f"""SELECT request_id,
  CAST(bad_email AS INTEGER) + CAST(bad_pw AS INTEGER) AS n_errors, {_ERRORS} AS errors FROM v"""
ORACLE["user_create_accepted"] = with_(USERS, REQ) + f"""SELECT request_id,
  {time_uuid('requested_at', 'request_id')} AS user_id, email, full_name, 200 AS status FROM firsts"""
ORACLE["user_create_rejected"] = with_(USERS, REQ) + f"""SELECT request_id, email, 400 AS status,
  '{EMAIL_ALREADY_EXISTS}' AS message
FROM valid WHERE request_id NOT IN (SELECT request_id FROM firsts)
UNION ALL
SELECT request_id, email, 400, {_ERRORS} FROM v WHERE bad_email OR bad_pw"""

UUPD = f"""upd AS (
  SELECT {user_id('c_custkey')} AS id, 1 AS seq, 'Earlier Name ' || CAST(c_custkey AS VARCHAR) AS full_name
  FROM customer WHERE c_custkey % 11 = 0
  UNION ALL
  SELECT {user_id('c_custkey')}, 2, 'Later Name ' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 22 = 0
  UNION ALL
  SELECT {user_id(f'(c_custkey + {_UNKNOWN})')}, 1, 'nobody' FROM customer WHERE c_custkey % 11 = 0)"""
ORACLE["user_update"] = with_(USERS, UUPD) + """SELECT u.id, u.email, coalesce(l.full_name, u.full_name) AS full_name
FROM users u LEFT JOIN (SELECT id, arg_max(full_name, seq) AS full_name FROM upd GROUP BY id) l USING (id)"""
ORACLE["user_update_outcomes"] = with_(USERS, UUPD) + f"""SELECT upd.id, seq, upd.full_name,
  CASE WHEN NOT {is_uuid('upd.id')} THEN 400 WHEN u.id IS NULL THEN 404 ELSE 200 END AS status
FROM upd LEFT JOIN users u USING (id)"""

SUPD = f"""upd AS (
  SELECT {site_id('o_orderkey')} AS id, 1 AS seq, 'earlier' || CAST(o_orderkey AS VARCHAR) || '.example.com' AS domain
  FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL
  SELECT {site_id('o_orderkey')}, 2, 'later' || CAST(o_orderkey AS VARCHAR) || '.example.com'
  FROM orders WHERE o_orderkey % 22 = 0
  UNION ALL
  SELECT {site_id(f'(o_orderkey + {_UNKNOWN})')}, 1, 'nobody' || CAST(o_orderkey AS VARCHAR) || '.example.com'
  FROM orders WHERE o_orderkey % 11 = 0)"""
ORACLE["site_update"] = with_(SITES, SUPD) + """SELECT s.id, coalesce(l.domain, s.domain) AS domain, s.user_id, s.tracking_id
FROM sites s LEFT JOIN (SELECT id, arg_max(domain, seq) AS domain FROM upd GROUP BY id) l USING (id)"""
ORACLE["site_update_outcomes"] = with_(SITES, SUPD) + f"""SELECT upd.id, seq, upd.domain,
  CASE WHEN NOT {is_uuid('upd.id')} THEN 400 WHEN s.id IS NULL THEN 404 ELSE 200 END AS status
FROM upd LEFT JOIN sites s USING (id)"""

SDEL = f"""del AS (
  SELECT {site_id('o_orderkey')} AS id, {user_id('o_custkey')} AS user_id FROM orders WHERE o_orderkey % 13 = 0
  UNION ALL
  SELECT {site_id(f'(o_orderkey + {_UNKNOWN})')}, {user_id('o_custkey')} FROM orders WHERE o_orderkey % 13 = 0)"""
ORACLE["site_delete"] = with_(SITES, SDEL) + """SELECT id, domain, user_id, tracking_id FROM sites
WHERE id NOT IN (SELECT id FROM del)"""
ORACLE["site_delete_outcomes"] = with_(SITES, SDEL) + f"""SELECT del.id, del.user_id,
  CASE WHEN NOT {is_uuid('del.id')} THEN 400 WHEN s.id IS NULL THEN 404 ELSE 200 END AS status
FROM del LEFT JOIN sites s USING (id)"""

ORACLE["site_registry_by_tracking"] = with_(SITES) + "SELECT tracking_id, id AS site_id FROM sites"
ORACLE["site_registry_by_user"] = with_(SITES) + "SELECT user_id, id AS site_id FROM sites"
ORACLE["user_registry_by_email"] = with_(USERS) + "SELECT email, id AS user_id FROM users"

ORACLE["find_site"] = with_(SITES, f"""lk AS (
  SELECT o_orderkey AS request_id,
    CASE WHEN o_orderkey % 10 = 0 THEN 'not-an-id'
         WHEN o_orderkey % 10 = 1 THEN {site_id(f'(o_orderkey + {_UNKNOWN})')}
         ELSE {site_id('o_orderkey')} END AS id
  FROM orders)""") + f"""SELECT lk.request_id, lk.id, s.domain, s.user_id, s.tracking_id,
  CASE WHEN NOT {is_uuid('lk.id')} THEN 400 WHEN s.id IS NULL THEN 404 ELSE 200 END AS status,
  CASE WHEN NOT {is_uuid('lk.id')} THEN '{BAD_UUID}' END AS message, s.created AS created_date
FROM lk LEFT JOIN sites s ON s.id = lk.id"""
ORACLE["find_user"] = with_(USERS, f"""lk AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_custkey % 10 = 0 THEN 'not-an-id'
         WHEN c_custkey % 10 = 1 THEN {user_id(f'(c_custkey + {_UNKNOWN})')}
         ELSE {user_id('c_custkey')} END AS id
  FROM customer)""") + f"""SELECT lk.request_id, lk.id, u.email, u.full_name,
  CASE WHEN NOT {is_uuid('lk.id')} THEN 400 WHEN u.id IS NULL THEN 404 ELSE 200 END AS status,
  CASE WHEN NOT {is_uuid('lk.id')} THEN '{BAD_UUID}' END AS message, u.created AS created_date
FROM lk LEFT JOIN users u ON u.id = lk.id"""
LISTED = f"""lr AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_custkey % 10 = 0 THEN 'not-an-id' ELSE {user_id('c_custkey')} END AS user_id FROM customer
  UNION ALL
  SELECT -c_custkey - 1, {user_id(f'(c_custkey + {_UNKNOWN})')} FROM customer)"""
ORACLE["list_sites_by_user"] = with_(SITES, LISTED) + """SELECT lr.request_id, lr.user_id,
  s.id AS site_id, s.created AS created_date
FROM lr JOIN sites s ON s.user_id = lr.user_id"""
ORACLE["list_sites_outcomes"] = with_(SITES, LISTED) + f"""SELECT lr.request_id, lr.user_id,
  CASE WHEN {is_uuid('lr.user_id')} THEN (SELECT count(*) FROM sites s WHERE s.user_id = lr.user_id) END AS n_sites,
  CASE WHEN {is_uuid('lr.user_id')} THEN 200 ELSE 400 END AS status,
  CASE WHEN NOT {is_uuid('lr.user_id')} THEN '{BAD_UUID}' END AS message FROM lr"""
ORACLE["site_create"] = f"""SELECT {site_id('o_orderkey')} AS id, 'site' || CAST(o_orderkey AS VARCHAR) || '.example.com' AS domain,
  {user_id('o_custkey')} AS user_id, {uuid_from_text('o_orderkey')} AS tracking_id
FROM orders WHERE o_orderkey % 10 <> 0"""
_BAD_OWNER = "o_orderkey % 10 = 0"
ORACLE["site_create_outcomes"] = f"""SELECT o_orderkey AS request_id,
  CASE WHEN {_BAD_OWNER} THEN 'not-an-id' ELSE {user_id('o_custkey')} END AS user_id,
  'site' || CAST(o_orderkey AS VARCHAR) || '.example.com' AS domain,
  CASE WHEN NOT {_BAD_OWNER} THEN {site_id('o_orderkey')} END AS id,
  CASE WHEN NOT {_BAD_OWNER} THEN {uuid_from_text('o_orderkey')} END AS tracking_id,
  CASE WHEN {_BAD_OWNER} THEN 400 ELSE 200 END AS status, CASE WHEN {_BAD_OWNER} THEN '{BAD_UUID}' END AS message,
  CASE WHEN NOT {_BAD_OWNER} THEN date_trunc('millisecond', o_orderdate) END AS created_date
FROM orders"""
ORACLE["user_registry_after_sign_up"] = with_(USERS, REQ) + f"""SELECT email, id AS user_id FROM users
UNION ALL SELECT email, {time_uuid('requested_at', 'request_id')} FROM firsts"""

# ---------------------------------------------------------------- load statistics

OUTC = """outc AS (
  SELECT ts,
    CASE WHEN event_id % 20 = 0 THEN 'dropped' WHEN event_id % 33 = 0 THEN 'failed' ELSE 'ok' END AS outcome,
    CASE WHEN event_id % 20 <> 0 AND event_id % 33 <> 0 THEN CASE WHEN event_type = 'error' THEN 500 ELSE 200 END END AS status,
    CASE WHEN event_id % 20 <> 0 THEN CAST(floor(value) AS BIGINT) END AS elapsed_ms
  FROM events),
part0 AS (
  SELECT make_timestamp((epoch_us(ts) // 5000000 + 1) * 5000000) AS window_end,
    count(*) FILTER (WHERE outcome IN ('ok', 'failed')) AS enqueued,
    count(*) FILTER (WHERE outcome = 'dropped') AS dropped,
    count(*) FILTER (WHERE outcome = 'failed') AS failed,
    count(*) FILTER (WHERE outcome = 'ok') AS responses,
    min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms,
    CAST(coalesce(sum(elapsed_ms), 0) AS BIGINT) AS sum_ms, count(elapsed_ms) AS timed
  FROM outc GROUP BY 1),
part AS (
  SELECT *, enqueued + dropped AS total,
    CAST(CASE WHEN timed > 0 THEN sum_ms // timed ELSE 0 END AS BIGINT) AS avg_ms FROM part0)"""
ORACLE["load_stats_partial"] = with_(OUTC) + "SELECT * FROM part"
ORACLE["load_stats_total"] = with_(OUTC) + """SELECT *, enqueued + dropped AS total,
  CAST(CASE WHEN timed > 0 THEN sum_ms // timed ELSE 0 END AS BIGINT) AS avg_ms FROM (
  SELECT CAST(coalesce(sum(enqueued), 0) AS BIGINT) AS enqueued, CAST(coalesce(sum(dropped), 0) AS BIGINT) AS dropped,
         CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed, CAST(coalesce(sum(responses), 0) AS BIGINT) AS responses,
         min(min_ms) AS min_ms, max(max_ms) AS max_ms, CAST(coalesce(sum(sum_ms), 0) AS BIGINT) AS sum_ms,
         CAST(coalesce(sum(timed), 0) AS BIGINT) AS timed
  FROM part)"""
ORACLE["merge_histograms"] = with_(OUTC) + """SELECT status, count(*) AS responses FROM outc
WHERE status IS NOT NULL GROUP BY status"""
