"""DuckDB twins for the ingest operators.

The expected output is computed from the adapted events and the request
rules directly (what went into each request), not by parsing the request
text, so the Spark path - JSON parse, URL parsing, rule tables, gate,
masking - is checked against an independent formulation.
"""

from __future__ import annotations

from tidemark.sources.fixtures import ADAPTER_SQL, FAULT_MOD, SITE_ROWS, UA_SAMPLES


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


SITES_VALUES = ", ".join(
    f"({_lit(sid)}, CAST({_lit(lvl)} AS VARCHAR), {allow})" for sid, _o, _n, _d, _p, allow, lvl in SITE_ROWS
)
UA_VALUES = ", ".join(
    f"({i}, " + ", ".join(f"CAST({_lit(x)} AS VARCHAR)" for x in exp) + ")" for i, (_ua, exp) in enumerate(UA_SAMPLES)
)
N_UA = len(UA_SAMPLES)

REASONS = {
    "missing": "'Bad Request: Missing site parameter'",
    "unknown": "'Forbidden: Invalid site identifier'",
    "badref": "'Bad Request: Malformed referer header'",
    "notallowed": "'Forbidden: Invalid referer'",
    "allowance": "'Payment Required: Request allowance likely exceeded.'",
    "nobody": "'Missing event body'",
    "badjson": "'Invalid JSON format'",
    "ok": "'Event accepted'",
}

ING_CTES = f"""{ADAPTER_SQL},
ing_sites(site_id, lvl, allowance) AS (VALUES {SITES_VALUES}),
ing_ua(idx, u_browser, u_browser_version, u_os, u_os_version, u_device, u_model, u_manufacturer) AS (VALUES {UA_VALUES}),
ing_r AS (SELECT f.*, 'r' || CAST(f.event_id AS VARCHAR) AS request_id, f."timestamp" AS received_at,
    f.event_id % {FAULT_MOD} AS fault, p.url AS page_url,
    CASE WHEN f.event_id % {FAULT_MOD} = 7 THEN NULL WHEN f.event_id % {FAULT_MOD} = 13 THEN 'site-unknown'
         ELSE f.site_id END AS site
  FROM fx_all f LEFT JOIN pages p ON p.page_id = f.event_id),
ing_pre AS (SELECT r.*, s.lvl, s.allowance,
    CASE WHEN fault = 7 THEN 400 WHEN fault = 13 THEN 403 WHEN fault = 19 THEN 400 WHEN fault = 17 THEN 403 END AS pre_status,
    CASE WHEN fault = 7 THEN {REASONS['missing']} WHEN fault = 13 THEN {REASONS['unknown']}
         WHEN fault = 19 THEN {REASONS['badref']} WHEN fault = 17 THEN {REASONS['notallowed']} END AS pre_reason
  FROM ing_r r LEFT JOIN ing_sites s ON s.site_id = r.site),
ing_rank AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site, pre_status IS NULL ORDER BY received_at, request_id) AS rk
  FROM ing_pre),
ing_chk AS (SELECT *,
    CASE WHEN pre_status IS NOT NULL THEN pre_status WHEN rk > allowance THEN 402
         WHEN fault = 23 THEN 400 WHEN fault = 29 THEN 400 ELSE 202 END AS status,
    CASE WHEN pre_status IS NOT NULL THEN pre_reason WHEN rk > allowance THEN {REASONS['allowance']}
         WHEN fault = 23 THEN {REASONS['nobody']} WHEN fault = 29 THEN {REASONS['badjson']} ELSE {REASONS['ok']} END AS reason,
    (pre_status IS NULL AND rk <= allowance) AS uses_allowance
  FROM ing_rank),
ing_acc AS (SELECT * FROM ing_chk WHERE status = 202),
ing_raw AS (SELECT a.*,
    CASE WHEN page_url IS NOT NULL THEN page_url
         WHEN referer_domain IS NULL OR referer_domain = '$direct' THEN '$direct'
         ELSE 'https://' || referer_domain || '/from?q=1#frag' END AS raw_ref
  FROM ing_acc a WHERE is_initial),
ing_enr AS (SELECT r.*,
    CASE WHEN region = 'Utah' THEN 'Lehi' END AS e_city,
    region AS e_region, country AS e_country,
    CASE WHEN country = 'France' THEN 'Europe/Paris' END AS e_timezone,
    u.*,
    CASE WHEN raw_ref = '$direct' THEN '$direct'
         ELSE lower(regexp_extract(raw_ref, '^[A-Za-z]+://([^/?#:]+)', 1)) END AS e_referer_domain,
    CASE WHEN raw_ref = '$direct' THEN '$direct'
         WHEN lvl = 'no' THEN raw_ref
         ELSE lower(regexp_extract(raw_ref, '^([A-Za-z]+)://', 1)) || '://'
              || lower(regexp_extract(raw_ref, '^[A-Za-z]+://([^/?#:]+)', 1))
              || COALESCE(NULLIF(regexp_extract(raw_ref, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/') END AS e_referer,
    utm_source AS e_utm_source, utm_medium AS e_utm_medium,
    COALESCE(utm_campaign, 'fall sale') AS e_utm_campaign,
    CAST(NULL AS VARCHAR) AS e_utm_content,
    CASE WHEN utm_campaign IS NULL THEN 'x y' END AS e_utm_term,
    CAST(CAST(screen_width AS INT) AS VARCHAR) AS e_screen_width,
    CAST(CAST(screen_height AS INT) AS VARCHAR) AS e_screen_height
  FROM ing_raw r LEFT JOIN ing_ua u ON u.idx = r.event_id % {N_UA}),
ing_initial AS (SELECT request_id, site_id, dt, event, pathname, session_id,
    strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
    CASE WHEN COALESCE(lvl, 'maybe') <> 'yes'
         THEN '{{"k":"' || json_extract_string(properties, '$.k') || '"}}' END AS properties,
    CAST(NULL AS VARCHAR) AS distinct_id,
    CASE WHEN lvl = 'no' THEN u_model END AS model,
    CASE WHEN lvl = 'no' THEN u_manufacturer END AS manufacturer,
    CASE WHEN COALESCE(lvl, 'maybe') <> 'yes' THEN e_city END AS city,
    CASE WHEN COALESCE(lvl, 'maybe') <> 'yes' THEN e_timezone END AS timezone,
    CASE WHEN COALESCE(lvl, 'maybe') <> 'yes' THEN u_browser_version END AS browser_version,
    CASE WHEN COALESCE(lvl, 'maybe') <> 'yes' THEN u_os_version END AS os_version,
    CASE WHEN COALESCE(lvl, 'maybe') <> 'yes' THEN e_screen_height END AS screen_height,
    CASE WHEN COALESCE(lvl, 'maybe') <> 'yes' THEN e_screen_width END AS screen_width,
    e_region AS region, e_country AS country, u_device AS device, u_browser AS browser, u_os AS os,
    e_referer AS referer, e_referer_domain AS referer_domain,
    e_utm_source AS utm_source, e_utm_campaign AS utm_campaign, e_utm_medium AS utm_medium,
    e_utm_content AS utm_content, e_utm_term AS utm_term
  FROM ing_enr),
ing_regular AS (SELECT request_id, site_id, dt, event, pathname, session_id,
    strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
    CASE WHEN COALESCE(lvl, 'maybe') <> 'yes'
         THEN '{{"k":"' || json_extract_string(properties, '$.k') || '"}}' END AS properties
  FROM ing_acc WHERE NOT is_initial)"""


def ing(body: str) -> str:
    return f"WITH {ING_CTES}\n{body}"


INITIAL_COLS = ["request_id", "site_id", "dt", "event", "pathname", "session_id", "timestamp", "properties",
                "distinct_id", "model", "manufacturer", "city", "timezone", "browser_version", "os_version",
                "screen_height", "screen_width", "region", "country", "device", "browser", "os", "referer",
                "referer_domain", "utm_source", "utm_campaign", "utm_medium", "utm_content", "utm_term"]
REGULAR_COLS = ["request_id", "site_id", "dt", "event", "pathname", "session_id", "timestamp", "properties"]
