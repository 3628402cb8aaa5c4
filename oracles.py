"""DuckDB twins of the registered queries (the correctness oracle).

Each text runs on the pre-registered parquet views (``events`` etc.).  The shared CTEs rebuild the
fixture adapter and the analytics view from the operator descriptions: a session's first row is found
by ``DISTINCT ON`` and joined back, channels come from a rule table, segments are grouped flags, totals
are window sums, and the page flow is cut from one ordered list per session.
"""

from __future__ import annotations

from tidemark.operators.flow import CLICK_MARK, PAGE_MARK
from tidemark.operators.model import EMAIL_DOMAINS, SEARCH_DOMAINS, SOCIAL_DOMAINS
from tidemark.sources.fixtures import ADAPTER_SQL

SAFE_INITIAL_ONLY = [
    "city", "timezone", "browser_version", "os_version", "screen_height", "screen_width",
    "region", "country", "device", "browser", "os", "referer", "referer_domain",
    "utm_source", "utm_campaign", "utm_medium", "utm_content", "utm_term",
]
FIXTURE_SET = {"referer_domain", "utm_medium", "utm_source", "utm_campaign", "country", "region",
               "browser", "os", "screen_width", "screen_height"}
COMMON = ["site_id", "dt", "event", "pathname", "session_id", "timestamp", "properties"]
EVENT_COLS = ["event", "pathname", "timestamp", "properties"]
STATIC = ["site_id", "dt", "session_id"] + SAFE_INITIAL_ONLY


def _q(c: str) -> str:
    return f'"{c}"'


def _initial_select() -> str:
    cols = []
    for c in COMMON:
        cols.append(_q(c))
    for c in SAFE_INITIAL_ONLY:
        if c == "referer_domain":
            cols.append("CASE WHEN regexp_replace(utm_source, '^\\s+|\\s+$', '', 'g') <> '' "
                        "THEN utm_source ELSE referer_domain END AS referer_domain")
        elif c in FIXTURE_SET:
            cols.append(_q(c))
        else:
            cols.append(f"CAST(NULL AS VARCHAR) AS {_q(c)}")
    return ", ".join(cols + ["event_id"])


def _events_select() -> str:
    cols = [_q(c) for c in COMMON] + [f"CAST(NULL AS VARCHAR) AS {_q(c)}" for c in SAFE_INITIAL_ONLY]
    return ", ".join(cols + ["event_id"])


def _channel_rules() -> str:
    """Rows (field, value, rank, channel); the rule of least rank wins."""
    rules = [("medium", m, 1, "Paid Search") for m in ("cpc", "ppc")]
    rules += [("medium", "email", 2, "Email"), ("medium", "social", 3, "Social")]
    for rank, channel, domains in ((2, "Email", EMAIL_DOMAINS), (3, "Social", SOCIAL_DOMAINS),
                                   (4, "Organic Search", SEARCH_DOMAINS), (5, "Direct", ["$direct"])):
        rules += [("domain", d, rank, channel) for d in domains]
    return ",\n  ".join(f"('{f}', '{v}', {r}, '{c}')" for f, v, r, c in rules)


_STATIC_SQL = ", ".join(_q(c) for c in STATIC)
_EVENT_SQL = ", ".join("base." + _q(c) for c in EVENT_COLS + ["event_id"])
_FILLED_SQL = ", ".join("v." + _q(c) for c in STATIC + ["channel", "source"])

# CTE chain ending in ``analytics`` (the filled view, plus event_id).  A visit is a session's first row; no
# session id counts as one session, so the join back is null-safe.
VIEW_CTES = f"""{ADAPTER_SQL},
initial_t AS (SELECT {_initial_select()} FROM fx_all WHERE is_initial),
events_t AS (SELECT {_events_select()} FROM fx_all WHERE NOT is_initial),
base AS (SELECT * FROM initial_t UNION ALL SELECT * FROM events_t),
channel_rules(field, value, rank, channel) AS (VALUES
  {_channel_rules()}),
first_rows AS (SELECT DISTINCT ON (session_id) {_STATIC_SQL} FROM base ORDER BY session_id, "timestamp", event_id),
visits AS (
  SELECT f.*, COALESCE(CASE WHEN d.rank < m.rank THEN d.channel ELSE m.channel END, d.channel, 'Referral') AS channel,
         regexp_replace(lower(trim(COALESCE(f.referer_domain, '$direct'))), '^www\\.', '') AS source
  FROM first_rows f
  LEFT JOIN channel_rules m ON m.field = 'medium' AND m.value = f.utm_medium
  LEFT JOIN channel_rules d ON d.field = 'domain' AND d.value = lower(COALESCE(f.referer_domain, '$direct'))),
analytics AS (SELECT {_EVENT_SQL}, {_FILLED_SQL} FROM base JOIN visits v ON v.session_id IS NOT DISTINCT FROM base.session_id)"""


def with_view(body: str, segments_having: str = "", extra_ctes: str = "") -> str:
    """Wrap a query on ``a``: the analytics view, narrowed to the sessions whose flags (:func:`seg_where`) are all set."""
    narrowed = "a AS (SELECT * FROM analytics)"
    if segments_having:
        narrowed = (f"segmented AS (SELECT session_id FROM analytics GROUP BY session_id HAVING {segments_having}),\n"
                    "a AS (SELECT * FROM analytics SEMI JOIN segmented USING (session_id))")
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {VIEW_CTES},\n{narrowed}{extra}\n{body}"


def seg_where(conds: list[str]) -> str:
    """One grouped flag per condition: some row of the session meets it."""
    return " AND ".join(f"bool_or({c})" for c in conds)


RANKED = "ORDER BY value DESC, name ASC NULLS FIRST LIMIT 100"
SCREEN = "COALESCE(screen_width::VARCHAR || 'x' || screen_height::VARCHAR, 'Unknown')"


def top_rows(name: str, where: str = "true") -> str:
    """Rows per name."""
    return f"SELECT {name} AS name, COUNT(*) AS value FROM a WHERE {where} GROUP BY ALL {RANKED}"


def top_sessions(name: str, where: str = "true") -> str:
    """Sessions per name: each (name, session) once, then counted."""
    return f"""SELECT name, COUNT(session_id) AS value FROM (SELECT DISTINCT {name} AS name, session_id FROM a WHERE {where}) p
GROUP BY name HAVING COUNT(session_id) > 0 {RANKED}"""


def share(name_expr: str, hide: str | None = None) -> str:
    """Sessions per name and their percentage of all sessions, hidden name included in the total."""
    hidden = f"WHERE name <> '{hide}' " if hide else ""
    return f"""SELECT * FROM (
  SELECT name, COUNT(*) AS value, (COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER ()) * 100 AS percentage
  FROM (SELECT DISTINCT session_id, {name_expr} AS name FROM a) s GROUP BY name) c
{hidden}{RANKED}"""


def page_rank(direction: str) -> str:
    """Sessions per first (``ASC``) or last (``DESC``) named page, taken from each session's ordered page list."""
    at = {"ASC": 1, "DESC": -1}[direction]
    return f"""SELECT pages[{at}] AS name, COUNT(*) AS value
FROM (SELECT list(pathname ORDER BY "timestamp", event_id) AS pages FROM a
      WHERE event = 'page_view' AND trim(pathname) <> '' GROUP BY session_id) s
GROUP BY ALL {RANKED}"""


EVENTS_REPORT = f"""SELECT name, COUNT(session_id) AS value, SUM(n)::BIGINT AS events,
  COALESCE(COUNT(session_id)::DOUBLE / NULLIF((SELECT COUNT(DISTINCT session_id) FROM a), 0), 0) * 100 AS percentage
FROM (SELECT COALESCE(event, 'Unknown') AS name, session_id, COUNT(*) AS n FROM a GROUP BY ALL) p
GROUP BY name HAVING COUNT(session_id) > 0 {RANKED}"""


def property_values_ctes(key: str) -> str:
    """Rows per (property value, session)."""
    return f"""pv AS (SELECT name, session_id, COUNT(*) AS n
  FROM (SELECT session_id, CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.{key}') END AS name FROM a) x
  WHERE name IS NOT NULL GROUP BY ALL)"""


PROPERTY_VALUES = f"""SELECT name, value, events, COALESCE(value::DOUBLE / NULLIF(SUM(value) OVER (), 0), 0) * 100 AS percentage
FROM (SELECT name, COUNT(session_id) AS value, SUM(n)::BIGINT AS events FROM pv GROUP BY name) g
QUALIFY value > 0 {RANKED}"""


STATS = """SELECT visits AS total_visits, total_pageviews, visits AS unique_visitors, bounced_sessions,
  COALESCE(median_us / 1000000.0, 0)::DOUBLE AS median_duration_seconds,
  COALESCE(bounced_sessions::DOUBLE / NULLIF(visits, 0), 0) * 100.0 AS bounce_rate,
  total_pageviews::DOUBLE / NULLIF(visits, 0) AS views_per_visit
FROM (SELECT COUNT(session_id) AS visits, COALESCE(SUM(views), 0)::BIGINT AS total_pageviews,
             COUNT(session_id) FILTER (views = 1) AS bounced_sessions, MEDIAN(us) FILTER (n > 1)::DOUBLE AS median_us
      FROM (SELECT session_id, COUNT(*) AS n, SUM((event IS NOT DISTINCT FROM 'page_view')::BIGINT) AS views,
                   epoch_us(MAX("timestamp")) - epoch_us(MIN("timestamp")) AS us
            FROM a GROUP BY session_id) per_session) totals"""


# A session's rows as one ordered list; a step is a row whose label differs from the one before it.
FLOW_CTES = f"""fl_raw AS (SELECT session_id, "timestamp", event_id,
    IF(event = 'page_view', '{PAGE_MARK}' || COALESCE(pathname, '[unknown]'), '{CLICK_MARK}' || event) AS base_node FROM a),
fl_lists AS (SELECT session_id, list(struct_pack(e := event_id, b := base_node) ORDER BY "timestamp", event_id) AS rows_
    FROM fl_raw GROUP BY session_id),
fl_kept AS (SELECT session_id, list_filter(rows_, lambda x, i: i = 1 OR rows_[i - 1].b IS NULL OR x.b <> rows_[i - 1].b) AS kept
    FROM fl_lists),
fl_steps AS (SELECT session_id, kept[step_idx].e AS event_id, kept[step_idx].b AS base_node, step_idx
    FROM (SELECT session_id, kept, unnest(range(1, len(kept) + 1)) AS step_idx FROM fl_kept) u),
fl_nodes AS (SELECT session_id, event_id, concat(base_node, ' #', step_idx) AS node_id, step_idx FROM fl_steps),
fl_pairs AS (SELECT n.session_id, n.event_id, n.node_id AS source_node, t.node_id AS target_node
    FROM fl_nodes n LEFT JOIN fl_nodes t ON t.session_id IS NOT DISTINCT FROM n.session_id AND t.step_idx = n.step_idx + 1),
fl_counts AS (SELECT source_node, target_node, COUNT(*) AS value FROM fl_pairs WHERE target_node IS NOT NULL GROUP BY ALL),
fl_links AS (FROM fl_counts ORDER BY value DESC, source_node, target_node LIMIT 200),
fl_shown AS (SELECT source_node AS source, target_node AS target, value FROM fl_links
    WHERE value >= 3 AND source_node <> target_node ORDER BY value DESC, source, target LIMIT 75)"""
