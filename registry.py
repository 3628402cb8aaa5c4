"""Registered queries (Spark) and their DuckDB twins, keyed by operator name.

callable ``(spark, sf_dir) -> DataFrame``; ``sql=None`` means the check is
rows-only (no SQL twin) and the operator has its own golden test instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hashlib
import re
from pathlib import Path

import oracles as O
from tidemark.operators import model, reports, stats
from tidemark.plans.jobs import publish_once
from tidemark.plans.rollups import SessionRollups
from tidemark.session import scratch_path
from tidemark.sources import fixtures
from tidemark.sources import lake as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def reg(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SQL = "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f')"


def ts_text(c: str = "timestamp") -> F.Column:
    return F.date_format(F.col(c), TS_FMT)


def _stamp(sf: str) -> str:
    """Names a derived table's folder: a hash of the library's code and of where its input lies, so a table never
    outlives the code that made it."""
    here = Path(__file__).resolve().parent
    files = [here / "registry.py", *sorted(p for p in (here / "tidemark").rglob("*.py") if "llm" not in p.parts)]
    code = hashlib.sha1(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    return f"{code}-" + re.sub(r"[^A-Za-z0-9.]+", "_", sf.strip("/"))


def adapted(spark: SparkSession, sf: str):
    """The two event tables derived from the supplied ``events`` (report-layer
    form), stored once as Parquet in the shared checkpoint folder and read
    back whole - as the product reads its lake."""
    root = scratch_path(spark, "adapted", _stamp(sf))

    # first events are looked for once; the flag parts the rows into both tables as they are written
    flagged = fixtures.adapt_flagged(fixtures.raw_events(spark, sf))
    publish_once(spark, root, lambda tmp: flagged.write.partitionBy("is_initial").parquet(tmp))
    return fixtures.split_flagged(spark.read.schema(flagged.schema).parquet(root))


def analytics(spark: SparkSession, sf: str) -> model.Analytics:
    ini, ev = adapted(spark, sf)
    return model.build(ini, ev, seq_col=fixtures.SEQ)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return reports.channels(analytics(spark, sf))


# ---------------------------------------------------------------- session model
VIEW_OUT = ["event", "pathname", "properties", "site_id", "dt", "session_id", "city", "timezone",
            "browser_version", "os_version", "screen_height", "screen_width", "region", "country", "device",
            "browser", "os", "referer", "referer_domain", "utm_source", "utm_campaign", "utm_medium",
            "utm_content", "utm_term", "channel", "source", "event_id"]


def _view_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[ts_text().alias("timestamp") if c == "timestamp" else F.col(c) for c in cols])


def _view_sql(cols: list[str], src: str = "a") -> str:
    return "SELECT " + ", ".join(f"{TS_SQL} AS \"timestamp\"" if c == "timestamp" else f'"{c}"' for c in cols) + f" FROM {src}"


@reg("mdl_utm_override", O.with_view(
    "SELECT session_id, event_id, referer_domain, utm_source FROM initial_t"))
def q_mdl_utm_override(spark, sf):
    ini, _ = adapted(spark, sf)
    return model.override_referer(ini).select("session_id", "event_id", "referer_domain", "utm_source")


UNION_COLS = ["session_id", "event_id", "event", "pathname", "timestamp", "country", "referer_domain", "utm_medium"]


@reg("mdl_union", O.with_view(_view_sql(UNION_COLS, "base")))
def q_mdl_union(spark, sf):
    ini, ev = adapted(spark, sf)
    return _view_rows(model.union_events(model.override_referer(ini), ev), UNION_COLS)


FILL_COLS = ["session_id", "event_id", "timestamp", "site_id", "dt", "country", "region", "browser", "os",
             "screen_width", "screen_height", "referer_domain", "utm_source", "utm_campaign", "utm_medium"]


@reg("mdl_session_fill", O.with_view(_view_sql(FILL_COLS)))
def q_mdl_session_fill(spark, sf):
    ini, ev = adapted(spark, sf)
    u = model.union_events(model.override_referer(ini), ev)
    return _view_rows(model.fill_session(u, "first_row", fixtures.SEQ), FILL_COLS)


_FWD = ("OVER (PARTITION BY session_id ORDER BY \"timestamp\", event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@reg("mdl_forward_fill", O.with_view(
    "SELECT " + ", ".join(
        (f"{TS_SQL} AS \"timestamp\"" if c == "timestamp" else
         f'"{c}"' if c in ("session_id", "event_id") else f'LAST_VALUE("{c}" IGNORE NULLS) {_FWD} AS "{c}"')
        for c in FILL_COLS) + " FROM base"))
def q_mdl_forward_fill(spark, sf):
    ini, ev = adapted(spark, sf)
    u = model.union_events(model.override_referer(ini), ev)
    return _view_rows(model.fill_session(u, "forward", fixtures.SEQ), FILL_COLS)


@reg("mdl_channel", O.with_view("SELECT session_id, event_id, channel FROM a"))
def q_mdl_channel(spark, sf):
    return analytics(spark, sf).rows.select("session_id", "event_id", "channel")


@reg("mdl_source", O.with_view("SELECT session_id, event_id, source FROM a"))
def q_mdl_source(spark, sf):
    return analytics(spark, sf).rows.select("session_id", "event_id", "source")


@reg("mdl_analytics_view", O.with_view(_view_sql(["timestamp"] + VIEW_OUT)))
def q_mdl_analytics_view(spark, sf):
    return _view_rows(analytics(spark, sf).rows, ["timestamp"] + VIEW_OUT)


# ---------------------------------------------------------------- headline numbers
@reg("agg_session_pageviews", O.with_view(
    "SELECT session_id, COUNT(*) FILTER (WHERE event = 'page_view') AS page_view_count FROM a GROUP BY session_id"))
def q_agg_session_pageviews(spark, sf):
    return stats.session_facts(analytics(spark, sf)).select("session_id", "page_view_count")


@reg("agg_session_duration", O.with_view(
    "SELECT session_id, (epoch_us(MAX(\"timestamp\")) - epoch_us(MIN(\"timestamp\"))) / 1000.0 AS duration_ms "
    "FROM a GROUP BY session_id HAVING COUNT(*) > 1"))
def q_agg_session_duration(spark, sf):
    f = stats.session_facts(analytics(spark, sf))
    return f.filter(F.col("duration_ms").isNotNull()).select("session_id", "duration_ms")


@reg("agg_bounced", O.with_view(
    "SELECT COUNT(session_id) AS bounced_sessions FROM (SELECT session_id, COUNT(*) FILTER (WHERE event = 'page_view') "
    "AS pv FROM a GROUP BY session_id) s WHERE pv = 1"))
def q_agg_bounced(spark, sf):
    return stats.stats(analytics(spark, sf)).select("bounced_sessions")


@reg("agg_unique_visitors", O.with_view("SELECT COUNT(DISTINCT session_id) AS unique_visitors FROM a"))
def q_agg_unique_visitors(spark, sf):
    return stats.stats(analytics(spark, sf)).select("unique_visitors")


@reg("agg_total_pageviews", O.with_view(
    "SELECT CAST(COUNT(*) FILTER (WHERE event = 'page_view') AS BIGINT) AS total_pageviews FROM a"))
def q_agg_total_pageviews(spark, sf):
    return stats.stats(analytics(spark, sf)).select("total_pageviews")


@reg("agg_median_duration", O.with_view(
    "SELECT COALESCE(MEDIAN(d)::DOUBLE / 1000000.0, 0)::DOUBLE AS median_duration_seconds FROM ("
    "SELECT epoch_us(MAX(\"timestamp\")) - epoch_us(MIN(\"timestamp\")) AS d FROM a "
    "GROUP BY session_id HAVING COUNT(*) > 1) x"))
def q_agg_median_duration(spark, sf):
    return stats.stats(analytics(spark, sf)).select("median_duration_seconds")


@reg("agg_bounce_rate", O.with_view(
    "SELECT bounce_rate FROM (" + O.STATS + ") s"))
def q_agg_bounce_rate(spark, sf):
    return stats.stats(analytics(spark, sf)).select("bounce_rate")


@reg("agg_stats", O.with_view(O.STATS))
def q_agg_stats(spark, sf):
    return stats.stats(analytics(spark, sf))


def rollups(spark, sf):
    """Rollups of the adapted tables, in three batches that cut sessions apart, the first one run twice."""
    root = scratch_path(spark, "rollups", _stamp(sf))
    ini, ev = adapted(spark, sf)

    def part(k):
        return model.build(*[t.where(F.pmod(F.xxhash64(fixtures.SEQ), F.lit(3)) == k) for t in (ini, ev)], seq_col=fixtures.SEQ)

    def write(tmp):
        for k in (0, 1, 2, 0):
            SessionRollups(spark, tmp, part(k)).add(part(k), k)

    return SessionRollups(spark, publish_once(spark, root, write), model.build(ini, ev, seq_col=fixtures.SEQ))


@reg("agg_stats_rollup", O.with_view(O.STATS))
def q_agg_stats_rollup(spark, sf):
    return stats.stats(rollups(spark, sf).analytics())


@reg("agg_timeseries_rollup", O.with_view(
    "SELECT strftime(\"timestamp\", '%Y-%m-%d %H:00') AS date, COUNT(*) AS views FROM a WHERE event = 'page_view' "
    "GROUP BY 1 ORDER BY 1"))
def q_agg_timeseries_rollup(spark, sf):
    return rollups(spark, sf).timeseries("yyyy-MM-dd HH:00")


@reg("agg_views_per_visit", O.with_view(
    "SELECT views_per_visit FROM (" + O.STATS + ") s"))
def q_agg_views_per_visit(spark, sf):
    return stats.stats(analytics(spark, sf)).select("views_per_visit")


def _duration_text_sql(x: str) -> str:
    whole = f"CAST(floor({x}) AS BIGINT)"
    text = f"concat(CASE WHEN {whole} >= 60 THEN concat({whole} // 60, 'm ') END, {whole} % 60, 's')"
    return f"CASE WHEN {x} >= 0 THEN {text} ELSE 'N/A' END"


@reg("agg_format_duration", O.with_view(
    "SELECT session_id, " + _duration_text_sql("d") + " AS visit_duration FROM ("
    "SELECT session_id, (epoch_us(MAX(\"timestamp\")) - epoch_us(MIN(\"timestamp\"))) / 1000000.0 AS d "
    "FROM a GROUP BY session_id HAVING COUNT(*) > 1) x"))
def q_agg_format_duration(spark, sf):
    from tidemark.functions.text import format_duration
    f = stats.session_facts(analytics(spark, sf)).filter(F.col("duration_ms").isNotNull())
    return f.select("session_id", format_duration(F.col("duration_ms") / F.lit(1000.0)).alias("visit_duration"))


@reg("agg_bounce_text", O.with_view(
    "SELECT printf('%.1f%%', bounce_rate) AS bounce_rate FROM (" + O.STATS + ") s"))
def q_agg_bounce_text(spark, sf):
    return stats.stats_display(stats.stats(analytics(spark, sf))).select("bounce_rate")


@reg("agg_timeseries", O.with_view(
    "SELECT strftime(\"timestamp\", '%Y-%m-%d') AS date, COUNT(*) AS views FROM a WHERE event = 'page_view' "
    "GROUP BY 1 ORDER BY 1"))
def q_agg_timeseries(spark, sf):
    return stats.timeseries(analytics(spark, sf))


@reg("agg_timeseries_hourly", O.with_view(
    "SELECT strftime(\"timestamp\", '%Y-%m-%d %H:00') AS date, COUNT(*) AS views FROM a WHERE event = 'page_view' "
    "GROUP BY 1 ORDER BY 1"))
def q_agg_timeseries_hourly(spark, sf):
    return stats.timeseries(analytics(spark, sf), fmt="yyyy-MM-dd HH:00")


@reg("agg_property_keys", O.with_view(
    "SELECT DISTINCT unnest(json_keys(json(properties))) AS key FROM analytics WHERE json_valid(properties) ORDER BY key"))
def q_agg_property_keys(spark, sf):
    return stats.property_keys(analytics(spark, sf))


# ---------------------------------------------------------------- ranked breakdowns
@reg("rpt_simple", O.with_view(O.top_rows("dt", "event = 'click'")))
def q_rpt_simple(spark, sf):
    a = analytics(spark, sf)
    return reports.simple_report(a.rows, F.col("dt"), F.count(F.lit(1)), F.col("event") == "click")


@reg("rpt_channels", O.with_view(O.top_sessions("channel")))
def q_rpt_channels(spark, sf):
    return reports.channels(analytics(spark, sf))


@reg("rpt_sources", O.with_view(O.top_sessions("source")))
def q_rpt_sources(spark, sf):
    return reports.sources(analytics(spark, sf))


@reg("rpt_campaigns", O.with_view(O.top_sessions("COALESCE(utm_campaign, '(not set)')",
                                        "utm_campaign IS NOT NULL")))
def q_rpt_campaigns(spark, sf):
    return reports.campaigns(analytics(spark, sf))


@reg("rpt_top_pages", O.with_view(O.top_rows("pathname",
                                        "event = 'page_view' AND pathname IS NOT NULL AND trim(pathname) <> ''")))
def q_rpt_top_pages(spark, sf):
    return reports.top_pages(analytics(spark, sf))


@reg("rpt_entry_pages", O.with_view(O.page_rank("ASC")))
def q_rpt_entry_pages(spark, sf):
    return reports.entry_pages(analytics(spark, sf))


@reg("rpt_exit_pages", O.with_view(O.page_rank("DESC")))
def q_rpt_exit_pages(spark, sf):
    return reports.exit_pages(analytics(spark, sf))


@reg("rpt_countries", O.with_view(O.top_sessions("COALESCE(country, 'Unknown')")))
def q_rpt_countries(spark, sf):
    return reports.countries(analytics(spark, sf))


@reg("rpt_regions", O.with_view(O.top_sessions("COALESCE(region, 'Unknown')",
                                      "region IS NOT NULL AND region <> 'Unknown'")))
def q_rpt_regions(spark, sf):
    return reports.regions(analytics(spark, sf))


@reg("rpt_browsers", O.with_view(O.share("COALESCE(browser, 'Unknown')")))
def q_rpt_browsers(spark, sf):
    return reports.browsers(analytics(spark, sf))


@reg("rpt_os", O.with_view(O.share("COALESCE(os, 'Unknown')")))
def q_rpt_os(spark, sf):
    return reports.operating_systems(analytics(spark, sf))


@reg("rpt_screen_sizes", O.with_view(O.share(O.SCREEN, hide="Unknown")))
def q_rpt_screen_sizes(spark, sf):
    return reports.screen_sizes(analytics(spark, sf))


@reg("rpt_events", O.with_view(O.EVENTS_REPORT))
def q_rpt_events(spark, sf):
    return reports.events_report(analytics(spark, sf))


@reg("rpt_property_values", O.with_view(O.PROPERTY_VALUES, extra_ctes=O.property_values_ctes("k")))
def q_rpt_property_values(spark, sf):
    return reports.property_values(analytics(spark, sf), "k")


LONG_SQL_PARTS = [
    ("channels", O.top_sessions("channel")),
    ("sources", O.top_sessions("source")),
    ("campaigns", O.top_sessions("COALESCE(utm_campaign, '(not set)')", "utm_campaign IS NOT NULL")),
    ("topPages", O.top_rows("pathname", "event = 'page_view' AND pathname IS NOT NULL AND trim(pathname) <> ''")),
    ("entryPages", O.page_rank("ASC")),
    ("exitPages", O.page_rank("DESC")),
    ("countries", O.top_sessions("COALESCE(country, 'Unknown')")),
    ("regions", O.top_sessions("COALESCE(region, 'Unknown')", "region IS NOT NULL AND region <> 'Unknown'")),
    ("browsers", O.share("COALESCE(browser, 'Unknown')")),
    ("os", O.share("COALESCE(os, 'Unknown')")),
    ("screenSizes", O.share(O.SCREEN, "Unknown")),
    ("events", O.EVENTS_REPORT),
]


def _long_sql() -> str:
    parts = []
    for t, body in LONG_SQL_PARTS:
        cols = "name, value, NULL::BIGINT AS events, NULL::DOUBLE AS percentage"
        if t in ("browsers", "os", "screenSizes"):
            cols = "name, value, NULL::BIGINT AS events, percentage"
        if t == "events":
            cols = "name, value, events, percentage"
        parts.append(f"SELECT '{t}' AS type, {cols} FROM ({body}) p_{t}")
    return "\nUNION ALL\n".join(parts)


@reg("rpt_long", O.with_view(_long_sql()))
def q_rpt_long(spark, sf):
    return reports.long_report(analytics(spark, sf))


# ---------------------------------------------------------------- segments
from tidemark.operators import flow  # noqa: E402
from tidemark.operators.segments import Segment, apply_segments  # noqa: E402


def _seg_rows(spark, sf, segs):
    a = apply_segments(analytics(spark, sf), segs)
    return a.rows.select("session_id", "event_id", "event", "pathname", "channel", "country")


def _seg_sql(conds):
    return O.with_view("SELECT session_id, event_id, event, pathname, channel, country FROM a", O.seg_where(conds))


SEGMENT_CASES = {
    "seg_apply": ([Segment("channel", "Social"), Segment("pathname", "/p/3")],
                  ["channel = 'Social'", "\"pathname\" = '/p/3'"]),
    "seg_none": ([], []),
    "seg_column": ([Segment("country", "France"), Segment("event", "purchase")],
                   ["\"country\" = 'France'", "\"event\" = 'purchase'"]),
    "seg_db_override": ([Segment("page", "ignored", db_column="pathname", db_value="/p/1")],
                        ["pathname = '/p/1'"]),
    "seg_custom": ([Segment("custom:k", "69")], ["json_extract_string(properties, '$.k') = '69'"]),
    "seg_screen_size": ([Segment("screen_size", "1920x1080")],
                        ["screen_width::VARCHAR = '1920' AND screen_height::VARCHAR = '1080'"]),
    "seg_channel": ([Segment("channel", "Email")], ["channel = 'Email'"]),
    "seg_referer_domain": ([Segment("referer_domain", "google.com")],
                           ["referer_domain IN ('google.com', 'www.google.com')"]),
    "seg_referer_direct": ([Segment("referer_domain", "$direct")],
                           ["referer_domain IS NULL OR referer_domain = '$direct'"]),
    "seg_source": ([Segment("source", "news.example")], ["source = 'news.example'"]),
}

for _name, (_segs, _conds) in SEGMENT_CASES.items():
    reg(_name, _seg_sql(_conds))(lambda spark, sf, _s=_segs: _seg_rows(spark, sf, _s))

SEG2 = [Segment("channel", "Social"), Segment("pathname", "/p/3")]
SEG2_SQL = O.seg_where(["channel = 'Social'", "\"pathname\" = '/p/3'"])


@reg("rpt_channels_segmented", O.with_view(O.top_sessions("channel"),
                                           O.seg_where(["\"event\" = 'purchase'"])))
def q_rpt_channels_segmented(spark, sf):
    return reports.channels(apply_segments(analytics(spark, sf), [Segment("event", "purchase")]))


@reg("agg_stats_segmented", O.with_view(O.STATS, SEG2_SQL))
def q_agg_stats_segmented(spark, sf):
    return stats.stats(apply_segments(analytics(spark, sf), SEG2))


@reg("rpt_events_segmented", O.with_view(O.EVENTS_REPORT, O.seg_where(["country = 'France'"])))
def q_rpt_events_segmented(spark, sf):
    return reports.events_report(apply_segments(analytics(spark, sf), [Segment("country", "France")]))


# ---------------------------------------------------------------- page flow
def _steps(spark, sf, segs=()):
    a = apply_segments(analytics(spark, sf), list(segs))
    return flow.steps(a.event_rows(), a.seq_col, a.hot)


@reg("flow_sessions", O.with_view("SELECT session_id, event_id FROM a", O.seg_where(["channel = 'Social'"])))
def q_flow_sessions(spark, sf):
    a = apply_segments(analytics(spark, sf), [Segment("channel", "Social")])
    return a.event_rows().select("session_id", "event_id")


@reg("flow_node_label", O.with_view("SELECT session_id, event_id, base_node FROM fl_raw", extra_ctes=O.FLOW_CTES))
def q_flow_node_label(spark, sf):
    return analytics(spark, sf).base.select("session_id", "event_id", flow.node_label().alias("base_node"))


@reg("flow_dedupe", O.with_view("SELECT session_id, event_id, base_node FROM fl_steps", extra_ctes=O.FLOW_CTES))
def q_flow_dedupe(spark, sf):
    return _steps(spark, sf).select("session_id", "event_id", "base_node")


@reg("flow_step_index", O.with_view("SELECT session_id, event_id, step_idx FROM fl_steps", extra_ctes=O.FLOW_CTES))
def q_flow_step_index(spark, sf):
    return _steps(spark, sf).select("session_id", "event_id", F.col("step_idx").cast("bigint").alias("step_idx"))


@reg("flow_node_id", O.with_view("SELECT session_id, event_id, node_id FROM fl_nodes", extra_ctes=O.FLOW_CTES))
def q_flow_node_id(spark, sf):
    return _steps(spark, sf).select("session_id", "event_id", "node_id")


@reg("flow_pairs", O.with_view("SELECT session_id, event_id, source_node, target_node FROM fl_pairs",
                               extra_ctes=O.FLOW_CTES))
def q_flow_pairs(spark, sf):
    return _steps(spark, sf).select("session_id", "event_id", F.col("node_id").alias("source_node"), "target_node")


@reg("flow_transitions", O.with_view("SELECT source_node, target_node, value FROM fl_links", extra_ctes=O.FLOW_CTES))
def q_flow_transitions(spark, sf):
    return flow.flow_links(analytics(spark, sf))


@reg("flow_transitions_all", O.with_view("SELECT source_node, target_node, value FROM fl_counts",
                                         extra_ctes=O.FLOW_CTES))
def q_flow_transitions_all(spark, sf):
    return flow.transitions(analytics(spark, sf))


@reg("flow_display_links", O.with_view("SELECT source, target, value FROM fl_shown", extra_ctes=O.FLOW_CTES))
def q_flow_display_links(spark, sf):
    return flow.display_links(flow.flow_links(analytics(spark, sf)))


@reg("flow_nodes", O.with_view(
    "SELECT id, regexp_replace(id, ' #[0-9]+$', '') AS label FROM "
    "(SELECT source AS id FROM fl_shown UNION SELECT target FROM fl_shown) n", extra_ctes=O.FLOW_CTES))
def q_flow_nodes(spark, sf):
    return flow.flow_nodes(flow.display_links(flow.flow_links(analytics(spark, sf))))


@reg("flow_segmented", O.with_view("SELECT source_node, target_node, value FROM fl_links",
                                   SEG2_SQL, extra_ctes=O.FLOW_CTES))
def q_flow_segmented(spark, sf):
    return flow.flow_links(apply_segments(analytics(spark, sf), SEG2))


# ---------------------------------------------------------------- ingest
import oracles_ingest as OI  # noqa: E402
from tidemark.operators import ingest  # noqa: E402


def _requests(spark, sf):
    """The fixture requests, derived once from the supplied tables and kept as a
    Parquet landing table in the shared checkpoint folder (raw requests are
    files in practice; rebuilding them per query would re-run the adapter)."""
    path = scratch_path(spark, "requests", _stamp(sf))
    publish_once(spark, path, lambda tmp: fixtures.requests(spark, sf).write.parquet(tmp))
    return src.read_requests(spark, path, fmt="parquet"), fixtures.sites(spark)


def _checked(spark, sf, metered=True):
    req, sites = _requests(spark, sf)
    return ingest.validate(req, sites, metered)


def _enriched(spark, sf):
    return ingest.enrich(_checked(spark, sf))


def _processed(spark, sf):
    req, sites = _requests(spark, sf)
    return ingest.process(req, sites, metered=True, keep=["request_id"])


def _status_rows(spark, sf, reason_pair=None):
    c = _checked(spark, sf)
    if reason_pair is not None:
        c = c.filter((F.col("status") == reason_pair[0]) & (F.col("reason") == reason_pair[1]))
    return c.select("request_id", "status", "reason")


def _status_sql(reason_key=None):
    where = f" WHERE reason = {OI.REASONS[reason_key]}" if reason_key else ""
    return OI.ing(f"SELECT request_id, status, reason FROM ing_chk{where}")


for _k, _pair, _rk in [
    ("ing_require_site", ingest.MISSING_SITE, "missing"),
    ("ing_site_lookup", ingest.UNKNOWN_SITE, "unknown"),
    ("ing_domain_check", ingest.REFERER_NOT_ALLOWED, "notallowed"),
    ("ing_domain_parse", ingest.BAD_REFERER, "badref"),
    ("ing_allowance_gate", ingest.NO_ALLOWANCE, "allowance"),
    ("ing_body_present", ingest.MISSING_BODY, "nobody"),
    ("ing_body_json", ingest.BAD_JSON, "badjson"),
]:
    reg(_k, _status_sql(_rk))(lambda spark, sf, _p=_pair: _status_rows(spark, sf, _p))


@reg("ing_status", _status_sql())
def q_ing_status(spark, sf):
    return _status_rows(spark, sf)


@reg("ing_parse_body", OI.ing(
    "SELECT request_id, event, pathname, session_id, is_initial AS is_initial_event, "
    "CASE WHEN is_initial THEN CAST(CAST(screen_width AS INT) AS VARCHAR) END AS screen_width, "
    "utm_source FROM ing_acc"))
def q_ing_parse_body(spark, sf):
    p = ingest.parse_body(_checked(spark, sf).filter(F.col("status") == 202))
    return p.select("request_id", F.col("b_event").alias("event"), F.col("b_pathname").alias("pathname"),
                    F.col("b_session_id").alias("session_id"), "is_initial_event",
                    F.col("b_screen_width").alias("screen_width"), F.col("b_utm_source").alias("utm_source"))


@reg("ing_server_time", OI.ing(
    "SELECT request_id, strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') AS \"timestamp\", dt FROM ing_acc"))
def q_ing_server_time(spark, sf):
    e = _enriched(spark, sf)
    return e.select("request_id", ts_text().alias("timestamp"), "dt")


def _lake_rows(df, cols):
    out = []
    for c in cols:
        if c == "timestamp":
            out.append(ts_text().alias("timestamp"))
        elif c == "properties":
            out.append(F.to_json(F.col("properties")).alias("properties"))
        else:
            out.append(F.col(c))
    return df.select(*out)


@reg("ing_initial_projection", OI.ing("SELECT " + ", ".join(f'"{c}"' for c in OI.INITIAL_COLS) + " FROM ing_initial"))
def q_ing_initial_projection(spark, sf):
    ini, _reg, _rej, _chk = _processed(spark, sf)
    return _lake_rows(ini, OI.INITIAL_COLS)


@reg("ing_regular_projection", OI.ing("SELECT " + ", ".join(f'"{c}"' for c in OI.REGULAR_COLS) + " FROM ing_regular"))
def q_ing_regular_projection(spark, sf):
    _ini, regular, _rej, _chk = _processed(spark, sf)
    return _lake_rows(regular, OI.REGULAR_COLS)


MASK_COLS = ["request_id", "site_id", "city", "timezone", "screen_width", "properties", "model", "manufacturer",
             "country", "browser"]


@reg("ing_compliance_mask", OI.ing("SELECT " + ", ".join(f'"{c}"' for c in MASK_COLS) + " FROM ing_initial"))
def q_ing_compliance_mask(spark, sf):
    ini, _reg, _rej, _chk = _processed(spark, sf)
    return _lake_rows(ini, MASK_COLS)


@reg("ing_drop_nulls", OI.ing("SELECT request_id, properties FROM ing_regular"))
def q_ing_drop_nulls(spark, sf):
    _ini, regular, _rej, _chk = _processed(spark, sf)
    return _lake_rows(regular, ["request_id", "properties"])


def _initial_enriched(spark, sf):
    parsed = ingest.parse_accepted(_checked(spark, sf))
    return ingest.enrich_visit(parsed.filter(F.col("is_initial_event")))


@reg("ing_geo", OI.ing("SELECT request_id, e_city AS city, e_region AS region, e_country AS country, "
                       "e_timezone AS timezone FROM ing_enr"))
def q_ing_geo(spark, sf):
    return _initial_enriched(spark, sf).select("request_id", "city", "region", "country", "timezone")


@reg("ing_user_agent", OI.ing("SELECT request_id, u_device AS device, u_browser AS browser, "
                              "u_browser_version AS browser_version, u_os AS os, u_os_version AS os_version, "
                              "u_model AS model, u_manufacturer AS manufacturer FROM ing_enr"))
def q_ing_user_agent(spark, sf):
    return _initial_enriched(spark, sf).select("request_id", "device", "browser", "browser_version", "os",
                                               "os_version", "model", "manufacturer")


@reg("ing_referer", OI.ing("SELECT request_id, e_referer AS referer, e_referer_domain AS referer_domain FROM ing_enr"))
def q_ing_referer(spark, sf):
    return _initial_enriched(spark, sf).select("request_id", "referer", "referer_domain")


@reg("ing_referer_scrub", OI.ing(
    "SELECT request_id, e_referer AS referer FROM ing_enr WHERE COALESCE(lvl, 'maybe') IN ('yes', 'maybe')"))
def q_ing_referer_scrub(spark, sf):
    e = _initial_enriched(spark, sf)
    return e.filter(F.coalesce(F.col("_level"), F.lit("maybe")).isin("yes", "maybe")).select("request_id", "referer")


@reg("ing_to_string", OI.ing("SELECT request_id, session_id, e_screen_width AS screen_width, "
                             "e_screen_height AS screen_height FROM ing_enr"))
def q_ing_to_string(spark, sf):
    e = _initial_enriched(spark, sf)
    p = ingest.project_initial(e, ["request_id"])
    return p.select("request_id", "session_id", "screen_width", "screen_height")


@reg("ing_utm", OI.ing("SELECT request_id, e_utm_source AS utm_source, e_utm_campaign AS utm_campaign, "
                       "e_utm_medium AS utm_medium, e_utm_content AS utm_content, e_utm_term AS utm_term FROM ing_enr"))
def q_ing_utm(spark, sf):
    return _initial_enriched(spark, sf).select("request_id", *ingest.UTM_FIELDS)


@reg("ing_mark_initial", O.with_view("SELECT event_id, is_initial FROM fx_all"))
def q_ing_mark_initial(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet")
    df = raw.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.col("ts"))
    m = ingest.mark_initial(df, ["user_id", "dt"], [F.col("ts"), F.col("event_id")], "is_initial")
    return m.select("event_id", "is_initial")


# ---------------------------------------------------------------- lake: sources, sinks, scoped read

import oracles_tables as OT  # noqa: E402
from tidemark.operators import billing, scope, sites as site_ops, usage  # noqa: E402
from tidemark.plans.jobs import ingest_to_lake  # noqa: E402
from tidemark.sinks import lake as sink  # noqa: E402

def lake_root(spark, sf):
    return scratch_path(spark, "lake", _stamp(sf))


def ensure_lake(spark, sf):
    """Ingest the fixture requests of ``sf`` into a lake once (batch 0, metered)."""
    root = lake_root(spark, sf)

    def write(tmp):
        req, sites = _requests(spark, sf)
        ingest_to_lake(spark, req, sites, tmp, 0, metered=True)

    return publish_once(spark, root, write)


LAKE_REGULAR = ["site_id", "dt", "event", "pathname", "session_id", "timestamp", "properties"]
LAKE_INITIAL = [c for c in OI.INITIAL_COLS if c != "request_id"]


def _cols_sql(cols, src_name, extra=""):
    return "SELECT " + ", ".join(f'"{c}"' for c in cols) + extra + f" FROM {src_name}"


@reg("src_events", OI.ing(_cols_sql(LAKE_REGULAR, "ing_regular", ", CAST(0 AS BIGINT) AS batch_id")))
def q_src_events(spark, sf):
    return _lake_rows(src.read_events(spark, ensure_lake(spark, sf)), LAKE_REGULAR + ["batch_id"])


@reg("src_initial_events", OI.ing(_cols_sql(LAKE_INITIAL, "ing_initial", ", CAST(0 AS BIGINT) AS batch_id")))
def q_src_initial_events(spark, sf):
    return _lake_rows(src.read_initial_events(spark, ensure_lake(spark, sf)), LAKE_INITIAL + ["batch_id"])


@reg("snk_append_lake", OI.ing(
    "SELECT site_id, dt, CAST(0 AS BIGINT) AS batch_id, COUNT(*) AS n FROM ("
    "SELECT site_id, dt FROM ing_initial UNION ALL SELECT site_id, dt FROM ing_regular) x GROUP BY 1, 2"))
def q_snk_append_lake(spark, sf):
    root = ensure_lake(spark, sf)
    a = src.read_initial_events(spark, root).select("site_id", "dt", "batch_id")
    b = src.read_events(spark, root).select("site_id", "dt", "batch_id")
    return a.unionByName(b).groupBy("site_id", "dt", "batch_id").agg(F.count(F.lit(1)).alias("n"))


@reg("snk_rejects", OI.ing(
    "SELECT request_id, site, status, reason, strftime(received_at, '%Y-%m-%d') AS dt FROM ing_chk WHERE status <> 202"))
def q_snk_rejects(spark, sf):
    r = src.read_table(spark, ensure_lake(spark, sf), src.REJECTS)
    return r.select("request_id", "site", "status", "reason", "dt")


from tidemark import schema as _S  # noqa: E402


@reg("snk_route", OI.ing(
    "SELECT request_id, CASE WHEN is_initial THEN 'initial_events' ELSE 'events' END AS target FROM ing_acc"))
def q_snk_route(spark, sf):
    e = _enriched(spark, sf)
    first, later = sink.route(e)
    return first.select("request_id", F.lit("initial_events").alias("target")).unionByName(
        later.select("request_id", F.lit("events").alias("target")))


@reg("use_meter", OI.ing("SELECT site AS site_id, COUNT(*) AS used FROM ing_chk WHERE uses_allowance GROUP BY site"))
def q_use_meter(spark, sf):
    return usage.meter(_checked(spark, sf))


@reg("use_ledger", OI.ing(
    "SELECT CAST(0 AS BIGINT) AS batch_id, site AS site_id, COUNT(*) AS used FROM ing_chk WHERE uses_allowance GROUP BY site"))
def q_use_ledger(spark, sf):
    from tidemark.plans.jobs import read_ledger
    return read_ledger(spark, ensure_lake(spark, sf)).select("batch_id", "site_id", "used")


@reg("use_apply", OI.ing(
    "SELECT s.site_id, CAST(CASE WHEN u.used IS NOT NULL AND s.allowance >= u.used THEN s.allowance - u.used "
    "ELSE s.allowance END AS BIGINT) AS request_allowance FROM ing_sites s LEFT JOIN "
    "(SELECT site, COUNT(*) AS used FROM ing_chk WHERE uses_allowance GROUP BY site) u ON u.site = s.site_id"))
def q_use_apply(spark, sf):
    c = _checked(spark, sf)
    return usage.apply_usage(fixtures.sites(spark), usage.meter(c)).select("site_id", "request_allowance")


PF_IDS = ["site-0", "site-2"]
PF_A, PF_B = "2024-01-03", "2024-01-09"
PF_WHERE = f"site_id IN ('site-0', 'site-2') AND dt BETWEEN '{PF_A}' AND '{PF_B}'"


@reg("qry_partition_filter", OI.ing(_cols_sql(LAKE_REGULAR, "ing_regular") + f" WHERE {PF_WHERE}"))
def q_qry_partition_filter(spark, sf):
    ev = scope.scoped_read(spark, ensure_lake(spark, sf), src.EVENTS, PF_IDS, PF_A, PF_B)
    return _lake_rows(ev, LAKE_REGULAR)


SAFE_INITIAL = [c for c in LAKE_INITIAL if c not in ("distinct_id", "model", "manufacturer")]


@reg("qry_safe_columns", OI.ing(_cols_sql(SAFE_INITIAL, "ing_initial")))
def q_qry_safe_columns(spark, sf):
    from tidemark import schema as S
    df = scope.safe_select(src.read_initial_events(spark, ensure_lake(spark, sf)), S.INITIAL_FIELDS)
    return _lake_rows(df, SAFE_INITIAL)


@reg("qry_try_cast", OI.ing("SELECT session_id, properties FROM ing_regular"))
def q_qry_try_cast(spark, sf):
    from tidemark import schema as S
    df = scope.typed_select(scope.safe_select(src.read_events(spark, ensure_lake(spark, sf)), S.COMMON_FIELDS))
    return df.select("session_id", "properties")


@reg("qry_order_desc", OI.ing(
    "SELECT session_id, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f') AS \"timestamp\" FROM ing_acc "
    f"WHERE NOT is_initial AND {PF_WHERE} ORDER BY \"timestamp\" DESC"))
def q_qry_order_desc(spark, sf):
    ev = scope.scoped_read(spark, ensure_lake(spark, sf), src.EVENTS, PF_IDS, PF_A, PF_B)
    return scope.newest_first(ev).select("session_id", ts_text().alias("timestamp"))


@reg("qry_fetch_pair", OI.ing(
    "SELECT 'initial_events' AS tbl, session_id, properties FROM ing_initial WHERE " + PF_WHERE +
    " UNION ALL SELECT 'events', session_id, properties FROM ing_regular WHERE " + PF_WHERE))
def q_qry_fetch_pair(spark, sf):
    ini, ev = scope.fetch(spark, ensure_lake(spark, sf), PF_IDS, PF_A, PF_B)
    return ini.select(F.lit("initial_events").alias("tbl"), "session_id", "properties").unionByName(
        ev.select(F.lit("events").alias("tbl"), "session_id", "properties"))


@reg("qry_owned_sites", OT.pages_sql("SELECT site_id FROM ps_raw WHERE owner_sub = 'owner-3'"))
def q_qry_owned_sites(spark, sf):
    return scope.owned_sites(fixtures.page_sites_raw(spark, sf), "owner-3")


SCOPE_REQ = "ps-3, ps-10 ,, ps-4,ps-9999"


@reg("qry_site_scope", OT.pages_sql(
    "SELECT site_id FROM ps_raw WHERE owner_sub = 'owner-3' AND site_id IN ('ps-3', 'ps-10', 'ps-4', 'ps-9999')"))
def q_qry_site_scope(spark, sf):
    return scope.site_scope(fixtures.page_sites_raw(spark, sf), "owner-3", SCOPE_REQ)


# ---------------------------------------------------------------- sites, usage summary, billing
@reg("dim_sites_clean", OT.pages_sql(
    "SELECT site_id, name, array_to_string(list_sort(list_distinct(hosts)), ',') AS domains, compliance_level, plan, "
    "request_allowance, error FROM ps_clean"))
def q_dim_sites_clean(spark, sf):
    c = site_ops.clean_sites(fixtures.page_sites_raw(spark, sf))
    return c.select("site_id", "name", F.concat_ws(",", F.array_sort(F.col("domains"))).alias("domains"),
                    "compliance_level", "plan", "request_allowance", "error")


@reg("dim_sites_update", OT.pages_sql("SELECT * FROM up_sites"))
def q_dim_sites_update(spark, sf):
    s = site_ops.update_sites(fixtures.page_sites_raw(spark, sf), fixtures.page_site_updates(spark, sf))
    return s.select("site_id", "name", F.concat_ws(",", "domains").alias("domains"), "plan", F.concat_ws(",", "allowed_fields").alias("allowed_fields"),
                    "compliance_level", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@reg("dim_sites_create", OT.pages_sql("SELECT * FROM new_sites"))
def q_dim_sites_create(spark, sf):
    raw = fixtures.page_sites_raw(spark, sf)
    taken = raw.where(F.regexp_extract("site_id", r"(\d+)$", 1).cast("bigint") % 7 == 0)
    made = site_ops.create_sites(taken, fixtures.page_site_requests(spark, sf))
    return made.select("site_id", "name", "status", "error", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@reg("use_summary", OT.pages_sql("SELECT * FROM use_sum"))
def q_use_summary(spark, sf):
    s = usage.usage_summary(fixtures.page_sites_raw(spark, sf), fixtures.page_prefs(spark, sf))
    return s.select("site_id", "owner_sub", "plan", "initial_allowance", "request_allowance", "requests_used", "locked")


@reg("use_locked", OT.pages_sql("SELECT site_id FROM use_sum WHERE locked"))
def q_use_locked(spark, sf):
    s = usage.usage_summary(fixtures.page_sites_raw(spark, sf), fixtures.page_prefs(spark, sf))
    return s.filter("locked").select("site_id")


def _page_tables(spark, sf):
    return fixtures.page_sites_raw(spark, sf), fixtures.page_prefs(spark, sf), fixtures.page_outcomes(spark, sf)


@reg("bil_candidates", OT.pages_sql("SELECT site_id, owner_sub, ready FROM bil_cand"))
def q_bil_candidates(spark, sf):
    s, p, _o = _page_tables(spark, sf)
    return billing.charge_candidates(s, p).select("site_id", "owner_sub", "ready")


@reg("bil_ready", OT.pages_sql("SELECT site_id FROM bil_cand WHERE ready"))
def q_bil_ready(spark, sf):
    s, p, _o = _page_tables(spark, sf)
    return billing.charge_candidates(s, p).filter("ready").select("site_id")


@reg("bil_success", OT.pages_sql("SELECT site_id, plan, request_allowance FROM bil_sites WHERE plan = 'active_paid'"))
def q_bil_success(spark, sf):
    s, p, o = _page_tables(spark, sf)
    return billing.apply_outcomes(s, p, o).filter(F.col("plan") == "active_paid").select(
        "site_id", "plan", "request_allowance")


@reg("bil_failure", OT.pages_sql("SELECT site_id, plan, request_allowance FROM bil_sites WHERE plan = 'payment_failed'"))
def q_bil_failure(spark, sf):
    s, p, o = _page_tables(spark, sf)
    return billing.apply_outcomes(s, p, o).filter(F.col("plan") == "payment_failed").select(
        "site_id", "plan", "request_allowance")


@reg("bil_deactivate", OT.pages_sql("SELECT cognito_sub, is_payment_active FROM bil_prefs"))
def q_bil_deactivate(spark, sf):
    s, p, o = _page_tables(spark, sf)
    return billing.apply_pref_outcomes(p, s, o).select("cognito_sub", "is_payment_active")


@reg("bil_payment_events", OT.pages_sql("SELECT * FROM pe_prefs"))
def q_bil_payment_events(spark, sf):
    p = fixtures.page_prefs(spark, sf)
    return billing.apply_payment_events(p, fixtures.page_payment_events(spark, sf))


# ---------------------------------------------------------------- bundles and dashboard
from tidemark.plans.dashboard import dashboard  # noqa: E402

DEVICE_PARTS = [p for p in LONG_SQL_PARTS if p[0] in ("browsers", "os", "screenSizes")]


def _long_sql_of(parts):
    out = []
    for t, body in parts:
        cols = "name, value, NULL::BIGINT AS events, NULL::DOUBLE AS percentage"
        if t in ("browsers", "os", "screenSizes"):
            cols = "name, value, NULL::BIGINT AS events, percentage"
        if t in ("events", "properties"):
            cols = "name, value, events, percentage"
        out.append(f"SELECT '{t}' AS type, {cols} FROM ({body}) p_{t}")
    return "\nUNION ALL\n".join(out)


@reg("rpt_bundle", O.with_view(_long_sql_of(DEVICE_PARTS)))
def q_rpt_bundle(spark, sf):
    return reports.long_report(analytics(spark, sf), ["devices"])


DASH_SEGS = [Segment("channel", "Social")]


def _dashboard_sql():
    none = "NULL::VARCHAR AS target", "NULL::BIGINT AS events", "NULL::DOUBLE AS percentage", "NULL::DOUBLE AS number"
    reports_sql = _long_sql_of(LONG_SQL_PARTS + [("properties", O.PROPERTY_VALUES)])
    parts = [f"SELECT type, name, NULL::VARCHAR AS target, value::BIGINT AS value, events, percentage, NULL::DOUBLE AS number FROM ({reports_sql}) r"]
    for name, column in [("total_visits", "value"), ("total_pageviews", "value"), ("unique_visitors", "value"), ("bounced_sessions", "value"),
                         ("bounce_rate", "percentage"), ("median_duration_seconds", "number"), ("views_per_visit", "number")]:
        cells = {"value": "NULL::BIGINT", "events": "NULL::BIGINT", "percentage": "NULL::DOUBLE", "number": "NULL::DOUBLE"} | {column: name}
        parts.append(f"SELECT 'stats', '{name}', NULL, " + ", ".join(cells.values()) + f" FROM ({O.STATS}) st")
    empty = ", ".join(n.split(" AS ")[0] for n in none[1:])
    parts.append(f"SELECT 'chart', strftime(\"timestamp\", '%Y-%m-%d'), NULL, COUNT(*), {empty} FROM a WHERE event = 'page_view' GROUP BY 2")
    parts.append(f"SELECT DISTINCT 'propertyKeys', unnest(json_keys(json(properties))), NULL::VARCHAR, NULL::BIGINT, {empty} FROM analytics "
                 "WHERE json_valid(properties)")
    parts.append(f"SELECT 'flow', source, target, value, {empty} FROM fl_shown")
    return O.with_view("\nUNION ALL\n".join(parts), O.seg_where(["channel = 'Social'"]),
                       extra_ctes=O.property_values_ctes("k") + ",\n" + O.FLOW_CTES)


@reg("rpt_dashboard", _dashboard_sql())
def q_rpt_dashboard(spark, sf):
    return dashboard(analytics(spark, sf), segments=DASH_SEGS, property_key="missing-key", persist=False).long()


# ---------------------------------------------------------------- value rows, JSON, views, compaction, stream
VALUE_SCHEMA = [("session_id", "string"), ("timestamp", "timestamp"), ("properties", "map<string,string>"),
                ("country", "string"), ("referer_domain", "string"), ("not_sent", "string")]


@reg("snk_value_rows", O.with_view(
    "SELECT event_id, CAST(to_json([session_id, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%g'), country, "
    "NULL::VARCHAR, referer_domain]) AS VARCHAR) AS \"values\" FROM initial_t"))
def q_snk_value_rows(spark, sf):
    ini, _ = fixtures.load(spark, sf)
    ini = model.override_referer(ini)
    v = sink.value_rows(ini, ["session_id", "timestamp", "country", "not_in_table", "referer_domain"], keep=["event_id"])
    return v.select("event_id", F.to_json("values").alias("values"))


@reg("src_value_rows", O.with_view(
    "SELECT session_id, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%g') AS \"timestamp\", properties, country, "
    "referer_domain, NULL::VARCHAR AS not_sent FROM initial_t"))
def q_src_value_rows(spark, sf):
    ini, _ = fixtures.load(spark, sf)
    ini = model.override_referer(ini)
    sent = [n for n, _t in VALUE_SCHEMA if n != "not_sent"]
    rows = src.values_to_rows(sink.value_rows(ini, sent), VALUE_SCHEMA)
    return rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"))


def _scratch_dir(spark, sf, name):
    return scratch_path(spark, "work", _stamp(sf), name)


@reg("src_fixed_json", O.with_view(_view_sql(["session_id", "event_id", "timestamp", "referer_domain", "country"],
                                             "initial_t")))
def q_src_fixed_json(spark, sf):
    from pyspark.sql import types as T
    ini, _ = fixtures.load(spark, sf)
    ini = model.override_referer(ini)
    path = _scratch_dir(spark, sf, "json_initial")
    ini.write.mode("overwrite").option("timestampFormat", src.JSON_TS).json(path)
    schema = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("event_id", T.LongType()),
                           T.StructField("timestamp", T.TimestampType()), T.StructField("referer_domain", T.StringType()),
                           T.StructField("country", T.StringType())])
    return _view_rows(src.load_json(spark, path, schema), ["session_id", "event_id", "timestamp", "referer_domain", "country"])


@reg("src_requests", OI.ing(
    "SELECT request_id, site, strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') AS received_at, "
    "CASE WHEN fault = 17 THEN 'https://evil.example/x' WHEN fault = 19 THEN 'not a url' "
    "ELSE 'https://' || site_id || '.example' || pathname END AS referer, fault = 23 AS no_body FROM ing_r"))
def q_src_requests(spark, sf):
    req, _ = _requests(spark, sf)
    path = _scratch_dir(spark, sf, "requests_json")
    req.write.mode("overwrite").option("timestampFormat", src.JSON_TS).json(path)
    r = src.read_requests(spark, path)
    return r.select("request_id", "site", ts_text("received_at").alias("received_at"),
                    F.col("headers")["referer"].alias("referer"), F.col("body").isNull().alias("no_body"))


@reg("snk_replace_views", O.with_view(
    "SELECT 'tm_initial_events' AS view, COUNT(*) AS n FROM initial_t UNION ALL "
    "SELECT 'tm_events', COUNT(*) FROM events_t"))
def q_snk_replace_views(spark, sf):
    ini, ev = fixtures.load(spark, sf)
    ini_full = model.union_events(ini, ev.limit(0), _S.INITIAL_FIELDS)
    ev_full = ev.withColumn("properties", F.col("properties"))
    sink.register_tables(spark, ini_full, ev_full, ("tm_initial_events", "tm_events"))
    a = spark.table("tm_initial_events").agg(F.count(F.lit(1)).alias("n")).select(F.lit("tm_initial_events").alias("view"), "n")
    b = spark.table("tm_events").agg(F.count(F.lit(1)).alias("n")).select(F.lit("tm_events").alias("view"), "n")
    return a.unionByName(b)


COMPACT_SITE, COMPACT_DT = "site-1", "2024-01-05"


@reg("snk_compact", OI.ing(
    _cols_sql(LAKE_REGULAR, "ing_regular") + f" WHERE site_id = '{COMPACT_SITE}' AND dt = '{COMPACT_DT}'"))
def q_snk_compact(spark, sf):
    # a lake of its own, in two batches (requests up to a time, and after it); the gate ranks by time, so both together
    # pass what one batch would.  The second one is replayed after the merge.
    root = lake_root(spark, sf) + "_compact"

    def write(tmp):
        req, sites = _requests(spark, sf)
        late = F.col("received_at") >= F.lit(f"{COMPACT_DT} 12:00:00").cast("timestamp")
        ingest_to_lake(spark, req.where(~late), sites, tmp, 0, metered=True)
        ingest_to_lake(spark, req.where(late), sites, tmp, 1, metered=True)
        sink.compact(spark, tmp, "events", COMPACT_SITE, COMPACT_DT)
        ingest_to_lake(spark, req.where(late), sites, tmp, 1, metered=True)
        sink.compact(spark, tmp, "events", COMPACT_SITE, COMPACT_DT)

    publish_once(spark, root, write)
    ev = scope.scoped_read(spark, root, src.EVENTS, [COMPACT_SITE], COMPACT_DT, COMPACT_DT)
    return _lake_rows(ev, LAKE_REGULAR)


@reg("snk_append_lake_stream", OI.ing(
    "SELECT site_id, dt, CAST(0 AS BIGINT) AS batch_id, COUNT(*) AS n FROM ("
    "SELECT site_id, dt FROM ing_initial UNION ALL SELECT site_id, dt FROM ing_regular) x GROUP BY 1, 2"))
def q_snk_append_lake_stream(spark, sf):
    from tidemark.streaming.ingest_stream import start_ingest
    src_dir = _scratch_dir(spark, sf, "stream_requests")
    root = scratch_path(spark, "lake", _stamp(sf) + "_stream")

    def write(tmp):
        req, _ = _requests(spark, sf)
        req.write.mode("overwrite").option("timestampFormat", src.JSON_TS).json(src_dir)
        q = start_ingest(spark, src_dir, lambda: fixtures.sites(spark), tmp, checkpoint=tmp + "_checkpoint",
                         available_now=True)
        q.awaitTermination()

    publish_once(spark, root, write)
    a = src.read_initial_events(spark, root).select("site_id", "dt", "batch_id")
    b = src.read_events(spark, root).select("site_id", "dt", "batch_id")
    return a.unionByName(b).groupBy("site_id", "dt", "batch_id").agg(F.count(F.lit(1)).alias("n"))
