"""Hand-made golden cases for the session model, segments, stats and flow (FIXTURES.md section 2)."""

from pyspark.sql import functions as F

from helpers import build, event_row, initial_row, tables
from tidemark.operators import flow, model, reports, stats
from tidemark.operators.segments import Segment, apply_segments


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_first_row_wins(spark):
    a = build(spark, [initial_row("s1", "2024-01-01T10:00:00", country="FR")],
              [event_row("s1", "2024-01-01T10:01:00")])
    got = [r["country"] for r in a.rows.collect()]
    assert got == ["FR", "FR"]


def test_first_row_null_vs_forward(spark):
    ini, ev = tables(spark, [initial_row("s2", "2024-01-01T10:01:00", country="FR")],
                     [event_row("s2", "2024-01-01T10:00:00")])
    a = model.build(ini, ev)
    assert sorted((r["timestamp"].minute, r["country"]) for r in a.rows.collect()) == [(0, None), (1, None)]
    u = model.union_events(ini, ev)
    fwd = model.fill_session(u, "forward")
    assert sorted((r["timestamp"].minute, r["country"]) for r in fwd.collect()) == [(0, None), (1, "FR")]
    first = model.fill_session(u, "first_row")
    assert sorted((r["timestamp"].minute, r["country"]) for r in first.collect()) == [(0, None), (1, None)]


def test_session_over_midnight_keeps_first_date(spark):
    a = build(spark, [initial_row("s3", "2024-01-01T23:59:00")], [event_row("s3", "2024-01-02T00:01:00")])
    assert {r["dt"] for r in a.rows.collect()} == {"2024-01-01"}


def _channel_source(spark, **kw):
    a = build(spark, [initial_row("x", "2024-01-01T10:00:00", **kw)], [])
    r = a.rows.first()
    return r["channel"], r["source"]


def test_channel_and_source_rules(spark):
    assert _channel_source(spark, referer_domain="www.google.com") == ("Referral", "google.com")  # D4
    assert _channel_source(spark) == ("Direct", "$direct")  # D5
    assert _channel_source(spark, referer_domain="WWW.News.example") == ("Referral", "news.example")
    assert _channel_source(spark, utm_medium="cpc", referer_domain="mail.google.com")[0] == "Paid Search"
    assert _channel_source(spark, utm_source="newsletter", referer_domain="google.com") == ("Referral", "newsletter")
    assert _channel_source(spark, utm_source="  ", referer_domain="google.com") == ("Organic Search", "google.com")
    assert _channel_source(spark, referer_domain="com.google.android.gm")[0] == "Email"


def test_mixed_case_segment_finds_nothing(spark):
    a = build(spark, [initial_row("x", "2024-01-01T10:00:00", referer_domain="WWW.News.example")], [])
    assert apply_segments(a, [Segment("referer_domain", "news.example")]).rows.count() == 0  # D6
    assert apply_segments(a, [Segment("source", "news.example")]).rows.count() == 1


def test_bounce_visitors_and_median(spark):
    a = build(spark, [
        initial_row("b", "2024-01-01T10:00:00"),                      # bounce: one page_view + two clicks
        initial_row("c", "2024-01-01T11:00:00", event="click"),       # no page_view
        initial_row("d", "2024-01-01T12:00:00"),                      # single-event session
        initial_row("e", "2024-01-01T13:00:00", event="click"),       # duration 10 s
    ], [
        event_row("b", "2024-01-01T10:00:05"), event_row("b", "2024-01-01T10:00:15"),
        event_row("c", "2024-01-01T11:00:20"),
        event_row("e", "2024-01-01T13:00:10"),
    ])
    st = stats.stats(a).first()
    assert st["unique_visitors"] == 4
    assert st["bounced_sessions"] == 2  # b and d have exactly one page_view
    assert st["total_pageviews"] == 2
    # durations: b 15 s, c 20 s, e 10 s (d excluded) -> median 15 s
    assert st["median_duration_seconds"] == 15.0
    disp = stats.stats_display(stats.stats(a)).first()
    assert disp["visit_duration"] == "15s"
    assert disp["bounce_rate"] == "50.0%"


def test_format_duration(spark):
    from tidemark.functions.text import format_duration
    df = spark.createDataFrame([(90.0,), (45.0,), (0.0,), (None,), (-1.0,)], "s double")
    got = [r[0] for r in df.select(format_duration(F.col("s"))).collect()]
    assert got == ["1m 30s", "45s", "0s", "N/A", "N/A"]


def test_two_segments_met_by_different_rows(spark):
    a = build(spark, [initial_row("k", "2024-01-01T10:00:00", pathname="/a")],
              [event_row("k", "2024-01-01T10:00:01", event="buy", pathname="/z")])
    segs = [Segment("pathname", "/a"), Segment("event", "buy")]
    assert apply_segments(a, segs).rows.count() == 2


def test_unknown_clicked_matches_no_null(spark):
    a = build(spark, [initial_row("u", "2024-01-01T10:00:00")], [])
    top = reports.countries(a).collect()
    assert [(r["name"], r["value"]) for r in top] == [("Unknown", 1)]
    assert apply_segments(a, [Segment("country", "Unknown")]).rows.count() == 0  # D7


def test_null_session(spark):
    a = build(spark, [initial_row(None, "2024-01-01T10:00:00", pathname="/n")],
              [event_row(None, "2024-01-01T10:00:01")])
    assert a.rows.count() == 2
    assert apply_segments(a, [Segment("pathname", "/n")]).rows.count() == 0


def test_screen_sizes_hide_unknown_but_count_it(spark):
    a = build(spark, [initial_row("p", "2024-01-01T10:00:00", screen_width="1920", screen_height="1080"),
                      initial_row("q", "2024-01-01T10:00:00")], [])
    got = [(r["name"], r["value"], r["percentage"]) for r in reports.screen_sizes(a).collect()]
    assert got == [("1920x1080", 1, 50.0)]  # D14


def test_flow_repeat_and_null_event(spark):
    a = build(spark, [initial_row("f", "2024-01-01T10:00:00", pathname="/a")],
              [event_row("f", "2024-01-01T10:00:01", event="page_view", pathname="/a"),
               event_row("f", "2024-01-01T10:00:02", event="page_view", pathname="/b")])
    links = [(r["source_node"], r["target_node"], r["value"]) for r in flow.transitions(a).collect()]
    assert links == [(flow.PAGE_MARK + "/a #1", flow.PAGE_MARK + "/b #2", 1)]
    b = build(spark, [initial_row("g", "2024-01-01T10:00:00", event=None)], [])
    nodes = [r["node_id"] for r in flow.steps(b.event_rows()).collect()]
    assert nodes == [" #1"]


def test_display_links_and_nodes(spark):
    links = spark.createDataFrame([("a #1", "b #2", 5), ("a #1", "a #1", 9), ("b #2", "c #3", 2)],
                                  "source_node string, target_node string, value long")
    shown = flow.display_links(links).collect()
    assert [(r["source"], r["target"]) for r in shown] == [("a #1", "b #2")]
    nodes = sorted((r["id"], r["label"]) for r in flow.flow_nodes(flow.display_links(links)).collect())
    assert nodes == [("a #1", "a"), ("b #2", "b")]


def test_property_values_share_of_sum(spark):
    a = build(spark, [initial_row("m", "2024-01-01T10:00:00", properties='{"plan": "pro", "a-b": "x"}'),
                      initial_row("n", "2024-01-01T10:00:00", properties='{"plan": "free"}'),
                      initial_row("o", "2024-01-01T10:00:00", properties="not json")], [])
    got = {r["name"]: (r["value"], r["events"], r["percentage"]) for r in reports.property_values(a, "plan").collect()}
    assert got == {"pro": (1, 1, 50.0), "free": (1, 1, 50.0)}  # D15
    assert [r["name"] for r in reports.property_values(a, "a-b").collect()] == ["x"]  # D18
    assert [r["key"] for r in stats.property_keys(a).collect()] == ["a-b", "plan"]


def test_timeseries_hour_or_day(spark):
    from datetime import datetime
    assert stats.bucket_format(datetime(2024, 1, 1), datetime(2024, 1, 2)) == "yyyy-MM-dd HH:00"
    assert stats.bucket_format(datetime(2024, 1, 1), datetime(2024, 1, 3)) == "yyyy-MM-dd"


def test_bundle_unknown_name(spark):
    import pytest
    a = build(spark, [initial_row("z", "2024-01-01T10:00:00")], [])
    with pytest.raises(KeyError):
        reports.bundle(a, "nope")


def test_dashboard_property_key_choice(spark):
    from tidemark.plans.dashboard import dashboard
    a = build(spark, [initial_row("m", "2024-01-01T10:00:00", properties='{"plan": "pro", "b": 1}')], [])
    assert dashboard(a, property_key="plan", persist=False).property_key == "plan"
    assert dashboard(a, property_key="gone", persist=False).property_key == "b"
    empty = build(spark, [initial_row("m", "2024-01-01T10:00:00", properties="{}")], [])
    d = dashboard(empty, persist=False)
    assert d.property_key is None and d.property_values is None


def test_session_key_by_site(spark):
    from helpers import tables
    rows = [initial_row("same", "2024-01-01T10:00:00", country="FR")]
    rows[0]["site_id"] = "a"
    other = initial_row("same", "2024-01-01T11:00:00", country="DE")
    other["site_id"] = "b"
    ini, ev = tables(spark, rows + [other], [])
    assert stats.stats(model.build(ini, ev)).first()["unique_visitors"] == 1  # D24: keyed by session_id alone
    scoped = model.build(ini, ev, session_key=("site_id", "session_id"))
    assert stats.stats(scoped).first()["unique_visitors"] == 2
    assert sorted(r["country"] for r in scoped.rows.collect()) == ["DE", "FR"]
