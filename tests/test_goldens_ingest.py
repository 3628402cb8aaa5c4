"""Hand-made golden cases for ingest, lake, usage and parameters."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import ingest, usage
from tidemark.plans import params
from tidemark.plans.jobs import ingest_to_lake, read_ledger
from tidemark.sources import lake as src
from tidemark.sinks import lake as sink


def sites_df(spark, rows):
    full = [(sid, "o", "n", doms, "free_tier", allow, None, lvl, None, None) for sid, doms, allow, lvl in rows]
    return spark.createDataFrame(full, S.SITES)


def requests_df(spark, rows):
    """rows: (request_id, second, site, headers dict, body)"""
    data = [(rid, datetime(2024, 1, 1, 10, 0, sec), site, headers, None, body) for rid, sec, site, headers, body in rows]
    return spark.createDataFrame(data, S.REQUEST)


FIRST = '{"event":"page_view","pathname":"/","session_id":"s","is_initial_event":true,"referer":"%s"}'


def enrich_one(spark, referer, level="maybe", headers=None):
    s = sites_df(spark, [("a", [], 100, level)])
    r = requests_df(spark, [("r1", 0, "a", headers or {}, FIRST % referer)])
    return ingest.enrich(ingest.validate(r, s)).first()


def test_referer_scrub_and_domain(spark):
    r = enrich_one(spark, "https://ex.com?q=1#f")
    assert (r["referer"], r["referer_domain"]) == ("https://ex.com/", "ex.com")
    r = enrich_one(spark, "android-app://com.google.android.gm/", level="no")
    assert (r["referer"], r["referer_domain"]) == ("android-app://com.google.android.gm/", "com.google.android.gm")
    r = enrich_one(spark, "not a url")
    assert (r["referer"], r["referer_domain"]) == ("not a url", "$invalid")
    r = enrich_one(spark, "https://Shop.example/p", headers={"origin": "https://shop.example"})
    assert (r["referer"], r["referer_domain"]) == ("$direct", "$direct")
    r = enrich_one(spark, "$direct")
    assert (r["referer"], r["referer_domain"]) == ("$direct", "$direct")


def test_domain_check(spark):
    s = sites_df(spark, [("a", ["a.com"], 100, "maybe")])
    r = requests_df(spark, [
        ("r1", 0, "a", {"referer": "https://b.com/x"}, "{}"),
        ("r2", 1, "a", {}, "{}"),
        ("r3", 2, "a", {"referer": "https://a.com/x"}, "{}"),
        ("r4", 3, "a", {"referer": "::"}, "{}"),
        ("r5", 4, "zz", {}, "{}"),
        ("r6", 5, "", {}, "{}"),
    ])
    got = {x["request_id"]: x["status"] for x in ingest.validate(r, s).collect()}
    assert got == {"r1": 403, "r2": 202, "r3": 202, "r4": 400, "r5": 403, "r6": 400}


def test_allowance_gate_counts_before_body(spark):
    s = sites_df(spark, [("a", [], 2, "maybe")])
    r = requests_df(spark, [("r1", 0, "a", {}, "{}"), ("r2", 1, "a", {}, "{broken"), ("r3", 2, "a", {}, "{}")])
    c = ingest.validate(r, s, metered=True)
    assert {x["request_id"]: x["status"] for x in c.collect()} == {"r1": 202, "r2": 400, "r3": 402}  # D11
    assert [(x["site_id"], x["used"]) for x in usage.meter(c).collect()] == [("a", 2)]


def test_allowance_gate_zero_and_large(spark):
    s = sites_df(spark, [("a", [], 0, "maybe"), ("b", [], 1000, "maybe")])
    r = requests_df(spark, [("r1", 0, "a", {}, "{}"), ("r2", 1, "b", {}, "{}")])
    got = {x["request_id"]: x["status"] for x in ingest.validate(r, s, metered=True).collect()}
    assert got == {"r1": 402, "r2": 202}


def test_level_yes_drops_maybe_fields(spark):
    body = ('{"event":"page_view","pathname":"/","session_id":"s","is_initial_event":1,'
            '"screen_width":1920,"screen_height":"1080","properties":{"a":1}}')
    hdr = {"cloudfront-viewer-city": "Lehi", "cloudfront-viewer-country-name": "US",
           "user-agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0.1 Safari/537.36"}
    out = {}
    for lvl in ("yes", "maybe", "no"):
        s = sites_df(spark, [("a", [], 10, lvl)])
        r = requests_df(spark, [("r1", 0, "a", hdr, body)])
        ini, _reg, _rej, _chk = ingest.process(r, s)
        out[lvl] = ini.first().asDict()
    yes, maybe, no = out["yes"], out["maybe"], out["no"]
    for c in ("city", "timezone", "browser_version", "os_version", "screen_width", "screen_height", "properties"):
        assert yes[c] is None, c  # D23
    assert maybe["city"] == "Lehi" and maybe["screen_width"] == "1920" and maybe["properties"] == {"a": "1"}
    assert maybe["model"] is None and no["browser_version"] == "120.0.1"
    kept = {lvl: {k for k, v in d.items() if v is not None} for lvl, d in out.items()}
    assert kept["yes"] <= kept["maybe"] <= kept["no"]
    assert yes["country"] == "US" and yes["site_id"] == "a" and yes["dt"] == "2024-01-01"


def test_regular_event_properties_default(spark):
    s = sites_df(spark, [("a", [], 10, "maybe")])
    r = requests_df(spark, [("r1", 0, "a", {}, '{"event":"click","session_id":7}')])
    _ini, reg, _rej, _chk = ingest.process(r, s)
    row = reg.first()
    assert row["properties"] == {} and row["session_id"] == "7"


def test_event_alias_option(spark):
    s = sites_df(spark, [("a", [], 10, "maybe")])
    r = requests_df(spark, [("r1", 0, "a", {}, '{"event":"pageview","session_id":"x"}')])
    _i, reg, _r, _c = ingest.process(r, s, event_aliases={"pageview": "page_view"})
    assert reg.first()["event"] == "page_view"  # D8


def test_utm_from_page_url_for_first_event(spark):
    s = sites_df(spark, [("a", [], 10, "maybe")])
    body = ('{"event":"page_view","session_id":"x","is_initial_event":true,"utm_source":"body",'
            '"url":"https://a.com/?utm_source=url&utm_medium=e%20mail&utm_term=a+b"}')
    r = requests_df(spark, [("r1", 0, "a", {}, body)])
    row = ingest.enrich(ingest.validate(r, s)).first()
    assert (row["utm_source"], row["utm_medium"], row["utm_term"]) == ("body", "e mail", "a b")


def test_batch_replay_counts_usage_once(spark, scratch):
    s = sites_df(spark, [("a", [], 3, "maybe")])
    mk = lambda ids, base: requests_df(spark, [(f"r{i}", base + i, "a", {}, '{"event":"click","session_id":"s"}') for i in ids])
    b0 = mk([1, 2], 0)
    ingest_to_lake(spark, b0, s, scratch, 0)
    ingest_to_lake(spark, b0, s, scratch, 0)  # replay of batch 0
    counts = ingest_to_lake(spark, mk([3, 4], 10), s, scratch, 1)
    assert counts == {"202": 1, "402": 1}
    assert sorted((x["batch_id"], x["used"]) for x in read_ledger(spark, scratch).collect()) == [(0, 2), (1, 1)]
    assert src.read_events(spark, scratch).count() == 3


def test_stream_equals_batch(spark, scratch):
    from tidemark.streaming.ingest_stream import start_ingest
    s = sites_df(spark, [("a", [], 100, "maybe")])
    reqs = requests_df(spark, [(f"r{i}", i, "a", {}, '{"event":"click","session_id":"s%d"}' % (i % 3)) for i in range(20)])
    reqs.write.option("timestampFormat", src.JSON_TS).json(scratch + "/in")
    q = start_ingest(spark, scratch + "/in", lambda: s, scratch + "/lake", checkpoint=scratch + "/chk", available_now=True)
    q.awaitTermination()
    ingest_to_lake(spark, reqs, s, scratch + "/batch", 0)
    cols = ["site_id", "dt", "event", "session_id", "timestamp"]
    a = sorted(tuple(r) for r in src.read_events(spark, scratch + "/lake").select(*cols).collect())
    b = sorted(tuple(r) for r in src.read_events(spark, scratch + "/batch").select(*cols).collect())
    assert a == b and len(a) == 20


def test_compact_keeps_rows(spark, scratch):
    s = sites_df(spark, [("a", [], 100, "maybe")])
    for b in range(3):
        reqs = requests_df(spark, [(f"r{b}{i}", i, "a", {}, '{"event":"click","session_id":"s"}') for i in range(4)])
        ingest_to_lake(spark, reqs, s, scratch, b, metered=False)
    before = src.read_events(spark, scratch).count()
    n = sink.compact(spark, scratch, "events", "a", "2024-01-01")
    assert n == before == 12
    after = src.read_events(spark, scratch)
    assert after.count() == 12 and sorted(r[0] for r in after.select("batch_id").distinct().collect()) == [0, 1, 2]


def test_register_tables_all_or_nothing(spark):
    ok_i = spark.createDataFrame([], S.INITIAL_EVENTS)
    ok_e = spark.createDataFrame([], S.EVENTS)
    sink.register_tables(spark, ok_i, ok_e, ("t_i", "t_e"))
    with pytest.raises(ValueError):
        sink.register_tables(spark, ok_i.drop("city"), ok_e, ("t_i", "t_e"))
    assert "city" in spark.table("t_i").columns


def test_value_rows_round_trip_and_short_rows(spark):
    df = spark.createDataFrame([(["a", "b"],)], "values array<string>")
    out = src.values_to_rows(df, [("x", "string"), ("y", "string"), ("z", "string")]).first()
    assert (out["x"], out["y"], out["z"]) == ("a", "b", None)
    v = sink.value_rows(spark.createDataFrame([("p", 1)], "a string, b int"), ["b", "missing", "a"]).first()[0]
    assert v == ["1", None, "p"]


def test_load_json_empty_input(spark, scratch):
    df = src.load_json(spark, scratch + "/nothing-here", S.EVENTS)
    assert df.count() == 0 and df.schema == S.EVENTS


def test_date_bounds_and_ranges():
    today = date(2024, 3, 10)
    assert params.resolve_dates(None, None, today) == ("2024-03-04", "2024-03-10")
    assert params.resolve_dates("2024-03-09", "2024-03-01", today) == ("2024-03-04", "2024-03-10")
    assert params.resolve_dates("bad", "2024-03-05", today) == ("2024-03-04", "2024-03-05")
    assert params.range_for_key("yesterday", today) == (date(2024, 3, 9), date(2024, 3, 9))
    assert params.range_for_key("6months", today) == (today.fromordinal(today.toordinal() - 182), today)
    assert params.range_for_key("2024-01-01_2024-01-31", today) == (date(2024, 1, 1), date(2024, 1, 31))
    assert params.range_for_key("weird", today) == (date(2024, 3, 4), today)
    assert params.query_bounds("today", today) == ("2024-03-10", "2024-03-11")


def test_allowed_fields():
    assert "properties" not in S.allowed_fields("yes", False)
    assert "model" in S.allowed_fields("no", True) and "model" not in S.allowed_fields(None, True)


def test_resolve_scope_list_or_frame(spark):
    from tidemark.operators import scope
    rows = [(f"s{i}", "o1" if i % 2 else "o2", "n", ["a.com"], "free_tier", 1, None, "maybe", None, None) for i in range(6)]
    sites = spark.createDataFrame(rows, S.SITES)
    assert scope.resolve_scope(sites, "o1", " s1, ,s2,s3 ") == ["s1", "s3"]
    with pytest.raises(PermissionError):
        scope.resolve_scope(sites, "o1", "s2")
    big = scope.resolve_scope(sites, "o1", max_listed=2)
    assert not isinstance(big, list)
    ev = spark.createDataFrame([("s1", "2024-01-02"), ("s2", "2024-01-02"), ("s3", "2024-02-01")], "site_id string, dt string")
    got = sorted(r[0] for r in scope.scope(ev, big, "2024-01-01", "2024-01-31").collect())
    assert got == ["s1"]


def test_publish_once_keeps_first_copy(spark, scratch):
    import glob

    from tidemark.plans.jobs import publish_once
    target = scratch + "/table"
    publish_once(spark, target, lambda tmp: spark.range(3).write.parquet(tmp))
    publish_once(spark, target, lambda tmp: spark.range(10).write.parquet(tmp))  # already there: not rebuilt
    assert spark.read.parquet(target).count() == 3
    assert not glob.glob(target.replace("file:", "") + ".tmp-*")


def test_agent_rules_equal_plain_matching(spark):
    """The first rule whose pattern alone matches decides, whatever plain texts guard the patterns."""
    import re

    from tidemark.functions import agents

    odd = ["Edge/1", "EdgiOS/2.0 Version/1 Mobile Safari", "Opera/9.8", "OPR/7", "x Trident/7.0; rv:11.0", "MSIE 9.0", "bingbot/2", "YandexBot/3.0", "Tizen 2.4 TV",
           "SMART-TV", "Web0S Linux", "BRAVIA", "Android", "Android 9; SM-T510 Build", "Pixel 7 Pro Build/1", "Mi 9T)", "Redmi Note 8; x", "PlayStation 5", "Xbox One", "Xbox",
           "Nintendo Switch", "iPod; CPU OS 9_1", "Windows Phone OS 8.1", "Windows Phone 10", "CrOS x86_64 1.2", "Macintosh; Mac OS X", "Macintosh", "Chrome/", "; wv) x Chrome/5",
           "Android 1 Chrome/7 Mobile", "FxiOS/3", "UCBrowser/1 YaBrowser/2", "HeadlessChrome/9", "SamsungBrowser/4", "Ubuntu", "Linux", "", "none"]
    uas = odd + [f"{a} {b}" for a in odd[::3] for b in odd[1::4]]
    df = spark.createDataFrame([(u,) for u in uas], "u string")
    tables = {"b": agents.BROWSER_RULES, "o": agents.OS_RULES, "d": agents.DEVICE_RULES}
    frame = df.select("u", *[agents._rule_index(df["u"], t).alias(k) for k, t in tables.items()])
    for r in frame.collect():
        for k, t in tables.items():
            want = next((i for i, rule in enumerate(t, 1) if re.search(rule[0], r["u"])), 0)
            assert r[k] == want, (r["u"], k)
    # no regex without a plain text before it
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= plan.count("Contains(")
