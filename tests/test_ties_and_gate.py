"""Ties give one result in any input order; the allowance gate equals a plain ranking; the long report equals its parts."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import event_row, initial_row, tables
from tidemark.operators import flow, ingest, model, reports
from tidemark.operators.segments import Segment, apply_segments

T = "2024-01-01T10:00:00"


def tied_rows():
    """Two sessions whose rows tie in time: different paths, events and visit columns."""
    ini = [initial_row("s", T, pathname="/b", country="FR"), initial_row("s", T, pathname="/a", country="US"),
           initial_row("s", T, pathname="/a", country="DE", region="R"), initial_row("t", T, country=None), initial_row(None, T, country="IT")]
    ev = [event_row("s", T, event="page_view", pathname="/c"), event_row("s", T, pathname="/a"), event_row("t", T, event="page_view", pathname="/z"),
          event_row("t", T, event="page_view", pathname="/y"), event_row(None, T, event="page_view", pathname="/q")]
    return ini, ev


@pytest.mark.parametrize("hot", [False, True])
def test_ties_do_not_depend_on_input_order(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(model, "HOT_SESSION_ROWS", 1)
    seen = []
    for seed in range(3):
        ini, ev = tied_rows()
        random.Random(seed).shuffle(ini)
        random.Random(seed + 9).shuffle(ev)
        ini, ev = tables(spark, ini, ev)
        a = model.build(ini.repartition(1 + seed), ev.repartition(3 - seed))
        assert (a.hot is not None) == hot
        u = model.union_events(ini, ev)
        view = sorted(map(str, a.rows.collect()))
        pages = sorted(map(str, a.sessions.select("session_id", "entry_page", "exit_page", "country").collect()))
        fills = [sorted(map(str, model.fill_session(u, m).collect())) for m in ("first_row", "forward")]
        chain = sorted(map(str, flow.steps(a.event_rows(), None, a.hot).select("session_id", "node_id", "target_node").collect()))
        seen.append((view, pages, fills, chain))
    assert seen[0] == seen[1] == seen[2]
    first = {r["session_id"]: r for r in a.sessions.collect()}
    assert (first["s"]["entry_page"], first["s"]["exit_page"]) == ("/a", "/c") and first["t"]["exit_page"] == "/z"


def test_hot_and_plain_paths_agree_on_ties(spark, monkeypatch):
    def results():
        ini, ev = tables(spark, *tied_rows())
        a, u = model.build(ini, ev), model.union_events(ini, ev)
        return [sorted(map(str, df.collect())) for df in (
            a.rows, model.fill_session(u, "first_row"), model.fill_session(u, "forward"),
            flow.steps(a.event_rows(), None, a.hot).select("session_id", "node_id", "step_idx", "target_node"))]

    plain = results()
    monkeypatch.setattr(model, "HOT_SESSION_ROWS", 1)
    assert results() == plain


def test_mark_initial_flags_one_row(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "w"), ("a", 2, "v"), (None, 5, "u"), (None, 5, "u"), ("b", 7, None)]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    out = ingest.mark_initial(df.repartition(3), ["k"], [F.col("t")], "first").collect()
    assert sorted((str(r["k"]), r["v"]) for r in out if r["first"]) == [("None", "u"), ("a", "w"), ("b", None)] and len(out) == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_gate_equals_plain_ranking(spark, seed):
    rng = random.Random(seed)
    spread = [1, 10 ** 6, 3 * 10 ** 11][seed]  # all in a few microseconds, some seconds, some days
    allow = {"a": 37, "b": 0, "c": 1000, "d": 1, "e": -5}
    rows = [(f"r{i}", rng.choice("aaaaaabcde"), 1_700_000_000_000_000 + rng.randrange(5) * spread + rng.randrange(3), i % 9 != 0) for i in range(400)]
    df = spark.createDataFrame([(i, s, t, ok, allow[s]) for i, s, t, ok in rows], "request_id string, site string, t long, ok boolean, _allowance long")
    df = df.withColumn("received_at", F.timestamp_micros("t"))
    out = ingest.gate_allowance(df, F.col("ok"), "inside").select("request_id", "inside").collect()
    left, want = dict(allow), {}
    for i, s, t, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = ok and left[s] > 0
        left[s] -= bool(want[i])
    assert {r["request_id"]: r["inside"] for r in out} == want


def test_long_report_equals_its_parts(spark):
    ini, ev = tables(spark, [initial_row(f"s{i}", f"2024-01-01T10:{i:02d}:00", pathname=f"/p{i % 4}", country=[None, "FR", "US"][i % 3], region=[None, "Unknown", "R"][i % 3],
                                         browser=["B", None][i % 2], os="O", screen_width=["10", None][i % 2], screen_height="5", utm_campaign=[None, "c"][i % 2],
                                         properties='{"k":"v%d","it\'s":"w"}' % (i % 3)) for i in range(12)] + [initial_row(None, T, country="IT", pathname=" ")],
                     [event_row(f"s{i % 5}", f"2024-01-01T11:{i:02d}:00", event=["click", None, "page_view"][i % 3], properties='{"k":"v1"}') for i in range(30)]
                     + [event_row(None, T, properties='{"k":"v9"}')])
    a = model.build(ini, ev)
    for view in (a, apply_segments(a, [Segment("country", "FR")]), apply_segments(a, [Segment("country", "nowhere")])):
        got = sorted(map(str, (tuple(r) for r in reports.long_report(view, property_key="k").collect())))
        parts = {t: df for g in reports.BUNDLES for t, df in reports.bundle(view, g).items()} | {"properties": reports.property_values(view, "k")}
        want = []
        for t, df in parts.items():
            for r in df.collect():
                r = r.asDict()
                want.append(str((t, r["name"], r["value"], r.get("events"), r.get("percentage"))))
        assert got == sorted(want)
    assert len(reports.long_report(a, limit=1).collect()) == 12
    assert [tuple(r)[:3] for r in reports.property_values(a, "it's").collect()] == [("w", 12, 12)]
    assert apply_segments(a, [Segment("custom:it's", "w")]).sessions.count() == 12
    assert apply_segments(apply_segments(a, [Segment("country", "FR")]), [Segment("event", "click")]).sessions.count() == 2
