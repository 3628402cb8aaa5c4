"""The chunked window chain for hot sessions equals the one-chunk chain."""

from conftest import SF001
from tidemark.operators import flow, model
from tidemark.sources import fixtures


def _key(df):
    return sorted((r["session_id"], r["event_id"], r["node_id"], r["step_idx"], r["target_node"])
                  for r in df.select("session_id", "event_id", "node_id", "step_idx", "target_node").collect())


def test_chunked_equals_plain(spark):
    ini, ev = fixtures.load(spark, SF001)
    a = model.build(ini, ev, seq_col=fixtures.SEQ)
    plain = flow.steps(a.event_rows(), a.seq_col)
    every = a.sessions.select(model.SK, model.SN)  # treat every session as hot
    for chunk in (60_000_000, 3_600_000_000):    # one minute, one hour
        chunked = flow.steps(a.event_rows(), a.seq_col, hot=every, chunk_us=chunk)
        assert _key(chunked) == _key(plain)


def test_chunk_borders_dedupe(spark):
    from helpers import build, event_row, initial_row
    # /a /a | /a /b | /b /c  with one-second chunks: repeats straddle the borders
    a = build(spark, [initial_row("h", "2024-01-01T10:00:00.1", pathname="/a")], [
        event_row("h", "2024-01-01T10:00:00.5", event="page_view", pathname="/a"),
        event_row("h", "2024-01-01T10:00:01.1", event="page_view", pathname="/a"),
        event_row("h", "2024-01-01T10:00:01.5", event="page_view", pathname="/b"),
        event_row("h", "2024-01-01T10:00:02.1", event="page_view", pathname="/b"),
        event_row("h", "2024-01-01T10:00:02.5", event="page_view", pathname="/c"),
    ])
    hot = a.sessions.select(model.SK, model.SN)
    got = sorted((r["node_id"], r["target_node"]) for r in flow.steps(a.event_rows(), hot=hot).collect())
    m = flow.PAGE_MARK
    assert got == [(m + "/a #1", m + "/b #2"), (m + "/b #2", m + "/c #3"), (m + "/c #3", None)]


def test_salted_join_equals_plain(spark, monkeypatch):

    from tidemark.operators.segments import Segment, apply_segments
    ini, ev = fixtures.load(spark, SF001)
    a = model.build(ini, ev, seq_col=fixtures.SEQ)
    seg = [Segment("channel", "Social")]
    cols = ["session_id", "event_id", "country", "channel"]
    want_rows = sorted(tuple(r) for r in a.rows.select(*cols).collect())
    want_seg = sorted(tuple(r) for r in apply_segments(a, seg).event_rows().select("session_id", "event_id").collect())
    want_links = sorted(tuple(r) for r in flow.transitions(a).collect())
    monkeypatch.setattr(model, "HOT_SESSION_ROWS", 2)  # nearly every session is hot now
    a = model.build(ini, ev, seq_col=fixtures.SEQ)      # fresh model: plans built under the new threshold
    assert a.hot is not None and a.hot.count() > 0
    assert "_salt" in a.rows._jdf.queryExecution().analyzed().toString()
    assert sorted(tuple(r) for r in a.rows.select(*cols).collect()) == want_rows
    got_seg = apply_segments(a, seg).event_rows().select("session_id", "event_id").collect()
    assert sorted(tuple(r) for r in got_seg) == want_seg
    assert sorted(tuple(r) for r in flow.transitions(a).collect()) == want_links


def test_forward_fill_chunked_equals_plain(spark, monkeypatch):
    from helpers import event_row, initial_row, tables
    ini, ev = tables(spark, [initial_row("s", "2024-01-01T10:00:01", country="FR", region="R1"),
                             initial_row("t", "2024-01-01T10:00:00")],
                     [event_row("s", "2024-01-01T10:00:00"), event_row("s", "2024-01-01T10:00:02.5"),
                      event_row("s", "2024-01-01T10:00:04"), event_row("t", "2024-01-01T10:00:03")])
    u = model.union_events(ini, ev)
    cols = ["session_id", "timestamp", "country", "region"]
    plain = sorted(tuple(r) for r in model.fill_session(u, "forward").select(*cols).collect())
    monkeypatch.setattr(model, "HOT_SESSION_ROWS", 1)   # both sessions hot: one-second chunks
    chunked = sorted(tuple(r) for r in model.fill_session(u, "forward").select(*cols).collect())
    assert chunked == plain
    assert [r[2] for r in plain if r[0] == "s"] == [None, "FR", "FR", "FR"]
