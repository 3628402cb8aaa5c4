"""Small builders for hand-made event tables."""

from __future__ import annotations

from datetime import datetime

from tidemark import schema as S
from tidemark.operators import model

INITIAL_VIEW = S.view_struct(S.INITIAL_FIELDS)
EVENTS_VIEW = S.view_struct(S.COMMON_FIELDS)


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def initial_row(session, t, event="page_view", pathname="/", **kw):
    row = {f.name: None for f in S.INITIAL_FIELDS}
    row.update(site_id="s", dt=t[:10], event=event, pathname=pathname, session_id=session, timestamp=ts(t),
               properties=kw.pop("properties", "{}"))
    row.update(kw)
    return row


def event_row(session, t, event="click", pathname="/", **kw):
    row = {f.name: None for f in S.COMMON_FIELDS}
    row.update(site_id="s", dt=t[:10], event=event, pathname=pathname, session_id=session, timestamp=ts(t),
               properties=kw.pop("properties", "{}"))
    row.update(kw)
    return row


def tables(spark, initial_rows, event_rows):
    ini = spark.createDataFrame([tuple(r[f.name] for f in S.INITIAL_FIELDS) for r in initial_rows], INITIAL_VIEW)
    ev = spark.createDataFrame([tuple(r[f.name] for f in S.COMMON_FIELDS) for r in event_rows], EVENTS_VIEW)
    return ini, ev


def build(spark, initial_rows, event_rows):
    ini, ev = tables(spark, initial_rows, event_rows)
    return model.build(ini, ev)
