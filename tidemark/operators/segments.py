"""Segments: keep whole sessions that have at least one row meeting a condition.

Several segments are ANDed; each may be met by a different row of the
session.  A row with a null session_id never matches once any segment is set
(``NULL IN (...)`` is not true).

Plan: a condition on a visit column (constant within a session after the
fill) or on channel/source is checked on the session table directly; a
condition on an event column (event, pathname, properties, timestamp) becomes
one ``bool_or`` per segment in the same grouped aggregate that makes the session
table, so segments need no second pass over the rows (only a view that was
narrowed before gets the flags from an aggregate of their own).  The narrowed
session table narrows the view through the join that builds it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .model import SK, SN, Analytics, session_table
from .reports import property_value


@dataclass(frozen=True)
class Segment:
    """A filter spec: ``type`` names the column (or ``custom:<key>``, ``screen_size``,
    ``channel``, ``referer_domain``, ``source``); ``db_column`` / ``db_value``
    replace the column or the compared value."""

    type: str
    value: Any
    label: str | None = None
    db_column: str | None = None
    db_value: Any = None


EVENT_LEVEL = set(S.EVENT_COLUMNS)


def condition(seg: Segment) -> tuple[Column, bool]:
    """(row condition, needs event rows?) for one segment."""
    value = seg.db_value if seg.db_value is not None else seg.value
    lit = F.lit(value)
    t = seg.type
    if t.startswith("custom:"):
        key = t.split(":", 1)[1]
        return property_value(key) == lit, True
    if t == "screen_size":
        return F.concat(F.col("screen_width"), F.lit("x"), F.col("screen_height")) == lit, False
    if t in ("channel", "source"):
        return F.col(t) == lit, False
    if t == "referer_domain":
        d = F.coalesce(F.col("referer_domain"), F.lit("$direct"))
        if value == "$direct":
            return d == F.lit("$direct"), False
        return F.regexp_replace(d, r"^www\.", "") == lit, False
    col = seg.db_column or t
    return F.col(col) == lit, col in EVENT_LEVEL


def dedupe(segments: list[Segment]) -> list[Segment]:
    """No two segments with the same (type, value); first one kept."""
    seen, out = set(), []
    for s in segments:
        k = (s.type, repr(s.value))
        if k not in seen:
            seen.add(k)
            out.append(s)
    return out


def apply_segments(a: Analytics, segments: list[Segment]) -> Analytics:
    """Narrow the view to sessions meeting every segment (identity when none)."""
    segments = dedupe(list(segments))
    if not segments:
        return a
    sess_conds, ev_conds = [], []
    for seg in segments:
        c, ev = condition(seg)
        (ev_conds if ev else sess_conds).append(c)
    flags = {f"_m{i}": c for i, c in enumerate(ev_conds)}
    if flags and not a.narrowed:
        sessions = session_table(a.base, list(a.static), a.seq_col, flags)
        for name in flags:
            sessions = sessions.filter(F.col(name))
        sessions = sessions.drop(*flags)
    elif flags:
        met = a.base.groupBy(SK, SN).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
        for name in flags:
            met = met.filter(F.col(name))
        sessions = a.sessions.join(met.select(SK, SN), [SK, SN], "left_semi")
    else:
        sessions = a.sessions
    sessions = sessions.filter(~F.col(SN))
    for c in sess_conds:
        sessions = sessions.filter(c)
    return a.with_sessions(sessions)


# Report row -> segment, as the dashboard cards build them (D6: sources keep
# type referer_domain).
CARD_SEGMENT_TYPE = {
    "channels": "channel",
    "sources": "referer_domain",
    "campaigns": "utm_campaign",
    "topPages": "pathname",
    "entryPages": "pathname",
    "exitPages": "pathname",
    "countries": "country",
    "regions": "region",
    "browsers": "browser",
    "os": "os",
    "screenSizes": "screen_size",
    "events": "event",
}


def segment_for(card: str, name: str, property_key: str | None = None) -> Segment:
    if card == "properties":
        if not property_key:
            raise ValueError("a property segment needs the property key")
        return Segment(f"custom:{property_key}", name, label=name)
    if card not in CARD_SEGMENT_TYPE:
        raise KeyError(f"no segment for card {card!r}")
    return Segment(CARD_SEGMENT_TYPE[card], name, label=name)
