"""Plan-time parameters: date bounds and range keys (plain Python)."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta


def _parse(s: str | None) -> date | None:
    if not s:
        return None
    try:
        return datetime.fromisoformat(s.strip()).date()
    except ValueError:
        return None


def resolve_dates(start: str | None, end: str | None, today: date | None = None) -> tuple[str, str]:
    """Inclusive ``yyyy-MM-dd`` bounds: default the last 7 days; a bad bound
    falls back to its default; start after end -> both defaults."""
    today = today or datetime.utcnow().date()
    d_end, d_start = today, today - timedelta(days=6)
    s, e = _parse(start) or d_start, _parse(end) or d_end
    if s > e:
        s, e = d_start, d_end
    return s.isoformat(), e.isoformat()


RANGE_DAYS = {"7days": 6, "30days": 29, "90days": 89, "6months": 182, "12months": 364}
_CUSTOM = re.compile(r"^(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})$")


def range_for_key(key: str, today: date | None = None) -> tuple[date, date]:
    """today, yesterday, 7days, 30days, 90days, 6months, 12months, or
    ``YYYY-MM-DD_YYYY-MM-DD``; anything else means 7days."""
    today = today or datetime.utcnow().date()
    if key == "today":
        return today, today
    if key == "yesterday":
        y = today - timedelta(days=1)
        return y, y
    if key in RANGE_DAYS:
        return today - timedelta(days=RANGE_DAYS[key]), today
    m = _CUSTOM.match(key or "")
    if m:
        a, b = _parse(m.group(1)), _parse(m.group(2))
        if a and b:
            return a, b
    return today - timedelta(days=6), today


def query_bounds(key: str, today: date | None = None) -> tuple[str, str]:
    """Partition bounds for a range key; a range ending today also reads
    tomorrow's partition (client and UTC dates may differ)."""
    today = today or datetime.utcnow().date()
    a, b = range_for_key(key, today)
    if b == today:
        b = b + timedelta(days=1)
    return a.isoformat(), b.isoformat()
