"""Stored session rollups give what all rows together give, whatever the batches, replays and merges."""

import random

import pytest
from helpers import INITIAL_VIEW, EVENTS_VIEW, event_row, initial_row
from pyspark.sql import functions as F

from tidemark.operators import model, stats
from tidemark.plans.rollups import SessionRollups


def some_rows(seed, n=160):
    """Rows of few sessions over three days and two sites, many at one time, some without session, path or time."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = f"2024-01-0{rng.randint(1, 3)} {rng.choice(['00:00:00', '00:59:59', '23:00:01'])}"
        kw = {"event": rng.choice(["page_view", "page_view", "click"]), "pathname": rng.choice(["/", "/a", "/b", " ", None]),
              "site_id": rng.choice(["s", "u"])}
        s = rng.choice([None, "", "x", "y", "z", "v"])
        if rng.random() < 0.3:
            out.append((True, initial_row(s, t, country=rng.choice(["DE", "FR", None]), referer_domain=rng.choice(["t.co", None]), **kw)))
        else:
            out.append((False, event_row(s, t, **kw)))
        if rng.random() < 0.05:
            out[-1][1]["timestamp"] = None
    return out


def view(spark, rows):
    ini = spark.createDataFrame([tuple(r[f.name] for f in INITIAL_VIEW.fields) for first, r in rows if first], INITIAL_VIEW)
    ev = spark.createDataFrame([tuple(r[f.name] for f in EVENTS_VIEW.fields) for first, r in rows if not first], EVENTS_VIEW)
    return model.build(ini, ev)


def shown(a):
    return stats.stats(a).collect(), sorted(map(str, a.sessions.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_replays_and_merges_equal_all_rows(spark, scratch, seed):
    rows = some_rows(seed)
    whole = view(spark, rows)
    roll = SessionRollups(spark, scratch, view(spark, []))
    for b in (2, 0, 1):
        roll.add(view(spark, rows[b::3]), b)
    want = shown(whole)
    assert shown(roll.analytics()) == want
    roll.compact("s", "2024-01-02")
    roll.add(view(spark, rows[1::3]), 1)  # replayed after the merge
    assert shown(roll.analytics()) == want
    for fmt in ("yyyy-MM-dd", "yyyy-MM-dd HH:00"):
        assert roll.timeseries(fmt).collect() == stats.timeseries(whole, fmt=fmt).collect()
    roll.add(view(spark, rows[1::3][:5]), 1)  # replayed with less
    assert shown(roll.analytics()) == shown(view(spark, rows[0::3] + rows[1::3][:5] + rows[2::3]))


def test_scoped_report_reads_matching_rollups_only(spark, scratch):
    rows = some_rows(3)
    roll = SessionRollups(spark, scratch, view(spark, []))
    roll.add(view(spark, rows[:100]), 0)
    roll.add(view(spark, rows[100:]), 1)
    where = (F.col("site_id") == "u") & (F.col("dt") == "2024-01-02")
    a = roll.analytics(where)
    files = a.sessions.inputFiles()
    assert files and all("/session_rollups/" in f and "site_id=u/dt=2024-01-02" in f for f in files)
    assert shown(a) == shown(view(spark, [r for r in rows if r[1]["site_id"] == "u" and r[1]["dt"] == "2024-01-02"]))


def test_empty_rollups(spark, scratch):
    roll = SessionRollups(spark, scratch, view(spark, []))
    assert roll.analytics().sessions.count() == 0 and stats.stats(roll.analytics()).first()["total_visits"] == 0
    roll.add(view(spark, []), 0)
    assert roll.analytics().sessions.count() == 0 and roll.timeseries().count() == 0
