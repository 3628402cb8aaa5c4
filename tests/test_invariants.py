
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tidemark.operators import flow, model, reports
from tidemark.operators.segments import Segment, apply_segments
from tidemark.sources import fixtures


@pytest.fixture(scope="module")
def a(spark):
    ini, ev = fixtures.load(spark, SF01)
    return model.build(ini, ev, seq_col=fixtures.SEQ).persist()


def _total(df):
    return df.agg(F.sum("value")).first()[0] or 0


def test_entry_exit_sums(a):
    with_page = a.event_rows().filter(model.real_page()).select("session_id").distinct().count()
    assert _total(reports.entry_pages(a)) == _total(reports.exit_pages(a)) == with_page


def test_browsers_cover_all_sessions(a):
    assert _total(reports.browsers(a)) == a.sessions.count()


def test_filled_columns_constant_per_session(a):
    cols = ["country", "region", "browser", "os", "referer_domain", "utm_campaign", "channel", "source", "dt"]
    per = a.rows.groupBy("session_id").agg(*[F.count_distinct(F.coalesce(F.col(c), F.lit("<null>"))).alias(c)
                                             for c in cols])
    assert per.filter(" OR ".join(f"{c} > 1" for c in cols)).count() == 0


def _ids(x):
    return {r[0] for r in x.sessions.select("session_id").collect()}


def test_segments_commute_idempotent_never_add(a):
    s1, s2 = Segment("channel", "Social"), Segment("event", "purchase")
    both = _ids(apply_segments(a, [s1, s2]))
    assert both == _ids(apply_segments(a, [s2, s1]))
    assert both == _ids(apply_segments(apply_segments(a, [s1]), [s2]))
    assert _ids(apply_segments(a, [s1, s1])) == _ids(apply_segments(a, [s1]))
    assert both <= _ids(apply_segments(a, [s1])) <= _ids(a)


def test_flow_has_no_self_pair(a):
    t = flow.transitions(a)
    assert t.filter(F.col("source_node") == F.col("target_node")).count() == 0
    # every pair goes to the next step number
    num = lambda c: F.regexp_extract(F.col(c), r" #(\d+)$", 1).cast("int")
    assert t.filter(num("target_node") != num("source_node") + 1).count() == 0
