"""Plan shape checks: pruning, pushdown, no Python in the hot path, shuffle counts."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from conftest import SF001
from tidemark import schema as S
from tidemark.operators import flow, ingest, model, reports, scope, stats
from tidemark.operators.segments import Segment, apply_segments
from tidemark.sources import fixtures
from tidemark.sources import lake as src
from tidemark.plans.jobs import ingest_to_lake
from tidemark.sources.lakelog import names_in


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def analytics(spark):
    ini, ev = fixtures.load(spark, SF001)
    return model.build(ini, ev, seq_col=fixtures.SEQ)


def test_no_python_udf_anywhere(spark):
    a = analytics(spark)
    seg = apply_segments(a, [Segment("channel", "Social"), Segment("pathname", "/p/3")])
    frames = [a.rows, stats.stats(seg), reports.long_report(seg), flow.flow_links(seg),
              ingest.process(fixtures.requests(spark, SF001), fixtures.sites(spark), metered=True)[0]]
    for df in frames:
        p = plan(df)
        assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_reads_only_needed_columns(spark):
    a = analytics(spark)
    p = plan(reports.channels(a))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", a.sessions._jdf.queryExecution().executedPlan().toString())
    txt = " ".join(schemas) + p
    assert "value:" not in txt  # the supplied `value` column is never read


def test_segmented_view_has_one_big_exchange(spark):
    a = analytics(spark)
    seg = apply_segments(a, [Segment("channel", "Social"), Segment("event", "purchase")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = seg.rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the event rows are shuffled once by the session key; the other exchanges carry
    # partial aggregates (one row per session per map task) or the adapter's keys
    assert p.count("Exchange hashpartitioning(_sk") >= 1


def test_partition_filters_reach_the_scan(spark, scratch):
    req = fixtures.requests(spark, SF001)
    ingest_to_lake(spark, req, fixtures.sites(spark), scratch, 0)
    ev = scope.scope(src.read_events(spark, scratch), ["site-0"], "2024-01-03", "2024-01-09")
    p = plan(ev.select("session_id"))
    assert "PartitionFilters: [isnotnull(dt" in p and "site_id" in p.split("PartitionFilters:")[1].split("]")[0]
    files = [r[0] for r in ev.select(F.input_file_name()).distinct().collect()]
    assert files and all("site_id=site-0/" in f for f in files)
    assert all("2024-01-03" <= f.split("dt=")[1][:10] <= "2024-01-09" for f in files)


def test_allowance_gate_ranks_no_site_as_a_whole(spark):
    req = fixtures.requests(spark, SF001)
    c = ingest.validate(req, fixtures.sites(spark), metered=True)
    p = plan(c)
    # windows by site alone run over counts (days, seconds of a day, microseconds of a second); raw requests are only
    # ranked inside one (site, microsecond)
    specs = re.findall(r"row_number\(\) windowspecdefinition\((site#[^)]*)\)", p)
    assert specs and all(re.match(r"site#\d+, _us#", w) for w in specs)
    assert "Exchange hashpartitioning(request_id" not in p


def test_checks_run_on_all_requests_twice(spark, scratch):
    """Once for the allowance gate's counts, shared by its levels, and once for the statuses."""
    fixtures.requests(spark, SF001).write.parquet(scratch)
    c = ingest.validate(src.read_requests(spark, scratch, fmt="parquet"), fixtures.sites(spark), metered=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(c)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # counts, statuses, and twice the rows of the cut seconds
    assert p.count("FileScan parquet") == 4 and "ReusedExchange" in p
    # the check reads a referer's host only: its path is not cleaned
    assert "encode(" not in p


def scans(df) -> int:
    return plan(df).count("FileScan parquet")


def test_session_model_scans_and_shuffles_rows_once(spark, scratch):
    ini, ev = fixtures.load(spark, SF001)
    ini.write.parquet(scratch + "/i")
    ev.write.parquet(scratch + "/e")
    a = model.build(spark.read.parquet(scratch + "/i"), spark.read.parquet(scratch + "/e"), seq_col=fixtures.SEQ)
    view, links = a.rows, flow.transitions(a)
    assert scans(view) == 2 and plan(view).count("Exchange hashpartitioning(") == 1 and "Join" not in plan(view)
    assert scans(links) == 2 and plan(links).count("Exchange hashpartitioning(_sk") == 1 and "Join" not in plan(links)
    narrowed = apply_segments(a, [Segment("channel", "Social"), Segment("event", "purchase")])
    assert scans(reports.channels(narrowed)) == 2  # the flags come with the session table
    assert scans(narrowed.rows) == 4               # the session table, and the rows of the sessions it keeps
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # after exchange reuse each table is scanned once: for both parts of the numbers, and once per pass of the long report
        assert scans(stats.stats(a)) == 2
        assert scans(reports.long_report(a)) == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ingest_deals_no_requests_by_site(spark, scratch, monkeypatch):
    """A few busy sites must not gather a batch's requests in as many tasks, though allowances come from a ledger."""
    rows = [(f"r{i}", datetime(2024, 1, 1, 0, 0, i), f"site-{i % 3}", {"referer": f"https://site-{i % 3}.example/"}, None, '{"event": "e"}') for i in range(9)]
    seen = []

    def watched(*args, _real=ingest.pre_check, **kw):
        seen.append(_real(*args, **kw))
        return seen[-1]

    monkeypatch.setattr(ingest, "pre_check", watched)
    assert ingest_to_lake(spark, spark.createDataFrame(rows, S.REQUEST), fixtures.sites(spark), scratch, 0) == {"202": 9}
    assert len(seen) == 1 and "hashpartitioning(site#" not in plan(seen[0]) and not seen[0].is_cached
    assert "_stage" not in names_in(spark, scratch) or names_in(spark, scratch + "/_stage") == []
