"""Registered queries equal their DuckDB twins (a representative subset, sf0.001).

The full set (all 114) runs with ``python tools/compare.py /root/testdata/sf0.01``.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import TABLES, rows_of  # noqa: E402
from conftest import SF001  # noqa: E402

KEYS = [
    "mdl_analytics_view", "mdl_forward_fill", "agg_stats", "agg_timeseries_hourly", "agg_property_keys",
    "rpt_channels", "rpt_entry_pages", "rpt_browsers", "rpt_screen_sizes", "rpt_events", "rpt_property_values",
    "rpt_dashboard", "seg_apply", "seg_custom", "seg_referer_domain", "flow_transitions", "flow_nodes",
    "ing_status", "ing_initial_projection", "ing_user_agent", "ing_referer", "ing_utm",
    "src_events", "snk_rejects", "qry_partition_filter", "use_meter", "use_summary", "bil_deactivate",
    "bil_payment_events", "dim_sites_clean",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[key](spark, SF001)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(oracle_sql()[key])
    d_cols, d_rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows, 9) == rows_of(d_cols, d_rows, 9)
