"""Site creation and update in any order, URL paths as a browser writes them, JSON bodies with repeated keys."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import urls
from tidemark.functions.text import is_json, last_of_repeated_keys
from tidemark.operators import ingest, scope, sites

U = "site_id string, owner_sub string, updated_at string, name string, domains array<string>, plan string, allowed_fields array<string>, compliance_level string"


def site_table(spark):
    rows = [("a", "o1", "A", ["a.com"], "free_tier", 10, [], "maybe", None, None), ("b", "o2", "B", ["b.com"], "active_paid", 10, [], "no", None, None)]
    return spark.createDataFrame(rows, S.SITES)


def updates(spark, rows):
    return spark.createDataFrame(rows, U).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


GIVEN = [
    ("a", "o1", "2024-01-01 01:00:00", "one", None, None, None, None),
    ("a", "o1", "2024-01-01 02:00:00", " two ", None, None, None, "yes"),
    ("a", "o1", "2024-01-01 02:00:00", "also two", ["HTTP://X.com/p", "x.com"], None, None, None),
    ("a", "o1", "2024-01-01 00:30:00", "zero", None, "needs_payment", ["event"], None),
]


def test_updates_in_any_order_and_number_of_batches(spark):
    seen = set()
    for order in itertools.islice(itertools.permutations(GIVEN), 0, 24, 5):
        for cut in (0, 2):
            t = sites.update_sites(site_table(spark), updates(spark, list(order[:cut]) or [order[0]]))
            t = sites.update_sites(t, updates(spark, list(order[cut:]) + [order[0]]))  # one of them twice
            seen.add(str(sorted(map(str, t.collect()))))
    assert len(seen) == 1
    a = {r["site_id"]: r for r in t.collect()}
    assert (a["a"]["name"], a["a"]["domains"], a["a"]["plan"], a["a"]["allowed_fields"], a["a"]["compliance_level"]) == (
        "two", ["x.com"], "needs_payment", ["event"], "yes")
    assert str(a["a"]["updated_at"]) == "2024-01-01 02:00:00" and a["b"]["versions"] == {} and a["b"]["name"] == "B"


def test_update_checks(spark):
    t = "2024-01-01 01:00:00"
    rows = [("a", "o1", t, None, None, None, None, None), ("a", "o1", t, "  ", None, None, None, None), ("a", "o1", t, None, [], None, None, None),
            ("a", "o1", t, None, ["ok.com", " "], None, None, None), ("a", "o1", t, None, ["bad host"], None, None, None),
            ("a", "o1", t, None, None, "active_paid", None, None), ("a", "o1", t, None, None, None, ["x", None], None),
            ("a", "o1", t, None, None, None, None, "all"), ("a", "o2", t, "n", None, None, None, None), ("zz", "o1", t, "n", None, None, None, None),
            ("a", "o1", t, None, None, "free_tier", [], None)]
    for metered, plan in ((True, 200), (False, 400)):
        out = [r["status"] for r in sites.check_updates(site_table(spark), updates(spark, rows).withColumn("i", F.monotonically_increasing_id()), metered).orderBy("i").collect()]
        assert out == [400] * 5 + [plan] + [400] * 2 + [404] * 2 + [200]
    assert sites.update_sites(site_table(spark), updates(spark, [])).select(*S.SITES.names).collect() == site_table(spark).collect()


def test_create_sites(spark):
    rows = [("n1", "o", " N ", ["n.com"], None, None, "2024-01-02"), ("n1", "p", "M", ["m.com"], ["event"], "no", "2024-01-01"), ("a", "o", "A", ["a.com"], None, None, "2024-01-01"),
            ("n2", "o", "", ["n.com"], None, None, "2024-01-01"), ("n2", "o", "ok", ["n.com"], None, "no", "2024-01-03"), ("n3", "o", "x", ["n.com"], [None], None, "2024-01-01")]
    df = spark.createDataFrame(rows, "site_id string, owner_sub string, name string, domains array<string>, allowed_fields array<string>, compliance_level string, created_at string")
    out = sites.create_sites(site_table(spark), df.withColumn("created_at", F.col("created_at").cast("timestamp"))).collect()
    assert sorted((r["site_id"], r["name"], r["status"]) for r in out) == [("a", "A", 409), ("n1", "M", 201), ("n1", "N", 409), ("n2", "", 400), ("n2", "ok", 201), ("n3", "x", 400)]
    made = {r["name"]: r for r in out if r["status"] == 201}
    assert (made["M"]["plan"], made["M"]["request_allowance"], made["M"]["allowed_fields"], made["M"]["compliance_level"]) == ("free_tier", 10000, ["event"], "no")
    assert made["ok"]["allowed_fields"] == [] and made["ok"]["updated_at"] == made["ok"]["created_at"]


@pytest.mark.parametrize("url, path", [
    ("https://x.com/a b/x", "/a%20b/x"), ("https://x.com/a/../c", "/c"), ("https://x.com/a/./b/", "/a/b/"), ("https://x.com/a/b/..", "/a/"), ("https://x.com/..", "/"),
    ("https://x.com/../../a", "/a"), ("https://x.com/a/.", "/a/"), ("https://x.com/%2E%2e/b", "/b"), ("https://x.com/a/.%2E/b", "/b"), ("https://x.com/a//../b", "/a/b"),
    ("https://x.com/é/日本/😀", "/%C3%A9/%E6%97%A5%E6%9C%AC/%F0%9F%98%80"), ('https://x.com/"<>`{}', "/%22%3C%3E%60%7B%7D"), ("https://x.com/%zz%41", "/%zz%41"),
    ("https://x.com/...", "/..."), ("https://x.com/.a/b..", "/.a/b.."), ("https://x.com\\a\\..\\b", "/b"), ("https://x.com", "/"), ("https://x.com/a|b^c[d]", "/a|b^c[d]"),
    ("android-app://com.app/a b/..", "/a b/.."),
])
def test_paths_as_a_browser_writes_them(spark, url, path):
    df = urls.with_url_parts(spark.createDataFrame([(url,)], "u string"), "u", "p")
    assert df.select("p.path").first()[0] == path


def test_referer_is_normalised(spark):
    cfg = spark.createDataFrame([("a", "o", "n", [], "free_tier", 1000, [], "maybe", None, None)], S.SITES)
    rows = [("r1", "2024-01-01 10:00:00", "a", {}, '{"event":"page_view","session_id":"x","is_initial_event":true,"referer":"https://X.com/a b/../ü?q=1"}')]
    r = spark.createDataFrame(rows, "request_id string, t string, site string, headers map<string,string>, body string").select(
        "request_id", F.col("t").cast("timestamp").alias("received_at"), "site", "headers", F.lit(None).cast("string").alias("context_user_agent"), "body")
    row = ingest.enrich(ingest.validate(r, cfg)).first()
    assert (row["referer"], row["referer_domain"]) == ("https://x.com/%C3%BC", "x.com")


def test_repeated_keys_and_json_checks(spark):
    texts = {'{"a":1,"a":2}': True, '{"a":1} x': False, "{'a':1}": False, '{"a":NaN}': False, "[1": False, '"x"': True, "1,2": False, "": False, " [1, 2] ": True, "null": True}
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert {r[0]: r[1] for r in df.select("j", is_json(F.col("j"))).collect()} == texts
    m = spark.createDataFrame([('{"k":"1","l":"x","k":"2"}',), ('{"l":null}',), (None,)], "j string").select(
        last_of_repeated_keys(F.from_json("j", "map<string,string>")))
    assert [r[0] for r in m.collect()] == [{"k": "2", "l": "x"}, {"l": None}, None]
    cfg = spark.createDataFrame([("a", "o", "n", [], "free_tier", 1000, [], "maybe", None, None)], S.SITES)
    body = '{"event":"click","session_id":"x","session_id":"y","properties":{"k":"1","k":"2"}}'
    r = spark.createDataFrame([("r", "a", {}, body)], "request_id string, site string, headers map<string,string>, body string").select(
        "request_id", F.lit("2024-01-01 10:00:00").cast("timestamp").alias("received_at"), "site", "headers", F.lit(None).cast("string").alias("context_user_agent"), "body")
    row = ingest.process(r, cfg)[1].first()
    assert row["session_id"] == "y" and row["properties"] == {"k": "2"}
    view = spark.createDataFrame([('{"k":"1","k":"2"}',), ("{",)], "properties string")
    assert [r[0] for r in scope.typed_select(view).collect()] == ['{"k":"1","k":"2"}', None]
