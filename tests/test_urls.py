"""URL parts: browser-style parsing goldens (D13)."""

from pyspark.sql import functions as F

from tidemark.functions import urls

CASES = [
    # text, scheme, host, path, origin, valid
    ("https://ex.com?q=1#f", "https", "ex.com", "/", "https://ex.com", True),
    ("android-app://com.google.android.gm/", "android-app", "com.google.android.gm", "/",
     "android-app://com.google.android.gm", True),
    ("not a url", None, None, None, None, False),
    ("HTTPS://WWW.News.Example:443/a/b?x=1", "https", "www.news.example", "/a/b", "https://www.news.example", True),
    ("http:example.com/p", "http", "example.com", "/p", "http://example.com", True),
    ("https://user:pw@Host.com:8080/x y", "https", "host.com", "/x%20y", "https://host.com:8080", True),
    ("mailto:a@b.com", "mailto", "", "a@b.com", "null", True),
    ("https://", None, None, None, None, False),
    ("https://bad host/", None, None, None, None, False),
    ("$direct", None, None, None, None, False),
    ("  https://trim.me/  ", "https", "trim.me", "/", "https://trim.me", True),
    ("http://a.com:99999999/", None, None, None, None, False),
    (None, None, None, None, None, False),
]


def test_url_parts(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "u string")
    out = urls.with_url_parts(df, "u", "p").select("u", "p.*").collect()
    got = {r["u"]: (r["scheme"], r["host"], r["path"], r["origin"], r["valid"]) for r in out}
    for c in CASES:
        assert got[c[0]] == c[1:], c[0]


def test_query_param(spark):
    df = spark.createDataFrame([("http://a.com/?utm_source=news+letter&utm_medium=e%20mail&x=",)], "u string")
    p = urls.with_url_parts(df, "u", "p")
    r = p.select(urls.query_param(F.col("p")["query"], "utm_source").alias("s"),
                 urls.query_param(F.col("p")["query"], "utm_medium").alias("m"),
                 urls.query_param(F.col("p")["query"], "x").alias("x"),
                 urls.query_param(F.col("p")["query"], "utm_term").alias("t")).first()
    assert (r["s"], r["m"], r["x"], r["t"]) == ("news letter", "e mail", None, None)


def test_asked_parts_only(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "u string")
    some = urls.with_many_url_parts(df, {"p": "u", "r": "u"}, {"r": ["path", "valid"]}).select("p.*", "r").collect()
    assert all(tuple(x["r"]) == (x["path"], x["valid"]) and x["r"].asDict().keys() == {"path", "valid"} for x in some)
    assert "encode(" not in urls.with_url_parts(df, "u", "p", ["host", "valid"])._jdf.queryExecution().optimizedPlan().toString()
