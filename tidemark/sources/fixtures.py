"""Adapter: the supplied ``events`` table -> the product's two event tables.

The supplied table (event_id, ts, user_id, event_type, value, props) has no
session, path or referer.  They are derived deterministically: a session is
one user on one UTC day, the site is ``user_id % 3``, the path comes from the
``k`` property, and visit attributes of the first event follow fixed rules on
``user_id``.  ``event_id`` is kept as the tie-breaking sequence column.

``ADAPTER_SQL`` is the same adapter as DuckDB text, used by the oracle checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import mark_initial

SEQ = "event_id"


COMMON_OUT = ["site_id", "dt", "event", "pathname", "session_id", "timestamp", "properties", "event_id"]


def _case_all(key: Column, mapping: dict[int, str | None], default: str | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        val = F.lit(v).cast("string")
        out = F.when(key == k, val) if out is None else out.when(key == k, val)
    return out.otherwise(F.lit(default).cast("string"))


def adapt_flagged(raw: DataFrame) -> DataFrame:
    """Supplied events -> one frame of all adapted events with ``is_initial``
    (visit columns set on first events only)."""
    dt = F.date_format(F.col("ts"), "yyyy-MM-dd")
    kk = F.get_json_object(F.col("props"), "$.k").cast("int")
    b = raw.select(
        F.concat(F.lit("site-"), (F.col("user_id") % 3).cast("string")).alias("site_id"),
        dt.alias("dt"),
        F.when(F.col("event_type") == "view", F.lit("page_view")).otherwise(F.col("event_type")).alias("event"),
        F.concat(F.lit("/p/"), (kk % 10).cast("string")).alias("pathname"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), dt).alias("session_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("props").alias("properties"),
        F.col("event_id"),
        F.col("user_id"),
    )
    b = mark_initial(b, ["user_id", "dt"], [F.col("timestamp"), F.col("event_id")], "is_initial")
    u = F.col("user_id")
    first_only = F.col("is_initial")

    def _case(key, mapping, default=None):
        return F.when(first_only, _case_all(key, mapping, default))

    first = b.select(
        *[c for c in b.columns if c not in ("user_id",)],
        _case(u % 8, {0: "www.google.com", 1: "google.com", 2: "facebook.com", 3: "$direct", 4: None,
                      5: "mail.google.com", 6: "WWW.News.example"}, "t.co").alias("referer_domain"),
        _case(u % 7, {0: "cpc", 1: "email", 2: "social"}).alias("utm_medium"),
        _case(u % 11, {0: "newsletter"}).alias("utm_source"),
        _case(u % 5, {0: "spring", 1: "summer"}).alias("utm_campaign"),
        _case(u % 6, {0: None, 1: "France"}, "United States").alias("country"),
        _case(u % 6, {2: "Utah", 3: "Ohio"}).alias("region"),
        _case(u % 4, {0: "Chrome", 1: "Safari", 2: "Firefox"}).alias("browser"),
        _case(u % 3, {0: "Windows", 1: "iOS"}).alias("os"),
        _case(u % 4, {0: "1920", 1: "390"}).alias("screen_width"),
        _case(u % 4, {0: "1080", 1: "844"}).alias("screen_height"),
    )
    return first


def adapt(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supplied events -> (initial_events, events) in report-layer form."""
    return split_flagged(adapt_flagged(raw))


def split_flagged(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flagged events (``adapt_flagged``) -> (initial_events, events)."""
    first = flagged.filter("is_initial").drop("is_initial")
    rest = flagged.filter(~F.col("is_initial")).select(*COMMON_OUT)
    return first, rest


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return adapt(raw_events(spark, sf_dir))


# DuckDB twin of ``adapt``: defines CTEs ``fx_all``, ``initial_events``, ``events_t``.
ADAPTER_SQL = """
fx_k AS (SELECT *, strftime(ts, '%Y-%m-%d') AS dt,
                CAST(json_extract_string(props, '$.k') AS INT) AS kk FROM events),
fx_b AS (SELECT concat('site-', CAST(user_id % 3 AS VARCHAR)) AS site_id, dt,
        CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS event,
        concat('/p/', CAST(kk % 10 AS VARCHAR)) AS pathname,
        concat('u', CAST(user_id AS VARCHAR), '-', dt) AS session_id,
        ts AS "timestamp", props AS properties, event_id, user_id,
        row_number() OVER (PARTITION BY user_id, dt ORDER BY ts, event_id) AS rn FROM fx_k),
fx_all AS (SELECT *, rn = 1 AS is_initial,
  CASE WHEN rn=1 THEN CASE user_id % 8 WHEN 0 THEN 'www.google.com' WHEN 1 THEN 'google.com'
    WHEN 2 THEN 'facebook.com' WHEN 3 THEN '$direct' WHEN 4 THEN NULL WHEN 5 THEN 'mail.google.com'
    WHEN 6 THEN 'WWW.News.example' ELSE 't.co' END END AS referer_domain,
  CASE WHEN rn=1 THEN CASE user_id % 7 WHEN 0 THEN 'cpc' WHEN 1 THEN 'email' WHEN 2 THEN 'social' END END AS utm_medium,
  CASE WHEN rn=1 THEN CASE user_id % 11 WHEN 0 THEN 'newsletter' END END AS utm_source,
  CASE WHEN rn=1 THEN CASE user_id % 5 WHEN 0 THEN 'spring' WHEN 1 THEN 'summer' END END AS utm_campaign,
  CASE WHEN rn=1 THEN CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'France' ELSE 'United States' END END AS country,
  CASE WHEN rn=1 THEN CASE user_id % 6 WHEN 2 THEN 'Utah' WHEN 3 THEN 'Ohio' END END AS region,
  CASE WHEN rn=1 THEN CASE user_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Firefox' END END AS browser,
  CASE WHEN rn=1 THEN CASE user_id % 3 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' END END AS os,
  CASE WHEN rn=1 THEN CASE user_id % 4 WHEN 0 THEN '1920' WHEN 1 THEN '390' END END AS screen_width,
  CASE WHEN rn=1 THEN CASE user_id % 4 WHEN 0 THEN '1080' WHEN 1 THEN '844' END END AS screen_height
FROM fx_b)
"""


# ---------------------------------------------------------------- requests
# Sample user agents with the fields the rule table should give
# (browser, browser_version, os, os_version, device, model, manufacturer).
UA_SAMPLES = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) "
     "Chrome/120.0.6099.109 Safari/537.36",
     ("Chrome", "120.0.6099.109", "Windows", "10", "desktop", None, None)),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_1_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) "
     "Version/17.1.2 Mobile/15E148 Safari/604.1",
     ("Mobile Safari", "17.1.2", "iOS", "17.1.2", "mobile", "iPhone", "Apple")),
    ("Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
     ("Firefox", "121.0", "Ubuntu", None, "desktop", None, None)),
    ("Mozilla/5.0 (Linux; Android 14; SM-S918B) AppleWebKit/537.36 (KHTML, like Gecko) "
     "Chrome/120.0.6099.144 Mobile Safari/537.36",
     ("Mobile Chrome", "120.0.6099.144", "Android", "14", "mobile", "SM-S918B", "Samsung")),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) "
     "Version/17.2 Safari/605.1.15",
     ("Safari", "17.2", "Mac OS", "10.15.7", "Apple Macintosh", "Macintosh", "Apple")),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) "
     "Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.91",
     ("Edge", "120.0.2210.91", "Windows", "10", "desktop", None, None)),
    ("Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) "
     "CriOS/119.0.6045.169 Mobile/15E148 Safari/604.1",
     ("Mobile Chrome", "119.0.6045.169", "iOS", "16.6", "tablet", "iPad", "Apple")),
    ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
     ("Bot", "2.1", None, None, "desktop", None, None)),
]

# Request faults by rule on event_id % 101 (the rest are well-formed).
FAULTS = {7: "no_site", 13: "unknown_site", 17: "foreign_referer", 19: "bad_referer", 23: "no_body", 29: "bad_json"}
FAULT_MOD = 101

# Site dimension for the fixture sites: one per privacy level; the first two have an allowance
# above any data size, so their requests all pass the gate at every scale; site-2 is metered tight.
UNMETERED = 10**12
SITE_ROWS = [
    ("site-0", "owner-a", "Shop", ["site-0.example"], "free_tier", UNMETERED, "yes"),
    ("site-1", "owner-a", "Blog", ["site-1.example"], "free_tier", UNMETERED, None),
    ("site-2", "owner-b", "News", ["site-2.example", "www.site-2.example"], "needs_payment", 500, "no"),
]


def sites(spark: SparkSession) -> DataFrame:
    """The fixture site table, built from literals (a plan with known size, as a
    stored dimension table would have)."""
    from .. import schema as S
    structs = []
    for sid, own, name, doms, plan, allow, lvl in SITE_ROWS:
        vals = {"site_id": sid, "owner_sub": own, "name": name, "domains": doms, "plan": plan,
                "request_allowance": allow, "allowed_fields": [], "compliance_level": lvl,
                "created_at": None, "updated_at": None}
        structs.append(F.struct(*[
            (F.array(*[F.lit(x) for x in vals[f.name]]) if isinstance(vals[f.name], list) else F.lit(vals[f.name]))
            .cast(f.dataType).alias(f.name) for f in S.SITES.fields
        ]))
    return spark.range(1).select(F.inline(F.array(*structs)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker requests built from the adapted events, with rule-based faults.

    Bodies are JSON text of the adapted event; first events also carry screen
    sizes (as numbers), a referer (a page URL when ``pages`` has one for the
    event id, else one made from the adapted domain), utm fields and a page URL
    whose query holds utm fields the body lacks.
    """
    from .. import schema as S
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    u = adapt_flagged(raw).withColumnRenamed("is_initial", "_init")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id"), F.col("url").alias("_page_url"))
    u = u.join(pages, u["event_id"] == pages["page_id"], "left").drop("page_id")
    fault = F.col("event_id") % FAULT_MOD
    ua = F.element_at(F.array(*[F.lit(x[0]) for x in UA_SAMPLES]),
                      (F.col("event_id") % len(UA_SAMPLES) + 1).cast("int"))
    host = F.concat(F.col("site_id"), F.lit(".example"))
    referer_header = (
        F.when(fault == 17, F.lit("https://evil.example/x"))
        .when(fault == 19, F.lit("not a url"))
        .otherwise(F.concat(F.lit("https://"), host, F.col("pathname")))
    )
    body_referer = F.when(
        F.col("_init"),
        F.when(F.col("_page_url").isNotNull(), F.col("_page_url"))
        .when(F.col("referer_domain").isNull() | (F.col("referer_domain") == "$direct"), F.lit("$direct"))
        .otherwise(F.concat(F.lit("https://"), F.col("referer_domain"), F.lit("/from?q=1#frag"))),
    )
    page_url = F.when(
        F.col("_init") & F.col("utm_campaign").isNull(),
        F.concat(F.lit("https://"), host, F.col("pathname"), F.lit("?utm_campaign=fall+sale&utm_term=x%20y")),
    )
    body_struct = F.struct(
        F.col("event").alias("event"),
        F.col("pathname").alias("pathname"),
        F.col("session_id").alias("session_id"),
        F.when(F.col("_init"), F.lit(True)).alias("is_initial_event"),
        F.from_json(F.col("properties"), S.PROPERTIES_TYPE).alias("properties"),
        F.col("screen_height").cast("int").alias("screen_height"),
        F.col("screen_width").cast("int").alias("screen_width"),
        body_referer.alias("referer"),
        F.col("utm_source").alias("utm_source"),
        F.col("utm_campaign").alias("utm_campaign"),
        F.col("utm_medium").alias("utm_medium"),
        page_url.alias("url"),
    )
    body = F.when(fault == 23, F.lit(None).cast("string")).when(fault == 29, F.lit('{"event": ')).otherwise(
        F.to_json(body_struct))
    headers = F.create_map(
        F.lit("referer"), referer_header,
        F.lit("origin"), F.concat(F.lit("https://"), host),
        F.lit("user-agent"), ua,
        F.lit("cloudfront-viewer-country-name"), F.col("country"),
        F.lit("cloudfront-viewer-country-region-name"), F.col("region"),
        F.lit("cloudfront-viewer-country-region"), F.when(F.col("region") == "Utah", F.lit("UT")),
        F.lit("cloudfront-viewer-city"), F.when(F.col("region") == "Utah", F.lit("Lehi")),
        F.lit("cloudfront-viewer-time-zone"), F.when(F.col("country") == "France", F.lit("Europe/Paris")),
    )
    site = F.when(fault == 7, F.lit(None).cast("string")).when(fault == 13, F.lit("site-unknown")).otherwise(
        F.col("site_id"))
    return u.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.col("timestamp").alias("received_at"),
        site.alias("site"),
        headers.alias("headers"),
        F.lit(None).cast("string").alias("context_user_agent"),
        body.alias("body"),
    )


# ---------------------------------------------------------------- site, preference and payment tables
# One site per row of the supplied ``pages`` table, with rule-based owners,
# plans, allowances and levels; owners' preferences, charge outcomes and
# payment events follow rules on the owner / page number.
N_OWNERS = 7


def page_sites_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site rows as a user would submit them (domains as URLs or bare hosts, some bad)."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pid = F.col("page_id")
    bare = F.regexp_replace(F.col("url"), r"^[a-z]+://", "")
    domains = (
        F.when(pid % 11 == 0, F.array(F.col("url"), F.lit(" ")))
        .when(pid % 13 == 0, F.array(F.lit("bad host.example")))
        .when(pid % 17 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.col("url"), bare, F.upper(bare)))
    )
    return p.select(
        F.concat(F.lit("ps-"), pid.cast("string")).alias("site_id"),
        F.concat(F.lit("owner-"), (pid % N_OWNERS).cast("string")).alias("owner_sub"),
        F.when(pid % 19 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  Site "), pid.cast("string"), F.lit(" "))).alias("name"),
        domains.alias("domains"),
        F.when(pid % 3 == 0, F.lit("needs_payment")).when(pid % 3 == 1, F.lit("free_tier")).otherwise(F.lit("active_paid")).alias("plan"),
        ((pid * 37) % 20000 - 5000).cast("bigint").alias("request_allowance"),
        F.array().cast("array<string>").alias("allowed_fields"),
        F.when(pid % 5 == 0, F.lit("yes")).when(pid % 5 == 1, F.lit("maybe")).when(pid % 5 == 2, F.lit("no"))
        .when(pid % 5 == 3, F.lit(None).cast("string")).otherwise(F.lit("bogus")).alias("compliance_level"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def page_prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference row per owner seen in the page sites."""
    owners = page_sites_raw(spark, sf_dir).select("owner_sub").distinct()
    n = F.regexp_extract(F.col("owner_sub"), r"(\d+)$", 1).cast("int")
    return owners.select(
        F.col("owner_sub").alias("cognito_sub"),
        F.when(n % 4 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("cus_"), n.cast("string"))).alias("stripe_customer_id"),
        F.when(n % 5 == 2, F.lit("")).otherwise(F.concat(F.lit("pm_"), n.cast("string"))).alias("stripe_payment_method_id"),
        F.lit("4242").alias("stripe_last4"),
        F.when(n % 3 == 0, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("is_payment_active"),
    )


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment service's answer for each page site's charge attempt."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    k = F.col("page_id") % 6
    return p.select(
        F.concat(F.lit("ps-"), F.col("page_id").cast("string")).alias("site_id"),
        F.when(k == 0, F.lit("succeeded")).when(k == 5, F.lit("requires_action")).otherwise(F.lit("failed")).alias("status"),
        F.when(k == 1, F.lit("card")).when(k.isin(2, 3), F.lit("invalid_request")).when(k == 4, F.lit("api"))
        .otherwise(F.lit(None).cast("string")).alias("error_kind"),
        F.when(k == 1, F.lit("Your card was declined.")).when(k == 2, F.lit("No such PaymentMethod: 'pm_x'"))
        .when(k == 3, F.lit("Amount must be at least 50 cents")).when(k == 4, F.lit("Rate limit"))
        .otherwise(F.lit(None).cast("string")).alias("message"),
    )


def page_payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment event log per owner: setups, detachments, one event for an unknown user."""
    owners = page_prefs(spark, sf_dir).select("cognito_sub")
    n = F.regexp_extract(F.col("cognito_sub"), r"(\d+)$", 1).cast("int")
    t0 = F.lit("2024-02-01 00:00:00").cast("timestamp")
    setup = owners.filter(n % 2 == 0).select(
        (t0 + F.make_interval(hours=n)).alias("event_time"), F.lit("setup_intent.succeeded").alias("type"),
        F.col("cognito_sub").alias("user_sub"), F.concat(F.lit("cus_"), n.cast("string")).alias("customer_id"),
        F.concat(F.lit("pm_new_"), n.cast("string")).alias("payment_method_id"), F.lit("1881").alias("last4"),
    )
    detach = owners.filter(n % 3 != 2).select(
        (t0 + F.make_interval(hours=F.lit(3) * n + F.lit(1))).alias("event_time"),
        F.lit("payment_method.detached").alias("type"), F.lit(None).cast("string").alias("user_sub"),
        F.concat(F.lit("cus_"), n.cast("string")).alias("customer_id"),
        F.lit(None).cast("string").alias("payment_method_id"), F.lit(None).cast("string").alias("last4"),
    )
    return setup.unionByName(detach)


def page_site_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three updates per page site by rule: a name, a level and a plan; some empty, bad or by another owner."""
    p = page_sites_raw(spark, sf_dir).select("site_id", "owner_sub", F.regexp_extract("site_id", r"(\d+)$", 1).cast("bigint").alias("pid"))
    p = p.select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k"))
    pid, k = F.col("pid"), F.col("k")
    hours = (pid * 7 + k * 5) % 11
    return p.select(
        "site_id", F.when(pid % 6 == 5, F.lit("owner-none")).otherwise(F.col("owner_sub")).alias("owner_sub"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp") + F.make_interval(hours=hours.cast("int"))).alias("updated_at"),
        F.when(pid % 4 == k, F.lit(None).cast("string")).when(pid % 13 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit(" Name "), k.cast("string"), F.lit(" "))).alias("name"),
        F.when(k == 2, F.array(F.lit("HTTPS://New.example/x"), F.lit("new.example"))).alias("domains"),
        F.when((k == 1) & (pid % 3 == 0), F.lit("free_tier")).alias("plan"),
        F.when(k == 0, F.array(F.lit("event"))).alias("allowed_fields"),
        F.when((k == 1) & (pid % 2 == 0), F.lit("no")).when((k == 2) & (pid % 9 == 0), F.lit("bogus")).alias("compliance_level"),
    )


def page_site_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation requests: one per page site, every tenth id asked for twice."""
    p = page_sites_raw(spark, sf_dir).drop("plan", "request_allowance", "updated_at")
    pid = F.regexp_extract("site_id", r"(\d+)$", 1).cast("bigint")
    p = p.withColumn("_k", F.explode(F.when(pid % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    at = F.lit("2024-03-01 00:00:00").cast("timestamp") + F.make_interval(hours=(F.lit(5) - F.col("_k")).cast("int"))
    return p.withColumn("created_at", at).withColumn("name", F.concat("name", F.when(F.trim("name") == "", "").otherwise(F.col("_k").cast("string")))).drop("_k")
