"""Ingest: raw tracker requests -> checked, enriched, privacy-filtered events.

One stateless DataFrame function chain used by both batch and streaming:

    validate (site, referer domain, allowance, body) -> parse_body
    -> with_server_time -> with_geo / with_device / with_referer / with_utm
    -> project_initial / project_regular -> mask

Checks run in a fixed order and the first failing one decides the status:
400 missing site, 403 unknown site, 400 malformed referer header, 403 referer
not allowed, 402 allowance used up (metered only), 400 missing body, 400 body
not JSON; otherwise 202.  A request that passes the allowance gate uses one
unit of allowance even if its body is rejected afterwards (D11).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import agents, urls
from ..functions.text import is_json, last_of_repeated_keys
from ..plans.sizing import broadcast_if_bounded_by

# Status codes and reasons, in check order.
MISSING_SITE = (400, "Bad Request: Missing site parameter")
UNKNOWN_SITE = (403, "Forbidden: Invalid site identifier")
BAD_REFERER = (400, "Bad Request: Malformed referer header")
REFERER_NOT_ALLOWED = (403, "Forbidden: Invalid referer")
NO_ALLOWANCE = (402, "Payment Required: Request allowance likely exceeded.")
MISSING_BODY = (400, "Missing event body")
BAD_JSON = (400, "Invalid JSON format")
ACCEPTED = (202, "Event accepted")

GEO_HEADERS = {
    "city": "cloudfront-viewer-city",
    "region_name": "cloudfront-viewer-country-region-name",
    "region_code": "cloudfront-viewer-country-region",
    "country": "cloudfront-viewer-country-name",
    "timezone": "cloudfront-viewer-time-zone",
}

UTM_FIELDS = ["utm_source", "utm_campaign", "utm_medium", "utm_content", "utm_term"]


#: Rows of one key that are not first go to this many partitions of the tie-breaking window.
SPREAD = 1024


def mark_initial(df: DataFrame, keys: list[str], order: list[Column], out: str = "is_initial_event") -> DataFrame:
    """Flag exactly one row of each ``keys`` group: the first by ``order``, then by all other columns that can be ordered.

    A grouped ``min`` of ``order`` (combined map-side) finds each group's first value; only the rows that have it are
    numbered together, the others lie in partitions of their own, so a group holding a large share of all rows is never
    sorted inside one task.
    """
    ok = F.struct(*order)
    firsts = df.groupBy(*keys).agg(F.min(ok).alias("_first_key"))
    firsts = firsts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first_key")
    d = df.withColumn("_ok", ok)
    cond = reduce(lambda a, b: a & b, [d[k].eqNullSafe(firsts[f"_k_{k}"]) for k in keys])
    j = d.join(firsts, cond, "left").withColumn("_spread", F.when(F.col("_ok") == F.col("_first_key"), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64("_ok"), F.lit(SPREAD))))
    rest = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    number = F.row_number().over(Window.partitionBy(*keys, "_spread").orderBy(*rest))
    return j.withColumn(out, (F.col("_spread") == -1) & (number == 1)).drop(
        "_ok", "_first_key", "_spread", *[f"_k_{k}" for k in keys]
    )


def falsy_text(c: Column) -> Column:
    """JSON scalar rendered as text -> is it falsy as a JavaScript value?"""
    return c.isNull() | c.isin("false", "0", "", "0.0", "-0", "null", "NaN")


def nonempty(c: Column) -> Column:
    """Text that is null when empty (JavaScript ``a || b`` treats '' as absent)."""
    return F.when(c != "", c)


def with_site(df: DataFrame, sites: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Attach the site's config (domains, level, allowance) by a lookup join.

    The site table is a dimension; it is broadcast when its estimated size (or
    that of ``bound``, a table with a row for each of its rows) is under the
    limit, so requests are not dealt by site and a busy site is read by many
    tasks.  Else it is joined by a normal shuffle join.
    """
    cfg = sites.select(
        F.col("site_id").alias("_site_id"),
        F.col("domains").alias("_domains"),
        F.col("compliance_level").alias("_level"),
        F.coalesce(F.col("request_allowance").cast("bigint"), F.lit(0)).alias("_allowance"),
    )
    return df.join(broadcast_if_bounded_by(cfg, bound), df["site"] == cfg["_site_id"], "left")


def _code(pair) -> tuple[Column, Column]:
    return F.lit(pair[0]), F.lit(pair[1])


def pre_gate_checks(df: DataFrame) -> DataFrame:
    """Status of the checks before the allowance gate (null when all pass)."""
    site = F.col("site")
    ref = nonempty(F.col("headers")["referer"])
    df = urls.with_url_parts(df, ref, "_hdr_ref", ["host", "valid"])
    domains = F.col("_domains")
    has_list = domains.isNotNull() & (F.size(domains) > 0)
    parts = F.col("_hdr_ref")
    checks = [
        (site.isNull() | (site == ""), MISSING_SITE),
        (F.col("_site_id").isNull(), UNKNOWN_SITE),
        (ref.isNotNull() & has_list & ~parts["valid"], BAD_REFERER),
        (ref.isNotNull() & has_list & ~F.array_contains(domains, parts["host"]), REFERER_NOT_ALLOWED),
    ]
    status = reason = None
    for cond, pair in checks:
        s, r = _code(pair)
        status = F.when(cond, s) if status is None else status.when(cond, s)
        reason = F.when(cond, r) if reason is None else reason.when(cond, r)
    return df.withColumn("_pre_status", status).withColumn("_pre_reason", reason).drop("_hdr_ref")


def second_of(at: str) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(1_000_000))


def gate_allowance(df: DataFrame, eligible: Column, out: str = "_within_allowance",
                   sites: DataFrame | None = None, rows_of=None) -> DataFrame:
    """Per site, the first ``allowance`` eligible requests (by received_at, request_id) pass.

    A prefix sum in levels, each over counts of the level before, so no task ever ranks a site's requests: one grouped
    count per (site, second), combined map-side; running sums over days (one row per site and day) find the day in which
    the allowance runs out, over the seconds of that day (86,400 at most) the second, and over the microseconds of that
    second (a million at most) the microsecond.  Only requests of one site and one microsecond are ranked together, by id.
    That gives each site over its allowance one cut-off key, and every request is compared with its site's key through a
    join with that small table: no shuffle of the requests by id.  The per-site tables have at most one row per site, so
    they are broadcast when the site table itself is small (``sites``).

    ``df`` is read in full twice, for the counts and for the comparison.  Both levels read the counts from one shuffle
    (each asks for the same columns of it, with no null check of its own), and ``rows_of(keys)``, if given, makes the
    rows of ``df`` of some (site, second) pairs, joined with ``keys``, without making all of ``df`` first.
    """
    e = df.filter(eligible & F.col("site").isNotNull()).select("site", "_allowance", second_of("received_at").alias("_sec"))
    seconds = e.groupBy("site", "_sec").agg(F.count(F.lit(1)).alias("_c"), F.max("_allowance").alias("_allow")).withColumn(
        "_day", F.floor(F.col("_sec") / F.lit(86_400)))
    days = seconds.groupBy("site", "_day").agg(F.sum("_c").alias("_c"), F.max("_allow").alias("_allow"))
    by_site = Window.partitionBy("site")
    days = _running(days.withColumn("_n", F.sum("_c").over(by_site)).withColumn("_allow", F.max("_allow").over(by_site)), "_day")
    days = days.filter(F.col("_n") > F.col("_allow"))
    over = days.select("site").distinct()
    cut_day = days.filter(_holds_cut(F.col("_allow"))).select(
        F.col("site").alias("_cut_site"), F.col("_day").alias("_cut_day"), F.col("_before").alias("_spent"))
    in_day = seconds.join(broadcast_if_bounded_by(cut_day, sites),
                          F.col("site").eqNullSafe(F.col("_cut_site")) & F.col("_day").eqNullSafe(F.col("_cut_day")))
    in_day = in_day.select("site", "_sec", "_c", (F.col("_allow") - F.col("_spent")).alias("_left"))
    cut_sec = _running(in_day, "_sec").filter(_holds_cut(F.col("_left"))).select(
        "site", "_sec", (F.col("_left") - F.col("_before")).alias("_left"))
    cut_sec = broadcast_if_bounded_by(cut_sec, sites)
    near = rows_of(cut_sec) if rows_of else df.withColumn("_sec", second_of("received_at")).join(cut_sec, ["site", "_sec"])
    in_sec = near.filter(eligible).select("site", "request_id", "received_at", F.unix_micros("received_at").alias("_us"), "_left")
    same_us = Window.partitionBy("site", "_us")
    ranked = in_sec.withColumn("_rank", F.row_number().over(same_us.orderBy("request_id"))).withColumn("_c", F.count(F.lit(1)).over(same_us))
    cut_us = _running(ranked.filter(F.col("_rank") == 1), "_us").filter(_holds_cut(F.col("_left"))).select(
        "site", "_us", (F.col("_left") - F.col("_before")).alias("_at"))
    keys = ranked.join(broadcast_if_bounded_by(cut_us, sites), ["site", "_us"]).filter(F.col("_rank") == F.col("_at")).select(
        "site", F.struct("received_at", "request_id").alias("_cutoff"))
    limits = over.join(keys, "site", "left").withColumn("_over", F.lit(True))
    j = df.join(broadcast_if_bounded_by(limits, sites), "site", "left")
    inside = F.col("_over").isNull() | (
        F.col("_cutoff").isNotNull() & (F.struct("received_at", "request_id") <= F.col("_cutoff"))
    )
    return j.withColumn(out, eligible & inside).drop("_over", "_cutoff")


def _running(counts: DataFrame, by: str) -> DataFrame:
    """``_before``: per site, the sum of ``_c`` over all rows of a smaller ``by``."""
    w = Window.partitionBy("site").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))


def _holds_cut(left: Column) -> Column:
    """Does the row hold the last request that ``left`` more of them allow?"""
    return (F.col("_before") < left) & (F.col("_before") + F.col("_c") >= left)


def pre_check(requests: DataFrame, sites: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Site lookup and the checks before the allowance gate (``_pre_status`` null = passed)."""
    return pre_gate_checks(with_site(requests, sites, bound))


def finish_checks(pre: DataFrame, metered: bool = False, sites: DataFrame | None = None, rows_of=None) -> DataFrame:
    """Allowance gate (metered only) and body checks -> ``status``, ``reason``, ``uses_allowance``.

    The gate reads ``pre`` for its counts, for the cut seconds (``rows_of``, see
    :func:`gate_allowance`) and for the comparison; a job stores ``pre`` first
    so the checks before it run once per row.
    """
    df = pre
    eligible = F.col("_pre_status").isNull()
    if metered:
        df = gate_allowance(df, eligible, sites=sites, rows_of=rows_of)
        gate_fail = eligible & ~F.col("_within_allowance")
        uses = F.col("_within_allowance")
    else:
        gate_fail = F.lit(False)
        uses = F.lit(False)
    body = F.col("body")
    no_body = body.isNull() | (body == "")
    bad_json = ~is_json(body)
    status = (
        F.when(~eligible, F.col("_pre_status"))
        .when(gate_fail, F.lit(NO_ALLOWANCE[0]))
        .when(no_body, F.lit(MISSING_BODY[0]))
        .when(bad_json, F.lit(BAD_JSON[0]))
        .otherwise(F.lit(ACCEPTED[0]))
    )
    reason = (
        F.when(~eligible, F.col("_pre_reason"))
        .when(gate_fail, F.lit(NO_ALLOWANCE[1]))
        .when(no_body, F.lit(MISSING_BODY[1]))
        .when(bad_json, F.lit(BAD_JSON[1]))
        .otherwise(F.lit(ACCEPTED[1]))
    )
    out = df.withColumn("status", status.cast("int")).withColumn("reason", reason).withColumn("uses_allowance", uses)
    return out.drop("_pre_status", "_pre_reason", "_within_allowance")


def validate(requests: DataFrame, sites: DataFrame, metered: bool = False) -> DataFrame:
    """requests -> requests + site config + ``status``, ``reason``, ``uses_allowance``."""
    def rows_of(keys: DataFrame) -> DataFrame:
        return pre_check(requests.withColumn("_sec", second_of("received_at")).join(keys, ["site", "_sec"]), sites)

    return finish_checks(pre_check(requests, sites), metered, sites, rows_of)


def parse_body(df: DataFrame, event_aliases: dict[str, str] | None = None) -> DataFrame:
    """JSON body -> typed fields ``b_*``; a truthy ``is_initial_event`` marks the first event."""
    b = F.from_json(F.col("body"), S.BODY)
    out = df.withColumn("_b", b)
    fields = [f.name for f in S.BODY.fields]
    out = out.select(*df.columns, *[(last_of_repeated_keys(F.col("_b")[f]) if f == "properties" else F.col("_b")[f]).alias(f"b_{f}")
                                    for f in fields])
    if event_aliases:
        m = F.create_map(*[x for k, v in event_aliases.items() for x in (F.lit(k), F.lit(v))])
        out = out.withColumn("b_event", F.coalesce(m[F.col("b_event")], F.col("b_event")))
    return out.withColumn("is_initial_event", ~falsy_text(F.col("b_is_initial_event")))


def with_server_time(df: DataFrame) -> DataFrame:
    """``timestamp`` = server receive time; ``dt`` = its UTC date (client time ignored)."""
    return df.withColumns({"timestamp": F.col("received_at"),
                           "dt": F.date_format(F.col("received_at"), "yyyy-MM-dd")})


def with_geo(df: DataFrame) -> DataFrame:
    h = F.col("headers")
    return df.withColumns({
        "city": h[GEO_HEADERS["city"]],
        "region": F.coalesce(nonempty(h[GEO_HEADERS["region_name"]]), h[GEO_HEADERS["region_code"]]),
        "country": h[GEO_HEADERS["country"]],
        "timezone": h[GEO_HEADERS["timezone"]],
    })


def user_agent() -> Column:
    return F.coalesce(
        nonempty(F.col("headers")["user-agent"]), nonempty(F.col("context_user_agent")), nonempty(F.col("b_userAgent"))
    )


def with_device(df: DataFrame) -> DataFrame:
    return agents.with_agent_fields(df, user_agent())


def level() -> Column:
    return F.coalesce(F.col("_level"), F.lit("maybe"))


def _visit_urls(df: DataFrame, page: bool = True) -> DataFrame:
    """Parse the referer (body, else header), the origin header and the page URL together."""
    df = df.withColumns({
        "_raw_ref": F.coalesce(nonempty(F.col("b_referer")), nonempty(F.col("headers")["referer"])),
        "_org": nonempty(F.col("headers")["origin"]),
    })
    srcs = {"_rp": "_raw_ref", "_op": "_org"}
    if page and "b_url" in df.columns:
        srcs["_page"] = "b_url"
    return urls.with_many_url_parts(df, srcs, {"_rp": ["host", "path", "origin", "valid"], "_op": ["host", "valid"], "_page": ["query"]})


def with_referer(df: DataFrame) -> DataFrame:
    """``referer`` and ``referer_domain`` from the body referer, else the header.

    Empty or ``$direct`` -> ``$direct``; same host as the origin header ->
    ``$direct``; unparsable (or unparsable origin) -> domain ``$invalid`` with
    the raw text kept; else the host, and at level yes/maybe the referer is cut
    to origin + path (query and fragment dropped).
    """
    if "_rp" not in df.columns:
        df = _visit_urls(df, page=False)
    raw, org, rp, op = F.col("_raw_ref"), F.col("_org"), F.col("_rp"), F.col("_op")
    direct = raw.isNull() | (raw == "$direct")
    invalid = ~rp["valid"] | (org.isNotNull() & ~op["valid"])
    same = org.isNotNull() & (op["host"] == rp["host"])
    scrub = level().isin("yes", "maybe")
    referer = (
        F.when(direct, F.lit("$direct")).when(invalid, raw).when(same, F.lit("$direct"))
        .when(scrub, urls.origin_and_path(rp)).otherwise(raw)
    )
    domain = (
        F.when(direct, F.lit("$direct")).when(invalid, F.lit("$invalid")).when(same, F.lit("$direct"))
        .otherwise(rp["host"])
    )
    keep = [F.col(c) for c in df.columns if c not in ("_raw_ref", "_org", "_rp", "_op", "referer", "referer_domain")]
    return df.select(*keep, referer.alias("referer"), domain.alias("referer_domain"))


def with_utm(df: DataFrame, from_url: bool = True) -> DataFrame:
    """utm_* from the body; for first events lacking them, from the page URL query (``b_url``)."""
    use_url = from_url and "b_url" in df.columns
    if use_url and "_page" not in df.columns:
        df = urls.with_url_parts(df, "b_url", "_page", ["query"])
    vals = {}
    for k in UTM_FIELDS:
        body = F.col(f"b_{k}")
        if use_url:
            vals[k] = F.coalesce(body, F.when(F.col("is_initial_event"), urls.query_param(F.col("_page")["query"], k)))
        else:
            vals[k] = body
    keep = [F.col(c) for c in df.columns if c not in vals and c != "_page"]
    return df.select(*keep, *[v.alias(k) for k, v in vals.items()])


def _common_values() -> dict[str, Column]:
    return {
        "site_id": F.col("site"),
        "dt": F.col("dt"),
        "event": F.col("b_event"),
        "pathname": F.col("b_pathname"),
        "session_id": F.col("b_session_id").cast("string"),
        "timestamp": F.col("timestamp"),
        "properties": F.coalesce(F.col("b_properties"), F.create_map().cast(S.PROPERTIES_TYPE)),
    }


def project_regular(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Later events keep the 7 common columns (plus ``keep`` pass-through columns)."""
    vals = _common_values()
    return df.select(*[vals[f.name].cast(f.type).alias(f.name) for f in S.COMMON_FIELDS], *(keep or []))


def project_initial(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """First events keep every column; screen sizes and session id forced to text."""
    vals = _common_values()
    vals.update({
        "distinct_id": F.lit(None).cast("string"),
        "screen_height": F.col("b_screen_height").cast("string"),
        "screen_width": F.col("b_screen_width").cast("string"),
    })
    for c in ["model", "manufacturer", "city", "timezone", "browser_version", "os_version", "region", "country",
              "device", "browser", "os", "referer", "referer_domain", *UTM_FIELDS]:
        vals[c] = F.col(c)
    return df.select(*[vals[f.name].cast(f.type).alias(f.name) for f in S.INITIAL_FIELDS], *(keep or []))


def mask(df: DataFrame, initial: bool, level_col: str = "_level") -> DataFrame:
    """Null every field the site's compliance level (default ``maybe``) does not allow.

    yes keeps tag yes; maybe keeps yes + maybe; no keeps all; site_id,
    timestamp and dt always stay.  Decided per row by the row's own site level.
    """
    lvl = F.coalesce(F.col(level_col), F.lit("maybe"))
    rank = F.when(lvl == "yes", 0).when(lvl == "maybe", 1).when(lvl == "no", 2).otherwise(1)
    fields = S.INITIAL_FIELDS if initial else S.COMMON_FIELDS
    out = []
    for f in fields:
        if f.name in S.ALWAYS_KEPT:
            out.append(F.col(f.name))
        else:
            need = S.LEVEL_RANK[f.safe]
            out.append(F.when(rank >= need, F.col(f.name)).alias(f.name))
    extra = [c for c in df.columns if c not in {f.name for f in fields}]
    return df.select(*out, *extra)


def parse_accepted(checked: DataFrame, event_aliases: dict[str, str] | None = None) -> DataFrame:
    """Accepted requests with their parsed body and server time."""
    return with_server_time(parse_body(checked.filter(F.col("status") == ACCEPTED[0]), event_aliases))


def enrich_visit(parsed: DataFrame) -> DataFrame:
    """Visit fields (geo, device, referer, utm) - only first events keep them."""
    return with_utm(with_referer(_visit_urls(with_device(with_geo(parsed)))))


def enrich(checked: DataFrame, event_aliases: dict[str, str] | None = None) -> DataFrame:
    """Accepted requests -> all event fields (before projection and masking)."""
    return enrich_visit(parse_accepted(checked, event_aliases))


def split_checked(checked: DataFrame, event_aliases: dict[str, str] | None = None,
                  keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checked requests -> (initial_events, events, rejects), masked per site level.

    Only first events go through the visit enrichment (user-agent rules, URL
    parsing): later events keep the common columns only.
    """
    parsed = parse_accepted(checked, event_aliases)
    keep_cols = list(keep or []) + ["_level"]
    first = enrich_visit(parsed.filter(F.col("is_initial_event")))
    initial = mask(project_initial(first, keep_cols), True).drop("_level")
    regular = mask(project_regular(parsed.filter(~F.col("is_initial_event")), keep_cols), False).drop("_level")
    rejects = checked.filter(F.col("status") != ACCEPTED[0]).select(
        "request_id", "received_at", "site", "status", "reason",
        F.date_format(F.col("received_at"), "yyyy-MM-dd").alias("dt"), "body",
    )
    return initial, regular, rejects


def process(requests: DataFrame, sites: DataFrame, metered: bool = False,
            event_aliases: dict[str, str] | None = None, keep: list[str] | None = None):
    """requests -> (initial_events, events, rejects, checked).

    ``checked`` is every request with its status; the others are derived from
    it.  ``keep`` names request columns carried through (e.g. ``request_id``).
    """
    checked = validate(requests, sites, metered)
    initial, regular, rejects = split_checked(checked, event_aliases, keep)
    return initial, regular, rejects, checked
