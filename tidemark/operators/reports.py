"""Ranked breakdowns: group, keep value > 0, highest first, first 100.

Ties are ordered by ``name`` so results are stable (the source product leaves
them unordered).  Every breakdown whose value is a count of distinct sessions
is computed on the session table (one row per session) because all grouped
columns there are constant within a session; event-level breakdowns use the
event view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import SK, SN, Analytics, real_page

LIMIT = 100
SID = "session_id"


def _top(df: DataFrame, limit: int = LIMIT, extra_order: list[Column] | None = None) -> DataFrame:
    order = [F.col("value").desc(), F.col("name").asc_nulls_first()] + (extra_order or [])
    return df.filter(F.col("value") > 0).orderBy(*order).limit(limit)


def simple_report(df: DataFrame, name: Column, value: Column, where: Column | None = None,
                  limit: int = LIMIT) -> DataFrame:
    """SELECT name, value FROM df WHERE where GROUP BY name HAVING value > 0
    ORDER BY value DESC LIMIT limit."""
    if where is not None:
        df = df.filter(where)
    g = df.groupBy(name.alias("name")).agg(value.alias("value"))
    return _top(g.select("name", F.col("value").cast("bigint").alias("value")), limit)


def _sessions_by(a: Analytics, name: Column, where: Column | None = None, limit: int = LIMIT) -> DataFrame:
    # count(DISTINCT session_id) over the view == count(session_id) over the session table
    return simple_report(a.sessions, name, F.count(F.col(SID)), where, limit)


def channels(a: Analytics) -> DataFrame:
    return _sessions_by(a, F.col("channel"))


def sources(a: Analytics) -> DataFrame:
    return _sessions_by(a, F.col("source"))


def campaigns(a: Analytics) -> DataFrame:
    return _sessions_by(a, F.coalesce(F.col("utm_campaign"), F.lit("(not set)")),
                        F.col("utm_campaign").isNotNull())


def countries(a: Analytics) -> DataFrame:
    return _sessions_by(a, F.coalesce(F.col("country"), F.lit("Unknown")))


def regions(a: Analytics) -> DataFrame:
    r = F.col("region")
    return _sessions_by(a, F.coalesce(r, F.lit("Unknown")), r.isNotNull() & (r != "Unknown"))


def top_pages(a: Analytics) -> DataFrame:
    return simple_report(a.event_rows(), F.col("pathname"), F.count(F.lit(1)), real_page())


def entry_pages(a: Analytics) -> DataFrame:
    s = a.sessions.filter(F.col("entry_page").isNotNull())
    return simple_report(s, F.col("entry_page"), F.count(F.lit(1)))


def exit_pages(a: Analytics) -> DataFrame:
    s = a.sessions.filter(F.col("exit_page").isNotNull())
    return simple_report(s, F.col("exit_page"), F.count(F.lit(1)))


def _share_of_sessions(a: Analytics, name: Column, hide: str | None = None) -> DataFrame:
    """One value per session (the session group), its count and % of all session groups.

    The total is the sum of the counts, a scalar subquery on the same grouped rows.
    """
    counts = a.sessions.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("value"))
    total = counts.agg(F.sum("value")).scalar()
    out = counts.select(
        "name", "value", (F.col("value").cast("double") / total * F.lit(100.0)).alias("percentage")
    )
    if hide is not None:
        out = out.filter(F.col("name") != hide)
    return _top(out)


def browsers(a: Analytics) -> DataFrame:
    return _share_of_sessions(a, F.coalesce(F.col("browser"), F.lit("Unknown")))


def operating_systems(a: Analytics) -> DataFrame:
    return _share_of_sessions(a, F.coalesce(F.col("os"), F.lit("Unknown")))


def screen_size_expr() -> Column:
    w, h = F.col("screen_width"), F.col("screen_height")
    return F.when(w.isNotNull() & h.isNotNull(), F.concat(w, F.lit("x"), h)).otherwise(F.lit("Unknown"))


def screen_sizes(a: Analytics) -> DataFrame:
    # 'Unknown' counts in the total but is not shown (D14)
    return _share_of_sessions(a, screen_size_expr(), hide="Unknown")


def _per_name_and_session(rows: DataFrame) -> DataFrame:
    """Rows per (``name``, session).  The condition always holds; it keeps the count in every plan that reads these pairs,
    so all of them share one aggregate."""
    return rows.groupBy("name", SK, SN).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)


def _sessions_and_rows(pairs: DataFrame) -> DataFrame:
    """Per name its sessions (with an id) and its rows."""
    return pairs.groupBy("name").agg(F.count(F.when(~F.col(SN), 1)).alias("value"), F.sum("n").alias("events"))


def _with_share(counts: DataFrame, total: Column) -> DataFrame:
    share = F.when(total > 0, F.col("value").cast("double") / total * F.lit(100.0)).otherwise(F.lit(0.0))
    return counts.select("name", "value", "events", share.alias("percentage"))


def events_report(a: Analytics) -> DataFrame:
    """Per event name: distinct sessions (value), rows (events), % of all sessions."""
    pairs = _per_name_and_session(a.event_rows().select(F.coalesce(F.col("event"), F.lit("Unknown")).alias("name"), SK, SN))
    total = pairs.where(~F.col(SN)).select(SK).distinct().agg(F.count(F.lit(1))).scalar()
    return _top(_with_share(_sessions_and_rows(pairs), total))


def property_value(key: str) -> Column:
    """The value of one key of the row's properties as text, for any key (D18): by a JSON path where the key can stand
    in one, else from the parsed object, in which the last of repeated keys counts."""
    if "'" not in key and "\\" not in key:
        return F.get_json_object(F.col("properties"), f"$['{key}']")
    held = F.map_filter(F.from_json(F.col("properties"), "map<string,string>"), lambda k, _v: k == F.lit(key))
    return F.try_element_at(F.map_values(held), F.lit(-1))


def property_values(a: Analytics, key: str) -> DataFrame:
    """Values of one property key: sessions, rows, % of the sum of sessions over values (D15)."""
    e = a.event_rows().select(property_value(key).alias("name"), SK, SN).filter(F.col("name").isNotNull())
    pairs = _per_name_and_session(e)
    total = pairs.agg(F.count(F.when(~F.col(SN), 1))).scalar()
    return _top(_with_share(_sessions_and_rows(pairs), total))


# Breakdown name -> function, grouped as the dashboard cards group them.
BUNDLES = {
    "sources": {"channels": channels, "sources": sources, "campaigns": campaigns},
    "pages": {"topPages": top_pages, "entryPages": entry_pages, "exitPages": exit_pages},
    "regions": {"countries": countries, "regions": regions},
    "devices": {"browsers": browsers, "os": operating_systems, "screenSizes": screen_sizes},
    "events": {"events": events_report},
}


def _bundle_names(name: str) -> list[str]:
    if name not in BUNDLES:
        raise KeyError(f"unknown report group {name!r}; known: {sorted(BUNDLES)}")
    return list(BUNDLES[name])


def bundle(a: Analytics, name: str) -> dict[str, DataFrame]:
    """All breakdowns of one card group; an unknown group name is an error."""
    return {k: BUNDLES[name][k](a) for k in _bundle_names(name)}


# Breakdowns whose value counts session groups (those without an id too) and has a percentage of them.
SHARES = ("browsers", "os", "screenSizes")
LONG_COLUMNS = ["type", "name", "value", "events", "percentage"]


def _names(cases: dict[str, tuple[Column, Column | None]]) -> Column:
    """One (type, name) for each breakdown that counts the row."""
    entries = [F.when(where if where is not None else F.lit(True), F.struct(F.lit(t).alias("type"), name.cast("string").alias("name")))
               for t, (name, where) in cases.items()]
    return F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("e")


def _session_cases() -> dict[str, tuple[Column, Column | None]]:
    region, campaign = F.col("region"), F.col("utm_campaign")
    return {
        "channels": (F.col("channel"), None), "sources": (F.col("source"), None), "campaigns": (campaign, campaign.isNotNull()),
        "entryPages": (F.col("entry_page"), F.col("entry_page").isNotNull()),
        "exitPages": (F.col("exit_page"), F.col("exit_page").isNotNull()),
        "countries": (F.coalesce(F.col("country"), F.lit("Unknown")), None),
        "regions": (region, region.isNotNull() & (region != "Unknown")),
        "browsers": (F.coalesce(F.col("browser"), F.lit("Unknown")), None),
        "os": (F.coalesce(F.col("os"), F.lit("Unknown")), None), "screenSizes": (screen_size_expr(), None),
    }


def _row_cases(property_key: str | None) -> dict[str, tuple[Column, Column | None]]:
    out = {"topPages": (F.col("pathname"), real_page()), "events": (F.coalesce(F.col("event"), F.lit("Unknown")), None)}
    if property_key:
        value = property_value(property_key)
        out["properties"] = (value, value.isNotNull())
    return out


def long_report(a: Analytics, groups: list[str] | None = None, property_key: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Every breakdown in one long table ``type, name, value, events, percentage`` (with ``properties`` for a key).

    One pass over the session table and one over the event rows: each session (row) gives one (type, name) per breakdown,
    and one aggregate counts them all.  Totals come from the grouped rows; the first ``limit`` names of each
    type are kept by a rank that Spark limits before its shuffle.
    """
    known = {t for g in groups or list(BUNDLES) for t in _bundle_names(g)} | ({"properties"} if property_key else set())
    parts = []
    wanted = {t: c for t, c in _session_cases().items() if t in known}
    if wanted:
        s = a.sessions.select(F.col(SID).isNotNull().alias("named"), _names(wanted))
        counts = s.groupBy("e.type", "e.name").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("named"), 1)).alias("named"))
        of_all = F.col("type").isin(*SHARES, "entryPages", "exitPages")
        counts = counts.select("type", "name", F.when(of_all, F.col("all")).otherwise(F.col("named")).alias("value"))
        totals = counts.groupBy("type").agg(F.sum("value").alias("total"))  # one row per breakdown
        share = F.when(F.col("type").isin(*SHARES), F.col("value").cast("double") / F.col("total") * F.lit(100.0))
        # not shown, but part of the total: as a value, since a filter would go below the aggregate and keep it from being shared
        hidden = (F.col("type") == "screenSizes") & (F.col("name") == "Unknown")
        shown = counts.join(F.broadcast(totals), "type")
        parts.append(shown.select("type", "name", F.when(~hidden, F.col("value")).alias("value"), F.lit(None).cast("bigint").alias("events"), share.alias("percentage")))
    wanted = {t: c for t, c in _row_cases(property_key).items() if t in known}
    if wanted:
        r = a.event_rows().select(SK, SN, _names(wanted)).select(SK, SN, "e.type", "e.name")
        # pages count rows: their pairs need no session, so they collapse before the shuffle
        r = r.withColumn(SK, F.when(F.col("type") != "topPages", F.col(SK)))
        pairs = r.groupBy("type", "name", SK, SN).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
        counts = pairs.groupBy("type", "name").agg(F.count(F.when(~F.col(SN), 1)).alias("sessions"), F.sum("n").alias("events"))
        totals = pairs.groupBy("type").agg(F.count(F.when(~F.col(SN), 1)).alias("pairs"),
                                           F.count_distinct(F.when(~F.col(SN), F.col(SK))).alias("sessions_seen"))
        total = F.when(F.col("type") == "events", F.col("sessions_seen")).otherwise(F.col("pairs"))
        pages = F.col("type") == "topPages"
        shown = counts.join(F.broadcast(totals), "type")
        parts.append(shown.select("type", "name", F.when(pages, F.col("events")).otherwise(F.col("sessions")).alias("value"),
                                  F.when(~pages, F.col("events")).alias("events"),
                                  F.when(~pages, F.coalesce(F.col("sessions").cast("double") / F.when(total > 0, total) * F.lit(100.0), F.lit(0.0)))
                                  .alias("percentage")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.col("value").desc(), F.col("name").asc_nulls_first()))
    return out.where(F.col("value") > 0).withColumn("_rank", rank).where(F.col("_rank") <= limit).select(*LONG_COLUMNS)


def split(long_df: DataFrame, type_name: str) -> DataFrame:
    """One breakdown back out of the long table."""
    return long_df.filter(F.col("type") == type_name).drop("type")
