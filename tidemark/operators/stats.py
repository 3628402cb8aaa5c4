"""Headline numbers, time series and property keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed, format_duration
from .model import Analytics, is_page_view

SID = "session_id"


def session_facts(a: Analytics) -> DataFrame:
    """Per session: page_view count and duration in ms (null for one-event sessions)."""
    s = a.sessions
    dur_us = F.unix_micros("last_ts") - F.unix_micros("first_ts")
    return s.select(
        SID,
        F.col("n_pageviews").alias("page_view_count"),
        F.when(F.col("n_rows") > 1, dur_us / F.lit(1000.0)).alias("duration_ms"),
    )


# Bit shifts of the radix levels used to find an order statistic of non-negative
# bigints: each level groups the values still in play by their next 21 bits, so
# no step holds more than 2**21 small (prefix, count) rows in one task, at any
# data size.
RADIX_SHIFTS = (42, 21, 0)


def exact_median_frame(values: DataFrame, col: str) -> DataFrame:
    """One row ``median``: exact (interpolating) median of a non-negative bigint column.

    Same result as ``median`` / ``percentile(col, 0.5)`` (the mean of the two
    middle values for an even count), but it never merges all distinct values
    in one task.  A radix descent finds the two middle order statistics: the
    state (rank, prefix so far, rank left inside it) is a two-row frame; each
    level joins the values to it by prefix (broadcast, two rows), counts them
    by their next 21 bits (combined map-side), and keeps the group holding
    the rank.  No level holds more than 2**21 groups.
    """
    v = values.select(F.col(col).cast("bigint").alias("_v")).filter(F.col("_v").isNotNull())
    # level 1 needs no state: its histogram also gives the count, hence both ranks
    top = RADIX_SHIFTS[0]
    h = v.groupBy(F.shiftright("_v", top).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(F.lit(1))
    h = h.withColumn("_n", F.sum("_c").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    h = h.withColumn("_cum", F.sum("_c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    h = h.select("_p", "_c", "_cum", F.explode(F.array(
        F.struct(F.lit(0).alias("_r"), (F.floor((F.col("_n") - 1) / 2) + 1).alias("_rem")),
        F.struct(F.lit(1).alias("_r"), (F.ceil((F.col("_n") - 1) / 2) + 1).alias("_rem")),
    )).alias("_s")).select("_p", "_c", "_cum", "_s._r", "_s._rem")
    st = h.filter((F.col("_cum") - F.col("_c") < F.col("_rem")) & (F.col("_cum") >= F.col("_rem"))).select(
        "_r", (F.col("_rem") - (F.col("_cum") - F.col("_c"))).alias("_rem"), F.col("_p").alias("_prefix")
    )
    prev = top
    for sh in RADIX_SHIFTS[1:]:
        cand = v.join(F.broadcast(st), F.shiftright(v["_v"], prev) == st["_prefix"])
        h = cand.groupBy("_r", "_rem", F.shiftright("_v", sh).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy("_r").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        h = h.withColumn("_cum", F.sum("_c").over(w))
        st = h.filter((F.col("_cum") - F.col("_c") < F.col("_rem")) & (F.col("_cum") >= F.col("_rem"))).select(
            "_r", (F.col("_rem") - (F.col("_cum") - F.col("_c"))).alias("_rem"), F.col("_p").alias("_prefix")
        )
        prev = sh
    lo = F.max(F.when(F.col("_r") == 0, F.col("_prefix")))
    hi = F.max(F.when(F.col("_r") == 1, F.col("_prefix")))
    return st.agg((lo.cast("double") * 0.5 + hi.cast("double") * 0.5).alias("median"))


def exact_median(values: DataFrame, col: str) -> Column:
    """``exact_median_frame`` as a scalar Column (null when there are no values)."""
    return exact_median_frame(values, col).select("median").scalar()


def stats(a: Analytics) -> DataFrame:
    """One row: visits, page views, unique visitors, median duration (s), bounce rate (%).

    One global aggregate over the session table (no cross join of four
    one-row results).  Visitors are distinct non-null session ids; the median
    is exact (interpolating) over sessions with more than one event.
    """
    # both parts need all of these columns (the condition always holds), so they read one shared session aggregate
    s = a.sessions.select(SID, "n_rows", "n_pageviews", "first_ts", "last_ts").where(
        (F.col("n_rows") >= F.col("n_pageviews")) & (F.col("first_ts").isNull() | (F.col("first_ts") <= F.col("last_ts"))))
    dur_us = F.when(F.col("n_rows") > 1, F.unix_micros("last_ts") - F.unix_micros("first_ts"))
    med = exact_median(s.select(dur_us.alias("_d")), "_d")
    g = s.agg(
        F.count(F.col(SID)).alias("unique_visitors"),
        F.coalesce(F.sum("n_pageviews"), F.lit(0)).cast("bigint").alias("total_pageviews"),
        F.count(F.when(F.col("n_pageviews") == 1, F.col(SID))).alias("bounced_sessions"),
    ).withColumn("_median_us", med)
    return g.select(
        F.col("unique_visitors").alias("total_visits"),
        "total_pageviews",
        "unique_visitors",
        "bounced_sessions",
        F.coalesce(F.col("_median_us") / F.lit(1e6), F.lit(0.0)).alias("median_duration_seconds"),
        F.when(F.col("unique_visitors") > 0,
               F.col("bounced_sessions").cast("double") / F.col("unique_visitors") * F.lit(100.0))
        .otherwise(F.lit(0.0)).alias("bounce_rate"),
        F.when(F.col("unique_visitors") > 0,
               F.col("total_pageviews").cast("double") / F.col("unique_visitors")).alias("views_per_visit"),
    )


def stats_display(st: DataFrame) -> DataFrame:
    """The stats row as the dashboard shows it (texts)."""
    return st.select(
        "total_visits", "total_pageviews", "unique_visitors",
        F.when(F.col("total_visits") > 0, fixed(F.col("views_per_visit"), 2)).otherwise(F.lit("N/A"))
        .alias("views_per_visit"),
        format_duration(F.col("median_duration_seconds")).alias("visit_duration"),
        F.when(F.col("bounce_rate").isNull(), F.lit("N/A"))
        .otherwise(F.concat(fixed(F.col("bounce_rate"), 1), F.lit("%"))).alias("bounce_rate"),
    )


def bucket_format(start: datetime | None, end: datetime | None) -> str:
    """Hourly buckets when the range spans at most 24 h, else daily (D19)."""
    if start is not None and end is not None and (end - start).total_seconds() <= 24 * 3600:
        return "yyyy-MM-dd HH:00"
    return "yyyy-MM-dd"


def timeseries(a: Analytics, start: datetime | None = None, end: datetime | None = None,
               fmt: str | None = None) -> DataFrame:
    """page_view count per hour or day; ordered; no gap filling."""
    fmt = fmt or bucket_format(start, end)
    return (
        a.event_rows().filter(is_page_view())
        .groupBy(F.date_format("timestamp", fmt).alias("date"))
        .agg(F.count(F.lit(1)).alias("views"))
        .orderBy("date")
    )


def property_keys(a: Analytics | DataFrame) -> DataFrame:
    """Distinct keys of valid JSON-object properties, sorted. Ignores segments (D16)."""
    rows = a.event_rows() if isinstance(a, Analytics) else a
    return (
        rows.select(F.explode(F.json_object_keys(F.col("properties"))).alias("key"))
        .distinct()
        .orderBy("key")
    )
