"""Dashboard plan: every report for one segment list from one scoped fetch.

The segmented model (raw rows + session table) is persisted once and read by
all reports; Spark runs each report as its own job over the cached data.  The
property key is kept if still present, else the first key (sorted), else none.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import flow, reports, stats
from ..operators.model import Analytics
from ..operators.segments import Segment, apply_segments


class Dashboard:
    """Every report for one segment list, each built on first use.

    The segmented model is shared (and persisted when asked); a report's
    plan is only analysed when the caller touches it.
    """

    def __init__(self, seg: Analytics, base: Analytics, start: datetime | None, end: datetime | None,
                 property_key: str | None, cached: list):
        self.seg, self.base, self.start, self.end = seg, base, start, end
        self.requested_key = property_key
        self.cached = cached

    @cached_property
    def stats(self) -> DataFrame:
        return stats.stats(self.seg)

    @cached_property
    def chart(self) -> DataFrame:
        return stats.timeseries(self.seg, self.start, self.end)

    @cached_property
    def property_keys(self) -> DataFrame:
        # property keys ignore segments (D16)
        return stats.property_keys(self.base)

    @cached_property
    def property_key(self) -> str | None:
        return pick_property_key(self.property_keys, self.requested_key)

    @cached_property
    def property_values(self) -> DataFrame | None:
        return reports.property_values(self.seg, self.property_key) if self.property_key else None

    @cached_property
    def groups(self) -> dict[str, dict[str, DataFrame]]:
        return {g: reports.bundle(self.seg, g) for g in reports.BUNDLES}

    @cached_property
    def flow_links(self) -> DataFrame:
        return flow.display_links(flow.flow_links(self.seg))

    @cached_property
    def flow_nodes(self) -> DataFrame:
        return flow.flow_nodes(self.flow_links)

    def long(self) -> DataFrame:
        """The whole dashboard as one table ``type, name, target, value, events, percentage, number``.

        All breakdowns (with the values of the chosen property, type ``properties``) from one pass; ``stats`` rows carry
        counts in ``value``, the bounce rate in ``percentage`` and other measures in ``number``; ``chart`` has one row per
        time bucket, ``propertyKeys`` one per key, ``flow`` one per shown link (``name`` to ``target``).
        """
        out = _long_part(reports.long_report(self.seg, property_key=self.property_key))
        out = out.unionByName(_stats_part(self.stats))
        out = out.unionByName(_long_part(self.chart.select(F.lit("chart").alias("type"), F.col("date").alias("name"), F.col("views").alias("value"))))
        out = out.unionByName(_long_part(self.property_keys.select(F.lit("propertyKeys").alias("type"), F.col("key").alias("name"))))
        links = self.flow_links.select(F.lit("flow").alias("type"), F.col("source").alias("name"), "target", "value")
        return out.unionByName(_long_part(links))

    def release(self) -> None:
        for a in self.cached:
            a.unpersist()
        self.cached.clear()


LONG = {"type": "string", "name": "string", "target": "string", "value": "bigint", "events": "bigint", "percentage": "double",
        "number": "double"}


def _long_part(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in LONG.items()])


def _stats_part(stats_row: DataFrame) -> DataFrame:
    """The headline numbers, one row each."""
    def entry(name: str, column: str) -> Column:
        parts = {c: F.lit(None) for c in ("value", "percentage", "number")} | {column: F.col(name)}
        return F.struct(F.lit(name).alias("name"), *[x.cast(LONG[c]).alias(c) for c, x in parts.items()])

    entries = [entry(n, "value") for n in ("total_visits", "total_pageviews", "unique_visitors", "bounced_sessions")]
    entries += [entry("bounce_rate", "percentage"), entry("median_duration_seconds", "number"), entry("views_per_visit", "number")]
    return _long_part(stats_row.select(F.inline(F.array(*entries))).withColumn("type", F.lit("stats")))


def pick_property_key(keys: DataFrame, current: str | None) -> str | None:
    """Keep ``current`` if it is still among the keys, else the first key (sorted), else none.

    One global aggregate over the distributed key list returns both candidates."""
    row = keys.agg(
        F.max(F.when(F.col("key") == F.lit(current), F.col("key"))).alias("kept"),
        F.min("key").alias("first"),
    ).first()
    return row["kept"] if current and row["kept"] is not None else row["first"]


def dashboard(a: Analytics, start: datetime | None = None, end: datetime | None = None,
              segments: list[Segment] | None = None, property_key: str | None = None,
              persist: bool = True) -> Dashboard:
    """Every report for one segment list (built lazily, see ``Dashboard``).

    Property keys ignore segments (D16); the key to break down is chosen by
    one global aggregate, not by collecting the key list.
    """
    seg = apply_segments(a, segments or [])
    cached = []
    if persist:
        seg = seg.persist()
        cached.append(seg)
    return Dashboard(seg, a, start, end, property_key, cached)
