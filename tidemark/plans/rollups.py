"""Stored session rollups: reports after one more batch read small partial states, not the lake's raw rows.

Each batch adds, per session and (site, day), one mergeable state: its first row (as the least of row order and visit
columns), its counts, its first and last time, its entry and exit page (the least and greatest of row order and path).  States of the
same session from other batches or days merge by the same minima, maxima and sums, in any order, into exactly the
session table that all rows together give, so every report on the session table (headline numbers with the exact
median, channels, sources, countries, entry and exit pages, ...) can be read from it.  Page views per hour go into a
second table.

Both tables lie under the commit log (``sources.lakelog``): a batch's states appear together, a batch that runs again
replaces exactly its own, and a scoped read opens the files of its sites and days only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.model import SESSION_KEY, SK, SN, Analytics, channel_expr, is_page_view, order_key, real_page, source_expr
from ..sinks.lake import BATCH_WRITER
from ..sources.lakelog import Commit, Table, merge_files, replace_batch, snapshot

CELL = ("site_id", "dt")
FACTS = ["n_rows", "n_pageviews", "first_ts", "last_ts"]

#: Page views per (site, day, hour); an hour without a time is null.
HOURS = Table("hour_rollups", T.StructType([
    T.StructField("site_id", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("hour", T.TimestampType()),
    T.StructField("views", T.LongType())]), CELL, "hour")


def partial_sessions(a: Analytics) -> DataFrame:
    """One state per (site, day, session) of the rows of ``a``, combined map-side."""
    ok = order_key(a.base, a.seq_col).alias("at")
    visit = F.struct(*[c for c in a.static if c != SESSION_KEY]).alias("visit")
    page = F.when(real_page(), F.struct(ok, F.col("pathname")))
    return a.base.groupBy(*CELL, SK, SN).agg(
        F.min(F.struct(ok, visit)).alias("first"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_page_view()).alias("n_pageviews"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.min(page).alias("entry"),
        F.max(page).alias("exit"),
    )


def merged_sessions(states: DataFrame, static: tuple[str, ...]) -> DataFrame:
    """The session table (as ``model.session_table`` gives it) from states of any batches and days."""
    merged = states.groupBy(SK, SN).agg(
        F.min("first").alias("first"), F.sum("n_rows").alias("n_rows"), F.sum("n_pageviews").alias("n_pageviews"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min("entry").alias("entry"), F.max("exit").alias("exit"))
    out = merged.select(SK, SN, F.when(~F.col(SN), F.col(SK)).alias(SESSION_KEY), "first.visit.*", *FACTS,
                        F.col("entry.pathname").alias("entry_page"), F.col("exit.pathname").alias("exit_page"))
    return (out.select(SK, SN, *static, *FACTS, "entry_page", "exit_page")
            .withColumn("channel", channel_expr()).withColumn("source", source_expr()))


def partial_hours(a: Analytics) -> DataFrame:
    return (a.base.where(is_page_view()).groupBy(*CELL, F.date_trunc("hour", "timestamp").alias("hour"))
            .agg(F.count(F.lit(1)).alias("views")))


class SessionRollups:
    """The rollup tables under ``root``.  ``like`` is any view of the same columns as the batches (an empty one will do)."""

    def __init__(self, spark: SparkSession, root: str, like: Analytics):
        self.spark, self.root, self.like = spark, root.rstrip("/"), like

    @cached_property
    def states(self) -> Table:
        # through DDL, so that parts of a struct may be null, as they are in files
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in partial_sessions(self.like).schema.fields)
        return Table("session_rollups", T.StructType.fromDDL(ddl), CELL, "first_ts", SK)

    def add(self, batch: Analytics, batch_id: int, writer: str = BATCH_WRITER) -> int:
        """Store one batch's states, in place of an earlier attempt of the same batch; returns the new version."""
        commit = Commit(self.spark, self.root)
        tag = {"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("bigint")}
        try:
            commit.write(self.states, partial_sessions(batch).withColumns(tag))
            commit.write(HOURS, partial_hours(batch).withColumns(tag))
            return replace_batch(commit, [self.states, HOURS], writer, batch_id)
        except BaseException:
            commit.abandon()
            raise

    def read(self, table: Table, where: Column | None = None) -> DataFrame:
        """Live rows of one table; ``where`` (on ``site_id`` and ``dt``) also picks the files."""
        rows = snapshot(self.spark, self.root).read(table, where=where)
        return rows if where is None else rows.where(where)

    def analytics(self, where: Column | None = None) -> Analytics:
        """A view for reports on the session table.  It has no event rows: reports on those need the lake."""
        return Analytics(None, merged_sessions(self.read(self.states, where), self.like.static), self.like.static, self.like.seq_col)

    def timeseries(self, fmt: str = "yyyy-MM-dd", where: Column | None = None) -> DataFrame:
        """Page views per day or hour, as ``stats.timeseries`` has them; ``fmt`` no finer than an hour."""
        return (self.read(HOURS, where).groupBy(F.date_format("hour", fmt).alias("date"))
                .agg(F.sum("views").alias("views")).orderBy("date"))

    def compact(self, site_id: str, dt: str) -> int:
        """Write the files of one site and day again as few; rows keep their batch, so a replay still replaces them."""
        where = (F.col("site_id") == site_id) & (F.col("dt") == dt)
        return sum(merge_files(self.spark, self.root, t, where) or 0 for t in (self.states, HOURS))
