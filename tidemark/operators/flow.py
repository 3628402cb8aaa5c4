"""Page flow: step-to-step transitions inside sessions (the Sankey links).

Steps are the session's events in time order, a step equal to the one before
it is dropped, the rest are numbered, and each step is paired with the next.
Without hot sessions the windows run per session, on rows scanned and shuffled
once.  Otherwise they run per (session, chunk): a normal session is one chunk, one
above ``HOT_SESSION_ROWS`` rows is cut into one-second chunks, so a single huge
(bot) session is spread over many tasks, and a small per-chunk summary repairs
the chain across chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import sized_broadcast
from .model import SK, SN, Analytics, order_columns

# Node marks for page views and for other events.
PAGE_MARK = "\U0001F4C3 "
CLICK_MARK = "\U0001F5B1️ "

# Sessions above model.HOT_SESSION_ROWS rows are cut into time chunks for the window chain.
CHUNK_US = 1_000_000   # one second

# The event columns that order rows: the others do not tell labels apart.
EVENT_ORDER = ("timestamp", "event", "pathname")

LINK_LIMIT = 200       # links fetched
MIN_COUNT = 3          # shown links need at least this count
DISPLAY_LIMIT = 75     # links shown


def node_label() -> Column:
    """Page view -> page mark + path (or ``[unknown]``); else click mark + event name."""
    return F.when(
        F.col("event") == "page_view",
        F.concat(F.lit(PAGE_MARK), F.coalesce(F.col("pathname"), F.lit("[unknown]"))),
    ).otherwise(F.concat(F.lit(CLICK_MARK), F.col("event")))


def _kept(prev: Column, cur: Column) -> Column:
    """A step is kept when there is no previous step label or it differs (null-safe as SQL)."""
    return F.coalesce(prev.isNull() | (cur != prev), F.lit(False))


def _node_id(index: Column) -> Column:
    # a null label is skipped by the concatenation, not propagated
    return F.concat_ws("", F.col("base_node"), F.lit(" #"), index.cast("string"))


def steps(rows: DataFrame, seq_col: str | None = None, hot: DataFrame | None = None,
          chunk_us: int = CHUNK_US) -> DataFrame:
    """Deduplicated, numbered steps: ``_sk, _sn, session_id, node_id, step_idx, target_node``.

    Without ``hot`` rows are windowed per session, else per (session, chunk).
    Sessions listed in ``hot`` (key columns ``_sk, _sn``) are cut into chunks
    of ``chunk_us`` microseconds of time, so a session holding a large share
    of all rows is spread over many tasks; a per-chunk summary (first and
    last label, kept count) carries the dedupe, the step numbering (a prefix
    sum) and the pairing across chunk borders.
    """
    # rows that tie in all of these have the same label, so their order is immaterial
    extra = [c for c in order_columns(rows.columns, seq_col) if c in (*EVENT_ORDER, seq_col)]
    order = [F.col(c) for c in extra]
    r = rows.select(SK, SN, "session_id", *extra, node_label().alias("base_node"))
    if hot is None:
        w = Window.partitionBy(SK, SN).orderBy(*order)
        kept = r.withColumn("_lp", F.lag("base_node").over(w)).withColumn("_rn", F.row_number().over(w))
        kept = kept.filter((F.col("_rn") == 1) | _kept(F.col("_lp"), F.col("base_node")))
        kept = kept.withColumn("step_idx", F.row_number().over(w)).withColumn("node_id", _node_id(F.col("step_idx")))
        return kept.withColumn("target_node", F.lead("node_id").over(w)).drop("_lp", "_rn")
    flag = hot.select(SK, SN).distinct().withColumn("_hot", F.lit(True))
    r = r.join(sized_broadcast(flag), [SK, SN], "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    r = r.withColumn("_chunk", F.when(F.col("_hot"), F.floor(F.unix_micros("timestamp") / F.lit(chunk_us)))
                     .otherwise(F.lit(0)).cast("bigint"))
    part = [SK, SN, "_chunk"]
    w = Window.partitionBy(*part).orderBy(*order)
    r = r.withColumn("_rn", F.row_number().over(w)).withColumn("_lp", F.lag("base_node").over(w))
    r = r.withColumn("_inner", (F.col("_rn") > 1) & _kept(F.col("_lp"), F.col("base_node")))
    # Chunk summary, for hot sessions only (a normal session is a single chunk:
    # its first step is kept, its numbering starts at 0 and no chunk follows).
    ok = F.struct(*order)
    summ = r.filter(F.col("_hot")).groupBy(*part).agg(
        F.min_by("base_node", ok).alias("_first"),
        F.max_by("base_node", ok).alias("_last"),
        F.count_if("_inner").alias("_inner_n"),
        F.min_by("base_node", F.when(F.col("_inner"), ok)).alias("_first_inner"),
    )
    cw = Window.partitionBy(SK, SN).orderBy("_chunk")
    summ = summ.withColumn("_first_kept", _kept(F.lag("_last").over(cw), F.col("_first")))
    summ = summ.withColumn("_kept_n", F.col("_inner_n") + F.col("_first_kept").cast("int"))
    summ = summ.withColumn(
        "_offset", F.coalesce(F.sum("_kept_n").over(cw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    first_node = F.when(F.col("_first_kept"), F.col("_first")).otherwise(F.col("_first_inner"))
    summ = summ.withColumn(
        "_first_id",
        F.when(F.col("_kept_n") > 0,
               F.concat_ws("", first_node, F.lit(" #"), (F.col("_offset") + 1).cast("string"))),
    )
    summ = summ.withColumn(
        "_next_id", F.first("_first_id", ignorenulls=True).over(cw.rowsBetween(1, Window.unboundedFollowing))
    ).select(*part, "_first_kept", "_offset", "_next_id")
    j = r.join(sized_broadcast(summ), part, "left").withColumn(
        "_first_kept", F.coalesce("_first_kept", F.lit(True))).withColumn("_offset", F.coalesce("_offset", F.lit(0)))
    kept = j.filter(F.when(F.col("_rn") == 1, F.col("_first_kept")).otherwise(F.col("_inner")))
    kept = kept.withColumn("step_idx", F.col("_offset") + F.row_number().over(w))
    kept = kept.withColumn("node_id", _node_id(F.col("step_idx")))
    kept = kept.withColumn("target_node", F.coalesce(F.lead("node_id").over(w), F.col("_next_id")))
    return kept.drop("_rn", "_lp", "_inner", "_first_kept", "_offset", "_next_id", "_hot")


def transitions(a: Analytics) -> DataFrame:
    """All (source, target) pair counts of the kept sessions."""
    st = steps(a.event_rows(), a.seq_col, a.hot)
    return (
        st.filter(F.col("target_node").isNotNull())
        .groupBy(F.col("node_id").alias("source_node"), F.col("target_node"))
        .agg(F.count(F.lit(1)).alias("value"))
    )


def flow_links(a: Analytics, limit: int = LINK_LIMIT) -> DataFrame:
    """The ``limit`` largest transitions (ties by source, then target)."""
    return transitions(a).orderBy(F.col("value").desc(), "source_node", "target_node").limit(limit)


def display_links(links: DataFrame, min_count: int = MIN_COUNT, limit: int = DISPLAY_LIMIT) -> DataFrame:
    """Links shown: count >= min_count, ends differ, ``limit`` largest."""
    return (
        links.filter(
            F.col("source_node").isNotNull() & F.col("target_node").isNotNull()
            & (F.col("source_node") != F.col("target_node")) & (F.col("value") >= min_count)
        )
        .select(F.col("source_node").alias("source"), F.col("target_node").alias("target"), "value")
        .orderBy(F.col("value").desc(), "source", "target")
        .limit(limit)
    )


def flow_nodes(shown: DataFrame) -> DataFrame:
    """Distinct ends of the shown links; label without the trailing `` #n``."""
    ends = shown.select(F.col("source").alias("id")).union(shown.select(F.col("target").alias("id"))).distinct()
    return ends.select("id", F.regexp_replace("id", r" #\d+$", "").alias("label"))


def sankey(a: Analytics) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) as the flow chart draws them."""
    links = display_links(flow_links(a))
    return flow_nodes(links), links
