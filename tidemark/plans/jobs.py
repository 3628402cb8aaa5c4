"""Batch jobs: requests -> lake (replay-safe), with the usage ledger.

A batch writes ``initial_events``, ``events``, ``rejects`` and the usage ledger ``usage`` and commits them together.
A batch is known by its writer (one per batch job, one per stream checkpoint) and its number, so a stream that lost its
checkpoint and counts from 0 again replaces nothing of what it wrote before.  Running a batch again replaces its rows in
all four tables, so usage is never counted twice.

The ledger is a log: one small file per batch (the tail) after one table of totals per site and writer, which
:func:`merge_ledger` moves the tail's older batches into.  The newest batch of a writer always stays in the tail, as it
is the only one that a stream may replay.  The allowance a batch starts from is the site's grant minus the ledger of all
other batches but those after it of the same writer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import ingest
from ..operators.usage import meter
from ..sinks.lake import BATCH_WRITER, write_batch
from ..sources.lake import USAGE, read_table
from ..sources.lakelog import STAGE, exists, merge_files, remove_folder, snapshot

#: Ledger files after which a batch merges the tail into the totals.
LEDGER_TAIL = 50


def publish_once(spark: SparkSession, path: str, write) -> str:
    """Build a derived table once: ``write(tmp)`` fills a private folder next to
    ``path``, which is then renamed into place (an atomic rename on HDFS-like
    stores).  If another run published ``path`` first, its copy is kept and
    ours is removed."""
    if exists(spark, path):
        return path
    jvm = spark.sparkContext._jvm
    tmp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    write(tmp)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(conf)
    parent = dst.getParent()
    if parent is not None and not fs.exists(parent):
        fs.mkdirs(parent)
    if not fs.rename(src, dst):
        fs.delete(src, True)
    return path


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """``batch_id, site_id, used, merged, writer``: the tail's rows, and the totals (``merged``) up to a batch."""
    return read_table(spark, root, USAGE).select(*S.USAGE_LEDGER.names, "writer")


def remaining_allowance(spark: SparkSession, sites: DataFrame, root: str, batch_id: int, writer: str = BATCH_WRITER) -> DataFrame:
    """Sites with ``request_allowance`` = grant - usage of other writers' batches and this writer's before ``batch_id``."""
    used = (
        read_ledger(spark, root).filter((F.col("writer") != writer) | (F.col("batch_id") < batch_id))
        .groupBy("site_id").agg(F.sum("used").alias("_used"))
    )
    return sites.join(used, "site_id", "left").withColumn(
        "request_allowance", (F.col("request_allowance") - F.coalesce(F.col("_used"), F.lit(0))).cast("bigint")
    ).drop("_used").select(*sites.columns)


def is_merged(spark: SparkSession, root: str, batch_id: int, writer: str = BATCH_WRITER) -> bool:
    """Is the batch's usage already part of the totals?"""
    mine = (F.col("writer") == writer) & (F.col("batch_id") >= batch_id)
    return not read_ledger(spark, root).where("merged").where(mine).isEmpty()


def merge_ledger(spark: SparkSession, root: str) -> int | None:
    """Move all but the newest batch of each writer from the ledger's tail into the totals."""
    def change(rows: DataFrame) -> DataFrame:
        newest = rows.where("NOT merged").groupBy("writer").agg(F.max("batch_id").alias("newest"))
        rows = rows.join(newest, "writer", "left")
        old = F.col("merged") | (F.col("batch_id") < F.col("newest"))
        marks = rows.where(old).groupBy("writer").agg(F.max("batch_id").alias("batch_id"))
        totals = rows.where(old).groupBy("site_id", "writer").agg(F.sum("used").alias("used")).join(marks, "writer").withColumn("merged", F.lit(True))
        return rows.where(~old).drop("newest").unionByName(totals)

    return merge_files(spark, root, USAGE, F.lit(True), change)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back, so that its plan ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingest_to_lake(spark: SparkSession, requests: DataFrame, sites: DataFrame, root: str, batch_id: int,
                   metered: bool = True, event_aliases: dict[str, str] | None = None,
                   writer: str = BATCH_WRITER) -> dict[str, int]:
    """Check, enrich and write one batch of requests; returns status counts.

    The checked batch is stored once beside the lake's tables and feeds all four
    writes, so its size is bounded by disk and its tasks by Parquet splits.  The
    site table with what is left of each allowance has a row for each site, so
    it is broadcast whenever the site table itself is small.  A batch whose
    usage is already merged into the ledger's totals is complete: nothing is
    written and no count returned.
    """
    bound = sites
    if metered:
        if is_merged(spark, root, batch_id, writer):
            return {}
        sites = remaining_allowance(spark, sites, root, batch_id, writer)
    stage = f"{root.rstrip('/')}/{STAGE}/{uuid.uuid4().hex}"
    try:
        # the gate reads the pre-checked batch three times: run the checks before it once
        pre = _stored(ingest.pre_check(requests, sites, bound), f"{stage}/pre")
        checked = _stored(ingest.finish_checks(pre, metered, bound), f"{stage}/checked")
        initial, regular, rejects = ingest.split_checked(checked, event_aliases)
        frames = {"initial_events": initial, "events": regular, "rejects": rejects}
        if metered:
            frames["usage"] = meter(checked).withColumn("merged", F.lit(False))
        write_batch(spark, root, frames, batch_id, writer)
        counts = {str(r["status"]): r["n"] for r in checked.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    finally:
        remove_folder(spark, stage)
    if metered and snapshot(spark, root).files(USAGE).count() > LEDGER_TAIL:
        merge_ledger(spark, root)
    return counts
