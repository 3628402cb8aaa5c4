"""Structured Streaming ingest: JSON request files -> lake, one micro-batch at a time.

The stream reuses the batch job unchanged inside ``foreachBatch``.  A batch is known by the checkpoint's writer name and the
micro-batch id, so a replayed micro-batch (after a failure, from the checkpoint) replaces its own rows in all tables,
and a stream with a new checkpoint, whose ids start from 0 again, replaces nothing of the old one.  Time is
the server receive time, so there is no late data and no watermark.  Commits of several streams into one lake do not
lose each other's rows, but streams that meter the same sites at the same time may each grant a site's last requests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import ingest_to_lake
from ..session import scratch_path
from ..sources.lake import read_requests
from ..sources.lakelog import names_in


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The writer name kept in a checkpoint folder: made when the folder is new, the same ever after."""
    known = [n for n in names_in(spark, checkpoint) if n.startswith("writer-")]
    if not known:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/writer-{uuid.uuid4().hex}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        known = [folder.getName()]
    return min(known)


def start_ingest(spark: SparkSession, source: str, sites: Callable[[], DataFrame], root: str,
                 checkpoint: str | None = None, trigger_seconds: int = 60, available_now: bool = False,
                 metered: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest stream. ``sites`` is called per micro-batch (a fresh
    read of the site table, as the source product re-reads its config)."""
    reqs = read_requests(spark, source, streaming=True, max_files_per_trigger=max_files_per_trigger)

    if checkpoint is None:
        # one checkpoint per (source, lake): two streams never share progress
        key = hashlib.sha1(f"{source}|{root}".encode()).hexdigest()[:16]
        checkpoint = scratch_path(spark, "streams", f"ingest-{key}")
    writer = writer_of(spark, checkpoint)

    def run_batch(df: DataFrame, batch_id: int) -> None:
        ingest_to_lake(spark, df, sites(), root, int(batch_id), metered=metered, writer=writer)

    w = reqs.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
