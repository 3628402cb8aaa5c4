"""The stream marks the same first events as the batch, over three micro-batches, one of them run again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ingest import mark_initial
from tidemark.streaming.first_events import mark_initial_stream

SCHEMA = "session string, t long, v string"
BATCHES = [
    [("a", 1, "x"), ("a", 1, "w"), ("b", 2, "y"), (None, 2, "n")],
    [("a", 5, "z"), ("c", 6, "q"), ("c", 6, "p"), ("c", 7, "r"), (None, 8, "m")],
    [("d", 9, None), ("d", 9, "u"), ("b", 10, "s"), ("c", 11, "t")],
]


@pytest.mark.parametrize("time_col", [None, "at"])
def test_stream_equals_batch_with_a_replay(spark, scratch, time_col):
    done = []

    def sink(df, batch_id):
        done.append(batch_id)
        df.write.mode("overwrite").parquet(f"{scratch}/out/batch={batch_id}")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(scratch + "/in")
        stream = stream.withColumn("at", F.timestamp_seconds(F.col("t") * 600))
        q = mark_initial_stream(stream, ["session"], ["t"], "first", time_col).writeStream.foreachBatch(sink).option(
            "checkpointLocation", scratch + "/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(scratch + "/in")
        if i == 1:
            run()
    run()
    # the last micro-batch counts as not committed: it runs again on the state before it
    last = max(glob.glob(scratch + "/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for f in (last, f"{scratch}/checkpoint/commits/.{os.path.basename(last)}.crc"):
        if os.path.exists(f):
            os.remove(f)
    run()
    assert len(done) == len(set(done)) + 1  # one ran twice
    got = spark.read.parquet(scratch + "/out").select("session", "t", "v", "first").collect()
    want = mark_initial(spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA), ["session"], [F.col("t")], "first")
    assert sorted(map(str, got)) == sorted(map(str, want.select("session", "t", "v", "first").collect()))
    assert sum(r["first"] for r in got) == 5
