"""Shards by jump consistent hashing, in DataFrame functions only.

A row's shard depends on its key and the number of shards alone; there is no ring table.  With
one more shard, a key stays or moves to the new shard.  The 64-bit generator of the published
method (Lamping and Veach, 2014) needs products modulo 2**64; Spark's ``bigint`` raises on
overflow, so they are formed from 22-bit limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_text

#: Multiplier of the published generator (fixed value).
MULTIPLIER = 2862933555777941757
MASK = (1 << 22) - 1
#: Rows that share one numbering bucket, about; bounds the sort of any task.
BUCKET_ROWS = 20_000
#: Copies of one row that are written out together.
RUN_ROWS = 1_000


def _next_key(k: Column) -> Column:
    """``k * MULTIPLIER + 1`` modulo 2**64, as a signed long."""
    m0, m1, m2 = MULTIPLIER & MASK, MULTIPLIER >> 22 & MASK, MULTIPLIER >> 44
    k0, k1, k2 = k.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(k, 22).bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(k, 44)
    low = k0 * F.lit(m0) + F.lit(1)
    mid = k1 * F.lit(m0) + k0 * F.lit(m1) + F.shiftrightunsigned(low, 22)
    high = k2 * F.lit(m0) + k1 * F.lit(m1) + k0 * F.lit(m2) + F.shiftrightunsigned(mid, 22)
    return (F.shiftleft(high, 44).bitwiseOR(F.shiftleft(mid.bitwiseAND(F.lit(MASK)), 22))
            .bitwiseOR(low.bitwiseAND(F.lit(MASK))))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. ``shards - 1`` of a long key (null counts as 0).

    Every jump goes forward by one bucket at least, so ``shards`` steps are always enough.
    """
    start = F.struct(F.coalesce(key, F.lit(0)).cast("long").alias("k"), F.lit(-1).cast("long").alias("b"),
                     F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = _next_key(s["k"])
        spread = F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + F.lit(1)).cast("double")
        jump = F.floor((s["j"] + F.lit(1)).cast("double") * spread).cast("long")
        return F.when(s["j"] < F.lit(shards), F.struct(k.alias("k"), s["j"].alias("b"), jump.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = 8, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per input row.

    ``law`` is ``key``: ``doc_id`` and the number of shards decide.  ``size`` is the text's UTF-8
    bytes plus one (null text: 1, CRC of nothing: 0).  ``slot`` numbers a shard's rows from 0
    without gaps.  Equal rows are counted before anything moves, distinct rows are numbered inside
    small buckets of their hash, and a bucket's first slot is the sum of the counts before it:
    no task sorts a whole shard or gathers the copies of one row.  The copies are written out in runs of
    :data:`RUN_ROWS`, dealt over the tasks.  Equal rows get any order among themselves.
    A null ``doc_id`` is placed like 0; an empty table gives an empty result.
    """
    rows = id_text(docs).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    rows = rows.select("*", jump_shard(F.col("doc_id"), shards).alias("shard"),
                       jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))
    n_buckets = max(1, -(-docs.count() // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n_buckets)).cast("int"))
    distinct = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = (Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
              .rowsBetween(Window.unboundedPreceding, 0))
    last = F.col("first") + F.col("upto") - 1
    numbered = distinct.withColumn("upto", F.sum("copies").over(inside)).join(firsts, ["shard", "bucket"]).withColumn("last", last)
    low = F.col("last") - F.col("copies") + 1
    runs = numbered.withColumn("low", F.explode(F.sequence(low, F.col("last"), F.lit(RUN_ROWS).cast("long"))))
    # a given number of partitions, as adaptive execution would merge the few bytes of many runs into one task again
    n_tasks = min(n_buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (runs.repartition(n_tasks, "shard", "low")
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    F.explode(F.sequence("low", F.least(F.col("last"), F.col("low") + RUN_ROWS - 1))).alias("slot"), "grown_shard"))
