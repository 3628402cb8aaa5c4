"""Shared helpers: document columns, bounded per-worker caches, tokenizer files, CRCs."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: Entries a worker's word cache may hold; it is emptied when full, and longer words are not kept, so a worker's memory is bounded.
CACHE_ENTRIES = 800_000
LONGEST_KEPT = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null stays null), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def barrier(df: DataFrame) -> DataFrame:
    """``df`` as it is, but a later filter stays above it: the optimizer does not push a filter through a row
    number, and so does not copy the columns' long expressions into it."""
    return df.withColumn("__row", F.monotonically_increasing_id()).where(F.col("__row") >= 0).drop("__row")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared scratch folder."""
    return scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there and every executor sees it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; ``TIDEMARK_TOKENIZERS`` names another folder."""
    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache(dict):
    """``cache[word]`` is ``fn(word)``, kept for at most :data:`CACHE_ENTRIES` words at a time of at most
    :data:`LONGEST_KEPT` characters each."""

    def __init__(self, fn, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.fn, self.entries = fn, entries

    def __missing__(self, word):
        if len(word) > LONGEST_KEPT:
            return self.fn(word)
        if len(self) >= self.entries:
            self.clear()
        value = self[word] = self.fn(word)
        return value


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts as Python strings, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]
