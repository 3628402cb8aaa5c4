"""Readers: the lake's tables, raw requests, fixed-schema JSON, value rows.

Every reader passes an explicit schema (no inference).  A lake table's files are those that the commit log names
(``lakelog``), at ``<root>/<table>/commit=<id>/site_id=<id>/dt=<yyyy-MM-dd>/part-*.parquet``; declaring ``dt`` as a string
in the schema keeps it a string partition key, so ``dt BETWEEN a AND b`` and ``site_id IN (...)`` are partition filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .lakelog import Table, snapshot

#: The lake's tables.  ``writer`` and ``batch_id`` come with every row besides these columns.
INITIAL_EVENTS = Table("initial_events", S.INITIAL_EVENTS, ("site_id", "dt"), "timestamp", "session_id")
EVENTS = Table("events", S.EVENTS, ("site_id", "dt"), "timestamp", "session_id")
REJECTS = Table("rejects", S.REJECTS, ("reason", "dt"), "received_at")
USAGE = Table("usage", T.StructType([f for f in S.USAGE_LEDGER.fields if f.name != "batch_id"]))
TABLES = {t.name: t for t in (INITIAL_EVENTS, EVENTS, REJECTS, USAGE)}

# Timestamps in JSON text keep microseconds (the writer's default keeps milliseconds).
JSON_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_table(spark: SparkSession, root: str, table: Table, **scope) -> DataFrame:
    """Live rows of one lake table.  ``scope`` (``where``, ``start``, ``end``, ``keys``) leaves out files that cannot hold
    rows of it, by the log's zone maps; rows of the files kept are not filtered."""
    return snapshot(spark, root).read(table, **scope)


def read_events(spark: SparkSession, root: str, **scope) -> DataFrame:
    """The regular-event table (7 columns + writer, batch_id)."""
    return read_table(spark, root, EVENTS, **scope)


def read_initial_events(spark: SparkSession, root: str, **scope) -> DataFrame:
    """The first-event table (28 columns + writer, batch_id)."""
    return read_table(spark, root, INITIAL_EVENTS, **scope)


def read_requests(spark: SparkSession, path: str, streaming: bool = False,
                  max_files_per_trigger: int | None = None, fmt: str = "json") -> DataFrame:
    """Raw tracker requests: JSON lines (one request per line) or a Parquet landing table."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(S.REQUEST)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "parquet":
        return reader.parquet(path)
    return reader.option("mode", "PERMISSIVE").option("timestampFormat", JSON_TS).json(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON with a declared schema and no detection; a malformed record fails the
    read; an empty or missing input gives an empty table of that schema."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").option("timestampFormat", JSON_TS).json(path)
    except Exception as e:  # missing path -> empty typed table
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def values_to_rows(df: DataFrame, schema: list[tuple[str, str]], values_col: str = "values") -> DataFrame:
    """Positional value arrays + schema list -> named, typed columns.

    ``schema`` is ``[(name, type)]`` with type ``string``, ``timestamp`` or
    ``map<string,string>`` (kept as JSON text, as the report layer holds it).
    Short rows are padded with null.
    """
    v = F.col(values_col)
    cols = []
    for i, (name, typ) in enumerate(schema):
        x = F.try_element_at(v, F.lit(i + 1))
        t = typ.lower()
        if t == "timestamp":
            x = F.try_to_timestamp(x)
        cols.append(x.alias(name))
    return df.select(*cols)
