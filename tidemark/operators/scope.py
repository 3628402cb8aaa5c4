"""Scoped read: owned sites, requested scope, partition filter, safe columns.

``fetch`` returns both tables for one scope as lazy DataFrames.  The scope
first picks files from the lake's log, by site, day and (when asked for sessions)
the files' Bloom filters, so only files that may match are listed and read; it
also becomes a literal ``site_id IN (...)`` and ``dt BETWEEN a AND b`` on the
partition columns, and the safe-column list prunes the Parquet read schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.text import is_json
from ..sources.lake import EVENTS, INITIAL_EVENTS
from ..sources.lakelog import Table, snapshot


def owned_sites(sites: DataFrame, owner: str) -> DataFrame:
    """Site ids whose owner is ``owner``."""
    return sites.filter(F.col("owner_sub") == owner).select("site_id")


def parse_requested(requested: str | None) -> list[str] | None:
    """Comma text -> trimmed, non-blank ids (None when nothing was asked)."""
    if requested is None:
        return None
    return [x.strip() for x in requested.split(",") if x.strip()]


def site_scope(sites: DataFrame, owner: str, requested: str | None = None) -> DataFrame:
    """Requested ids that the owner owns (all owned ids when none requested)."""
    owned = owned_sites(sites, owner)
    ids = parse_requested(requested)
    if ids is None:
        return owned
    return owned.filter(F.col("site_id").isin(ids))


def resolve_scope(sites: DataFrame, owner: str, requested: str | None = None,
                  max_listed: int = 10_000) -> list[str] | DataFrame:
    """The scope: a short id list (a literal ``IN`` for static partition
    pruning) when it has at most ``max_listed`` ids, else the scope itself as
    a DataFrame (``scope`` then semi-joins it; dynamic partition pruning still
    applies).  Raises PermissionError when specific ids were requested and
    none is owned."""
    ids_df = site_scope(sites, owner, requested).distinct()
    rows = ids_df.limit(max_listed + 1).collect()
    req = parse_requested(requested)
    if req and not rows:
        raise PermissionError("You do not have permission to access the requested site IDs.")
    if len(rows) > max_listed:
        return ids_df
    return sorted(r["site_id"] for r in rows)


def scope(df: DataFrame, ids: list[str] | DataFrame, start: str, end: str) -> DataFrame:
    """``dt BETWEEN start AND end`` (strings, inclusive) and ``site_id IN ids``
    (a literal list, or a DataFrame of ``site_id`` joined as a semi join)."""
    out = df.where(F.col("dt").between(start, end))
    if isinstance(ids, DataFrame):
        return out.join(ids.select("site_id").distinct(), "site_id", "left_semi")
    return out.where(F.col("site_id").isin(list(ids)))


def safe_select(df: DataFrame, fields) -> DataFrame:
    """Only columns tagged yes or maybe, common ones first, in declared order."""
    return df.select(*[f.name for f in S.safe_fields(fields)])


def typed_select(df: DataFrame) -> DataFrame:
    """Property columns -> JSON text; ``value`` / ``session_duration`` -> double
    (null when not castable)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in ("properties", "user_properties", "group_properties"):
            if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)):
                c = F.to_json(c)
            else:
                c = F.when(is_json(c), c)
        elif f.name in ("value", "session_duration"):
            c = c.try_cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("timestamp").desc())


def scoped_read(spark: SparkSession, root: str, table: Table, ids: list[str] | DataFrame, start: str, end: str,
                session_ids: list[str] | None = None) -> DataFrame:
    """Rows of one scope (and of some sessions, when given), opening only files whose zone maps may hold any."""
    days = F.col("dt").between(start, end)
    snap = snapshot(spark, root)
    if isinstance(ids, DataFrame):
        files = snap.files(table, where=days, keys=session_ids).join(ids.select("site_id").distinct(), "site_id", "left_semi")
        df = table.read_files(spark, snap.root, sorted(r["path"] for r in files.select("path").collect()))
    else:
        df = snap.read(table, where=days & F.col("site_id").isin(list(ids)), keys=session_ids)
    df = scope(df, ids, start, end)
    return df if session_ids is None else df.where(F.col("session_id").isin(list(session_ids)))


def fetch(spark: SparkSession, root: str, ids: list[str] | DataFrame, start: str, end: str,
          session_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(initial_events, events) of one scope, safe columns only, report-layer types."""
    ini = scoped_read(spark, root, INITIAL_EVENTS, ids, start, end, session_ids)
    ev = scoped_read(spark, root, EVENTS, ids, start, end, session_ids)
    return typed_select(safe_select(ini, S.INITIAL_FIELDS)), typed_select(safe_select(ev, S.COMMON_FIELDS))
