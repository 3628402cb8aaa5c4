"""Writers: route events to the two lake tables, compaction, views, value rows.

A batch's tables are written to folders of their own and become visible together by one commit of the lake's log
(``sources.lakelog``).  Running a batch again (task retry, lost executor, replayed micro-batch, also after a compaction)
replaces exactly its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..sources.lake import TABLES
from ..sources.lakelog import Commit, merge_files, replace_batch

#: The writer of batch jobs; a stream has a name of its own for each checkpoint.
BATCH_WRITER = "batch"


def value_rows(df: DataFrame, cols: list[str], values_col: str = "values", keep: list[str] | None = None) -> DataFrame:
    """Named columns -> one positional text array in the order of ``cols``;
    a column the frame lacks gives null; maps become JSON text.  ``keep`` names columns that stay beside it."""
    present = set(df.columns)
    parts = []
    for c in cols:
        if c not in present:
            parts.append(F.lit(None).cast("string"))
            continue
        dt = df.schema[c].dataType
        if isinstance(dt, (T.MapType, T.StructType, T.ArrayType)):
            parts.append(F.to_json(F.col(c)))
        elif isinstance(dt, T.TimestampType):
            parts.append(F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSS"))
        else:
            parts.append(F.col(c).cast("string"))
    return df.select(*(keep or []), F.array(*parts).alias(values_col))


def route(df: DataFrame, flag: str = "is_initial_event") -> tuple[DataFrame, DataFrame]:
    """Split one event frame into (first events, later events)."""
    return df.filter(F.col(flag)), df.filter(~F.col(flag))


def write_batch(spark: SparkSession, root: str, frames: dict[str, DataFrame], batch_id: int,
                writer: str = BATCH_WRITER) -> int:
    """Write one batch (table name -> rows) and commit it; returns the lake's new version.

    Whatever an earlier attempt of the same batch left is replaced in the same commit, in all tables.
    """
    commit = Commit(spark, root)
    try:
        for name, df in frames.items():
            commit.write(TABLES[name], df.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("bigint")}))
        return replace_batch(commit, list(TABLES.values()), writer, batch_id)
    except BaseException:
        commit.abandon()
        raise


def register_tables(spark: SparkSession, initial: DataFrame, events: DataFrame,
                    names: tuple[str, str] = ("initial_events", "events")) -> None:
    """Replace both working views together, or neither.

    Both frames are checked against the declared columns first; only when
    both pass are the two temp views replaced.
    """
    need_i = [f.name for f in S.INITIAL_FIELDS]
    need_e = [f.name for f in S.COMMON_FIELDS]
    for df, need, n in ((initial, need_i, names[0]), (events, need_e, names[1])):
        missing = [c for c in need if c not in df.columns]
        if missing:
            raise ValueError(f"{n}: missing columns {missing}; views left unchanged")
    initial.createOrReplaceTempView(names[0])
    events.createOrReplaceTempView(names[1])


def compact(spark: SparkSession, root: str, table: str, site_id: str, dt: str) -> int:
    """Write the files of one (site_id, dt) partition again as few (of the advisory partition size); returns its rows.

    Rows keep their writer and batch, so a later replay of a batch still finds and replaces them.  A batch that commits
    while the files are merged is kept as it is.  Readers on an earlier version go on reading the old files until
    ``lakelog.expire`` deletes them.
    """
    where = (F.col("site_id") == site_id) & (F.col("dt") == dt)
    return merge_files(spark, root, TABLES[table], where) or 0
