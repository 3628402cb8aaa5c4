"""First events of sessions in a stream: keyed state that marks each session's first event once.

The batch form is ``operators.ingest.mark_initial``.  In a stream a session's rows come over many micro-batches, so
what was marked has to be remembered: one flag per session, in Spark's state store, under the query's checkpoint.  A
micro-batch that runs again after a failure starts from the state version before it and marks the same rows.  With a
time column the state of a session that was silent for ``ttl_hours`` (by the stream's watermark) is dropped, so it grows with the sessions
of that time and not with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def mark_initial_stream(df: DataFrame, keys: list[str], order: list[str], out: str = "is_initial_event",
                        time_col: str | None = None, ttl_hours: int = 24) -> DataFrame:
    """``df`` (streaming) with ``out``: true for exactly one row of each ``keys`` group, the first by ``order`` (then by the
    other columns that can be compared) of the first micro-batch that has the group.

    Equal to the batch form when micro-batches follow each other in ``order``.  With ``time_col`` (a timestamp) a group silent
    for ``ttl_hours`` counts as new, and rows later than that are dropped as late; without it flags are kept for good.  Null keys are a group like any other.  A session's rows of one micro-batch come in pieces, of which only the
    first row so far is held back; how many they are is bounded by the trigger (``maxFilesPerTrigger``).
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())])
    comparable = (T.StringType, T.NumericType, T.TimestampType, T.BooleanType)
    by = [c for c in dict.fromkeys([*order, *[f.name for f in df.schema.fields if isinstance(f.dataType, comparable)]]) if c not in keys]
    ttl_ms = ttl_hours * 3_600_000
    if time_col:
        df = df.withWatermark(time_col, f"{ttl_hours} hours")

    def mark(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, first, latest = state.exists, None, 0
        for piece in pieces:
            if time_col:
                latest = max([latest, *(int(t.timestamp() * 1000) for t in piece[time_col].dropna())])
            piece = piece.assign(**{out: False})
            if not seen:
                if first is not None:
                    piece = pd.concat([piece, first], ignore_index=True)
                piece = piece.sort_values(by, kind="stable", na_position="first", ignore_index=True)
                first, piece = piece.iloc[:1], piece.iloc[1:]
            if len(piece):
                yield piece
        if first is not None:
            yield first.assign(**{out: True})
        state.update((True,))
        if time_col:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_ms)

    timeout = GroupStateTimeout.EventTimeTimeout if time_col else GroupStateTimeout.NoTimeout
    return df.groupBy(*keys).applyInPandasWithState(mark, schema, "marked boolean", "append", timeout)
