"""Small Column helpers for text and display formatting (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_ws(c: Column) -> Column:
    """Remove leading/trailing whitespace of any kind (like a JS ``trim``)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or whitespace only."""
    return c.isNull() | (strip_ws(c) == "")


def format_duration(seconds: Column) -> Column:
    """Seconds -> ``1m 30s`` / ``45s`` / ``0s``; ``N/A`` for null or negative."""
    m = F.floor(seconds / F.lit(60.0))
    s = F.floor(F.pmod(seconds, F.lit(60.0)))
    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit("N/A"))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s")))
        .when(s > 0, F.concat(s.cast("string"), F.lit("s")))
        .otherwise(F.lit("0s"))
    )


def fixed(c: Column, digits: int) -> Column:
    """Number -> text with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", c)


def is_json(c: Column) -> Column:
    """Is the text exactly one JSON value?  The JSON parser stops after the first value, so the text is also read as the
    one element of an array.  Repeated keys are allowed where the session's settings allow them (``session.DEFAULT_CONF``)."""
    alone = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    return F.coalesce(F.try_parse_json(c).isNotNull() & alone, F.lit(False))


def last_of_repeated_keys(m: Column) -> Column:
    """A map read from JSON text, each key once with its last value."""
    keys = F.map_keys(m)
    once = F.array_distinct(keys)
    last = F.transform(once, lambda k: F.element_at(F.map_values(F.map_filter(m, lambda x, _v: x == k)), -1))
    return F.when(F.size(once) < F.size(keys), F.map_from_arrays(once, last)).otherwise(m)
